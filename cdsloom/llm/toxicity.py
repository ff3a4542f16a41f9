"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each present or not: its words (lower case, without outer
punctuation), their first 4 and 5 letters (inflected forms share them), pairs
of neighbouring words, and pairs with one word between them, hashed to 32 bits.
Per-coordinate learning rates and an L1 penalty leave a few thousand weights,
which travel to the tasks with the code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdsloom.llm.common import Words, binary_column, binary_items, drop, extended, hash_words, mix, picked_labels, slices, stash, texts

#: Labelled rows that the model is fitted on, at most: of label 1, and of label 0.
POSITIVE, NEGATIVE = 2000, 4000
#: Features of all of them, at most: rows that don't fit in any more are left out of the sample.
MOST_FEATURES = 16_000_000
#: Rows whose crc32 of the doc_id's digits has remainder 0 are held out.
FOLDS = 5
#: Rates and penalties, chosen on an inner split of the rows that aren't held out.
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 4.0, 1.0, 4
#: The bias moves so that a score of 0.5 lies this share of the way between two quantiles of the training rows, those of label 0 and of label 1.
QUANTILES, SHARE = (0.9995, 0.005), 0.25
#: A feature in fewer training texts is left out.
LEAST_TEXTS = 3

_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(0xFFFFFFFF)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For distinct words: a hash of 64 bits for pairs, and three features of 32 bits each (0: none)."""
    cores = [_OUTER.sub("", w.lower()) for w in words]
    h = hash_words(cores)
    h[[not c for c in cores]] = 0
    one = np.zeros((len(words), 3), np.uint64)
    one[:, 0] = h & _LOW
    for k, n in ((1, 4), (2, 5)):
        long = [i for i, c in enumerate(cores) if len(c) > n]
        one[long, k] = hash_words([cores[i][:n] for i in long], seed=n) & _LOW
    return h, one


def pair_features(h: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature) of the pairs with no and with one word between; ``h``, ``row`` by word."""
    for gap, factor in ((1, _PAIR), (2, _SKIP)):
        a, b = h[:-gap], h[gap:]
        yield np.where((row[:-gap] == row[gap:]) & (a > 0) & (b > 0), row[:-gap], -1), mix(a * factor + b) & _LOW


def features(text: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct features of each text."""
    w = Words(text)
    h, one = word_features(w.uniq.to_pylist())
    row = np.repeat(np.arange(len(text)), np.diff(w.ptr))
    h = h[w.idx]
    pairs = list(pair_features(h, row))
    for k in range(len(text)):
        a, b = w.ptr[k], w.ptr[k + 1]
        own = [one[np.unique(w.idx[a:b])].ravel(), *(x[a : max(a, b - g)] for g, (_, x) in enumerate(pairs, 1))]
        out = np.unique(np.concatenate(own)).astype(np.uint32)
        yield out[out > 0]


def frequent(texts_: list[np.ndarray]) -> np.ndarray:
    """The features of enough texts, in ascending order, from the sorted distinct features of each text.

    They are counted a sixteenth of all hashes at a time, so the sample is not held once more.
    """
    cuts = [np.searchsorted(x >> np.uint32(28), np.arange(17, dtype=np.uint32)) for x in texts_]
    out = [np.zeros(0, np.uint32)]
    for k in range(16):
        seen = np.concatenate([out[0], *(x[at[k] : at[k + 1]] for x, at in zip(texts_, cuts, strict=True))])
        seen.sort()
        first = np.flatnonzero(np.r_[True, seen[1:] != seen[:-1]][: len(seen)])
        out.append(seen[first[np.diff(np.r_[first, len(seen)]) >= LEAST_TEXTS]])
    return np.concatenate(out)


def train(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Features with a weight, in ascending order, their weights, and the bias."""
    if not any(y for _, y in rows):
        return np.zeros(0, np.uint32), np.zeros(0), -20.0
    names = frequent([x for x, _ in rows])
    z, n = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    own = []
    for x, _ in rows:
        at = np.minimum(np.searchsorted(names, x), max(0, len(names) - 1))
        own.append(np.r_[at[names[at] == x] if len(names) else np.zeros(0, np.int64), len(names)].astype(np.int32))
    rng = np.random.default_rng(11)
    l1 = np.full(len(names) + 1, L1)
    l1[-1] = 0

    def weights(i):
        return np.where(np.abs(z[i]) > l1[i], -(z[i] - np.sign(z[i]) * l1[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2), 0.0)

    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            i = own[k]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - rows[k][1]
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weights(np.arange(len(names) + 1))
    logit = np.array([w[i].sum() for i in own])
    label = np.array([y for _, y in rows])
    middle = 0.0
    if (label == 0).any():
        low, high = np.quantile(logit[label == 0], QUANTILES[0]), np.quantile(logit[label == 1], QUANTILES[1])
        middle = low + SHARE * (high - low)
    # A text without any known feature stays below 0.5.
    middle = max(middle, w[-1] + 0.5)
    used = np.flatnonzero(w[:-1])
    return names[used], w[used], float(w[-1] - middle)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", positive: int = POSITIVE, negative: int = NEGATIVE, features_at_most: int = MOST_FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """A model from at most ``positive`` + ``negative`` labelled rows that aren't held out.

    They have ``features_at_most`` features in all; where they would have more, the longest are left out.
    One task trains on them, and only the model comes to the driver.

    A text that is labelled more than once counts as 1 if any label is 1; null
    labels don't count.  Without a row of label 1 every text scores near 0.
    """
    spark = docs.sparkSession
    labels = labels.select("doc_id", F.col(label).alias("label")).where("label in (0, 1)")
    learn = f"crc32(cast(doc_id as string)) % {FOLDS} != 0"
    picked = [(int(d), y) for y, most in ((1, positive), (0, negative)) for d in picked_labels(labels, "label", y, most, where=learn)]
    chosen = F.broadcast(spark.createDataFrame(picked, "doc_id long, label int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = list(features(b.column("text")))
            ptr = np.r_[0, np.cumsum([len(f) for f in x])].astype(np.int64)
            yield pa.record_batch([b.column("doc_id"), b.column("label"), binary_column(np.concatenate(x), ptr, 4)], ["doc_id", "label", "x"])

    own = texts(docs, doc_id=doc_id, text=text).join(chosen, "doc_id").mapInArrow(run, "doc_id long, label int, x binary")
    sample = stash(own.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("x").alias("x")), "sample")
    fits = within({r["doc_id"]: r["n"] for r in sample.select("doc_id", F.expr("length(x) div 4").alias("n")).collect()}, features_at_most)

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in (b for b in batches if b.num_rows):
            x, ptr = binary_items(b.column("x"), "u4")
            rows += [(d, x[s:e], y) for d, s, e, y in zip(b.column("doc_id").to_pylist(), ptr[:-1], ptr[1:], b.column("label").to_pylist(), strict=True)]
        rows.sort(key=lambda r: r[0])
        names, weights, bias = train([r[1:] for r in rows])
        yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in (names, weights)] + [pa.array([bias])], ["names", "weights", "bias"])

    rows = sample.join(F.broadcast(spark.createDataFrame([(d,) for d in fits], "doc_id long")), "doc_id").coalesce(1)
    model = rows.mapInArrow(trained, "names binary, weights binary, bias double").collect()
    drop(sample)
    return (np.frombuffer(model[0]["names"], np.uint32), np.frombuffer(model[0]["weights"]), model[0]["bias"]) if model else train([])


def within(sizes: dict[int, int], most: int) -> list[int]:
    """The ids of a sample that are taken: smallest first, so long as their sizes add up to ``most`` at most."""
    out, total = [], 0
    for d, n in sorted(sizes.items(), key=lambda x: (x[1], x[0])):
        total += n
        if total > most:
            break
        out.append(d)
    return out


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], *, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a column ``score`` from 0 to 1 for each whole text; a null text scores as an empty one."""
    names, weights, bias = model

    def make():
        table = np.zeros(1 << 24, bool)
        table[names & 0xFFFFFF] = True

        def found(x: np.ndarray) -> np.ndarray:
            """Places in ``names`` of features, or -1."""
            out = np.full(len(x), -1)
            maybe = np.flatnonzero(table[x & np.uint64(0xFFFFFF)])
            at = np.minimum(np.searchsorted(names, x[maybe]), max(0, len(names) - 1))
            out[maybe] = np.where(names[at] == x[maybe], at, -1) if len(names) else -1
            return out

        def f(text_: pa.Array, _) -> list[pa.Array]:
            w = Words(text_)
            h, one = word_features(w.uniq.to_pylist())
            row = np.repeat(np.arange(len(text_)), np.diff(w.ptr))
            rows, places = [], []
            for k in range(3):
                p = found(one[:, k])
                p = np.where(one[:, k] > 0, p, -1)[w.idx] if len(p) else np.zeros(0, int)
                rows.append(row[p >= 0])
                places.append(p[p >= 0])
            for r, x in pair_features(h[w.idx], row):
                p = found(x)
                hit = (p >= 0) & (r >= 0)
                rows.append(r[hit])
                places.append(p[hit])
            both = np.unique(np.concatenate(rows) * max(1, len(names)) + np.concatenate(places))
            total = np.bincount(both // max(1, len(names)), weights[both % max(1, len(names))] if len(names) else None, len(text_)) + bias
            return [pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))]

        return f

    return extended(docs, f"`{score}` double", make, text=text)


def verdicts(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: a row per row of ``docs``.

    Empty, null and very long texts are scored like any other, whole.  Rows
    that share a doc_id are scored each; an empty table gives no rows; a row
    without a doc_id is never held out.  Other columns are not read.
    """
    model = fit(docs, labels, doc_id=doc_id, text=text)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return scored(texts(docs, doc_id=doc_id, text=text), model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
