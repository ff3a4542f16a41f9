"""Quality rules, and a log-likelihood ratio between trusted and raw text.

The ratio compares two multinomials over hashed n-grams: one of the trusted
target (rows labelled as good), one of all documents.  Tokens are runs of word
characters and runs of other characters in lower case; n-grams are tokens and
pairs of neighbours, hashed to ``BUCKETS``; n-grams that share a bucket share
its ratio.  A document's score is its sum of log ratios divided by its number of
n-grams; documents below one threshold go, which follows from the scores of the
trusted rows, and of those labelled as not good where these say otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdsloom.llm.common import Words, csr, extended, hash_words, mix, per_row, slices, small, texts

BUCKETS = 1 << 16
#: Added to each bucket's count.
PRIOR = 1.0
#: The threshold lies at most this many times as far below the trusted rows' median as their first percentile does.
FENCE = 8
#: And at most this many times as far below it as the lowest of them; with few trusted rows that is nearer.
REACH = 2
#: Share of the rows labelled as not good that another threshold must set right to replace the one from the trusted rows.
SLACK = 0.05
#: Scores are counted in bins of this width to find the percentiles.
BIN = 0.001

WINDOW, LEAST_WORDS, REPEAT_PERCENT = 5, 10, 20
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_SPACE = " \t\n\v\f\r"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """The n-grams of a slice of texts: those within each distinct word, and those between words."""

    def __init__(self, text: pa.Array):
        w = Words(text)
        tokens = [_TOKEN.findall(x.lower()) for x in w.uniq.to_pylist()]
        names = list({t for x in tokens for t in x})
        hashes = dict(zip(names, hash_words(names).tolist(), strict=True))
        first = np.array([hashes[x[0]] if x else 0 for x in tokens], np.uint64)
        last = np.array([hashes[x[-1]] if x else 0 for x in tokens], np.uint64)
        self.n = np.array([len(x) for x in tokens], np.int64)
        flat = np.array([hashes[t] for x in tokens for t in x], np.uint64)
        owner = np.repeat(np.arange(len(tokens)), self.n)
        same = owner[1:] == owner[:-1]
        inner = self.pair(flat[:-1], flat[1:])[same]
        self.own = np.r_[flat % BUCKETS, inner].astype(np.int64)
        self.owner = np.r_[owner, owner[1:][same]]
        self.idx, self.ptr, self.words = w.idx, w.ptr, len(tokens)
        self.row = np.repeat(np.arange(len(text)), np.diff(w.ptr))
        a, b = w.idx[:-1], w.idx[1:]
        good = (self.row[1:] == self.row[:-1]) & (self.n[a] > 0) & (self.n[b] > 0)
        self.between = self.pair(last[a[good]], first[b[good]]).astype(np.int64)
        self.between_row = self.row[:-1][good]

    @staticmethod
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a * _FACTOR + b) % np.uint64(BUCKETS)

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """Of each bucket, in the texts that ``rows`` marks."""
        times = np.bincount(self.idx[rows[self.row]], minlength=self.words)
        return (np.bincount(self.own, times[self.owner], BUCKETS) + np.bincount(self.between[rows[self.between_row]], minlength=BUCKETS)).astype(np.int64)

    def scores(self, ratio: np.ndarray, n_texts: int) -> np.ndarray:
        value = np.bincount(self.owner, ratio[self.own], self.words)
        size = np.bincount(self.owner, minlength=self.words)
        total = per_row(value[self.idx], self.ptr) + np.bincount(self.between_row, ratio[self.between], n_texts)
        n = per_row(size[self.idx], self.ptr) + np.bincount(self.between_row, minlength=n_texts)
        return total / np.maximum(n, 1)

    def scores_without(self, raw: np.ndarray, good: np.ndarray, own: np.ndarray) -> np.ndarray:
        """What scores() would be for each text if it weren't among the trusted ones; those that ``own`` marks are counted in ``good``."""
        n_texts = len(own)
        order = np.argsort(self.owner, kind="stable")
        places, ptr = csr(np.bincount(self.owner, minlength=self.words), self.idx)
        row = np.r_[np.repeat(self.row, np.diff(ptr)), self.between_row]
        pair, times = np.unique(row * BUCKETS + np.r_[self.own[order][places], self.between], return_counts=True)
        row, bucket = pair // BUCKETS, pair % BUCKETS
        n = np.bincount(row, times, n_texts)
        value = np.log((good[bucket] - times * own[row]) / raw[bucket]) - np.log((good.sum() - n * own) / raw.sum())[row]
        return np.bincount(row, value * times, n_texts) / np.maximum(n, 1)


def labelled_ids(labels: DataFrame, value: int, label: str = "quality") -> DataFrame:
    """doc_id of all rows with that label (1 is good), each once; an id with both labels is good."""
    rows = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(label).alias("label")).where(F.col("label") == value)
    return small(rows.select("doc_id"), "trusted" if value else "distrusted")


def counted(docs: DataFrame, trusted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket, with the prior: raw, of all documents, and of the target, all that are trusted.

    Each task sends a row per bucket, the driver receives one per bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in slices(batches):
            g = Grams(b.column("text"))
            raw += g.counts(np.ones(b.num_rows, bool))
            marked = pc.fill_null(b.column("trusted"), False).to_numpy(zero_copy_only=False)
            if marked.any():
                good += g.counts(marked)
        seen = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(seen), pa.array(raw[seen]), pa.array(good[seen])], ["bucket", "raw", "good"])

    joined = docs.join(trusted.withColumn("trusted", F.lit(True)), "doc_id", "left")
    rows = joined.mapInArrow(run, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()
    raw, good = np.full(BUCKETS, PRIOR), np.full(BUCKETS, PRIOR)
    for r in rows:
        raw[r["bucket"]] += r["raw"]
        good[r["bucket"]] += r["good"]
    return raw, good


def log_ratio(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The log ratio of each bucket, target against raw; 0 without trusted rows."""
    if good.sum() == BUCKETS * PRIOR:
        return np.zeros(BUCKETS)
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def fence(bins: dict[int, int]) -> float:
    """``FENCE`` spreads below the median, from counts of scores by bin; without scores -inf."""
    total, seen, at = sum(bins.values()), 0, []
    wanted = [0.01 * total, 0.5 * total]
    for k in sorted(bins):
        seen += bins[k]
        while len(at) < 2 and seen >= wanted[len(at)]:
            at.append(k * BIN)
    return at[1] - FENCE * (at[1] - at[0]) if total else -np.inf


def reach(bins: dict[int, int]) -> float:
    """The threshold from the trusted rows' scores alone: ``fence``, or ``REACH`` if that is higher.

    A spread of few trusted rows is wide, as each is scored with the counts of
    few others; ``fence`` then lies below all that a text can score.
    """
    if not bins:
        return -np.inf
    order = sorted(bins)
    median = order[int(np.searchsorted(np.cumsum([bins[k] for k in order]), 0.5 * sum(bins.values())))]
    return max(fence(bins), (median - REACH * (median - order[0])) * BIN)


def cut(good: dict[int, int], bad: dict[int, int]) -> float:
    """The threshold from counts of scores by bin, of the trusted rows and of those labelled as not good.

    ``reach``, unless other thresholds leave fewer labelled rows on the wrong
    side, by ``SLACK`` of those not good; then the middle of the widest stretch
    of thresholds that leave fewest.  There a trusted row counts as a row not
    good, and all trusted rows as all those, at least.  Without trusted rows none
    is rejected; where nothing is better than rejecting none, labels of rows not
    good tell nothing and ``reach`` stands.
    """
    if not good:
        return -np.inf
    at = np.array(sorted({*good, *bad}))
    g, b = (np.array([bins.get(k, 0) for k in at.tolist()]) for bins in (good, bad))
    # Threshold i rejects the first i bins.
    wrong = np.r_[0, np.cumsum(g)] * max(g.sum(), b.sum()) + (b.sum() - np.r_[0, np.cumsum(b)]) * g.sum()
    best, alone = np.flatnonzero(wrong == wrong.min()), reach(good)
    if best[0] == 0 or wrong[np.searchsorted(at, alone / BIN - 0.5)] - wrong.min() <= SLACK * g.sum() * b.sum():
        return alone
    low, high = (at[best - 1] + 1) * BIN, at[best] * BIN
    k = int(np.argmax(high - low))
    return float(low[k] + high[k]) / 2


def threshold(docs: DataFrame, trusted: DataFrame, distrusted: DataFrame, raw: np.ndarray, good: np.ndarray) -> float:
    """Below this score documents are rejected: ``cut`` of all labelled rows that pass the base rules.

    Each is scored as if it weren't trusted, like most documents to be judged.
    """
    labelled = docs.join(trusted.withColumn("trusted", F.lit(True)), "doc_id", "left").join(distrusted.withColumn("distrusted", F.lit(True)), "doc_id", "left")
    scores = judged(labelled.where("trusted or distrusted"), (raw, good), own="trusted").where("not base_failed")
    rows = scores.groupBy("trusted", F.floor(F.col("llr") / BIN).alias("bin")).count().collect()
    return cut({r["bin"]: r["count"] for r in rows if r["trusted"]}, {r["bin"]: r["count"] for r in rows if not r["trusted"]})


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, float]:
    """The log ratio of each bucket, and the threshold."""
    rows, trusted = texts(docs, doc_id=doc_id, text=text), labelled_ids(labels, 1, label)
    raw, good = counted(rows, trusted)
    return log_ratio(raw, good), threshold(rows, trusted, labelled_ids(labels, 0, label), raw, good)


def repeated_words(idx: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Of each text, the words in windows of ``WINDOW`` words that occur twice or more in it."""
    n = len(idx) - WINDOW + 1
    if n <= 0:
        return np.zeros(len(ptr) - 1, np.int64)
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    start = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    if not len(start):
        return np.zeros(len(ptr) - 1, np.int64)
    key = row[start].astype(np.uint64)
    for k in range(WINDOW):
        key = mix(key * _FACTOR + idx[start + k].astype(np.uint64))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = start[order[np.r_[False, same] | np.r_[same, False]]]
    cover = np.zeros(len(idx) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    return per_row((np.cumsum(cover[:-1]) > 0).astype(np.int64), ptr)


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    return len(lines) - len(set(lines))


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"


def judged(docs: DataFrame, ratio: np.ndarray | tuple[np.ndarray, np.ndarray], *, text: str = "text", own: str | None = None, least: float = -np.inf, into: str | None = None) -> DataFrame:
    """``docs`` with the counts, base_failed, kept (not failed, and llr at ``least``) and llr of each whole text.

    With a pair (raw, good) of counts for ``ratio``, each text is scored without
    its own counts in ``good``; with ``own``, a column of that name is true for
    the texts that are counted there.  With ``into``, ``docs`` gets one column of that name, a struct of these.  A
    null or empty text has no words: its counts and llr are 0 and it fails the
    base rules.  Rows with equal texts get equal verdicts; a text counts whole,
    whatever its length.
    """

    def make():
        def f(text_: pa.Array, batch: pa.RecordBatch) -> list[pa.Array]:
            w = Words(text_)
            n_words = np.diff(w.ptr)
            chars = per_row(pc.utf8_length(w.uniq).to_numpy(zero_copy_only=False).astype(np.int64)[w.idx], w.ptr)
            symbols = pc.count_substring_regex(text_, "[#*$%&|<>]").cast(pa.int64())
            lines = pa.array([duplicate_lines(x) for x in text_.to_pylist()], pa.int64())
            repeat = repeated_words(w.idx, w.ptr)
            failed = (n_words < LEAST_WORDS) | (100 * repeat > REPEAT_PERCENT * n_words)
            if isinstance(ratio, tuple):
                marked = pc.fill_null(batch.column(own), False).to_numpy(zero_copy_only=False) if own else np.ones(len(text_), bool)
                llr = Grams(text_).scores_without(*ratio, marked)
            else:
                llr = Grams(text_).scores(ratio, len(text_))
            found = [pa.array(n_words), pa.array(chars), symbols, lines, pa.array(repeat), pa.array(failed), pa.array(~failed & (llr >= least)), pa.array(llr)]
            return [pa.StructArray.from_arrays(found, [x.split()[0] for x in FIELDS.split(",")])] if into else found

        return f

    return extended(docs, f"`{into}` struct<{FIELDS.replace(' ', ':').replace(',:', ', ')}>" if into else FIELDS, make, text=text)


def verdicts(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the columns of judged(): a row per row of ``docs``; an empty table gives none.

    Rows that share a doc_id are documents of their own, all trusted if that id
    is labelled good; other columns are not read.
    """
    ratio, least = fit(docs, labels, doc_id=doc_id, text=text)
    return judged(texts(docs, doc_id=doc_id, text=text), ratio, least=least).drop("text")
