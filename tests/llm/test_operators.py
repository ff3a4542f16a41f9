import hashlib
import random
import re
import string
import time
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cdsloom.llm import byte_bpe, html_text, licenses, near_dedup, packing, pages_model, quality, queries, token_counts, topk, toxicity
from cdsloom.llm.encoders import vocabulary

SMALL = "/root/testdata/sf0.001"
PATH = vocabulary("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " ", "\n", "a", "word", "Hello  world,\n\nit's 12\t3 \n", "x" * 5000, "no end here \x1c ok", "<|endoftext|>a <|endoftext|>", "日本語 テスト", "🎉🎉 party 🎉", "a b c d e " * 400, "line\nline\nline\n \n",
    "All rights reserved. CC BY cc-by", "licensed under the GNU General Public License, version 3. all rights reserved", "This work is licensed under the GNU General Public License, version 3.", "| a | b # $ <x> &"
]


def frame(spark, texts=TEXTS, name="doc_id"):
    rows = [(k, t, 1, "x", 0.5) for k, t in enumerate(texts)] + [(None, "no id", 2, "y", 0.1), (4, "a", 1, "x", 0.5)]
    return spark.createDataFrame(rows, f"{name} long, text string, n_words int, ids string, score double").repartition(3)


def rows_of(texts=TEXTS):
    return [*enumerate(texts), (None, "no id"), (4, "a")]


def by(rows):
    return sorted(rows, key=str)


def test_byte_bpe_is_the_librarys(spark):
    t = Tokenizer.from_file(PATH)
    want = []
    for d, x in rows_of():
        ids = t.encode(x or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert by(map(tuple, queries.recoded(frame(spark)).collect())) == by(want)
    whole = byte_bpe.decoded(byte_bpe.encoded(frame(spark), vocabulary=PATH), vocabulary=PATH).collect()
    assert by((r.doc_id, r.decoded) for r in whole) == by((d, x or "") for d, x in rows_of())
    assert queries.recoded(frame(spark).limit(0)).collect() == []


def test_long_texts(spark):
    """Whole texts of some MB: what stands at their end counts."""
    text = "Some words, again and again 12 times. " * 90_000 + "\nlast line <|endoftext|>"
    docs = spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")
    got = {r.doc_id: r for r in byte_bpe.decoded(byte_bpe.encoded(docs, vocabulary=PATH), vocabulary=PATH).collect()}
    e = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False)
    assert got[1].decoded == text and np.frombuffer(got[1].ids, "<u2").tolist() == e.ids
    rows = {r.section: r for r in token_counts.attributed(docs.where("doc_id = 1"), vocabulary=PATH).collect()}
    assert len(rows) == 2 and rows[0].n_tokens + rows[1].n_tokens == len(e.ids) and rows[1].end == len(text)
    labels = spark.createDataFrame([(2, 1)], "doc_id long, quality int").selectExpr("*", "0 as toxic")
    (r,) = quality.verdicts(docs, labels).where("doc_id = 1").collect()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(text)
    assert toxicity.verdicts(docs, labels).count() == 2
    assert {r.doc_id: r.component_id for r in near_dedup.linked(docs.union(docs.selectExpr("doc_id + 5", "text")), words=2).collect()} == {1: 1, 6: 1, 2: 2, 7: 2}


def test_byte_bpe_random_texts():
    import pyarrow as pa

    t, e, rng = Tokenizer.from_file(PATH), byte_bpe.ByteEncoder.of(PATH), random.Random(3)
    parts = ["a", "the", "é", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "!!", "12", "日本", "　", "<|endoftext|>", "\x85", "🎉", "\r\n", "don't", "ſ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    ids, ptr = e.encode(pa.array(texts))
    for k, x in enumerate(texts):
        assert ids[ptr[k] : ptr[k + 1]].tolist() == t.encode(x, add_special_tokens=False).ids


def test_token_counts(spark):
    t = Tokenizer.from_file(PATH)
    want = []
    for d, x in rows_of():
        x = x or ""
        starts = [0, *(m.end() for m in re.finditer("\n", x) if m.end() < len(x))]
        spans = t.encode(x, add_special_tokens=False).offsets
        own = [max(k for k, s in enumerate(starts) if s <= a) for a, _ in spans]
        last = [max(k for k, s in enumerate(starts) if s <= max(a, b - 1)) for a, b in spans]
        for k, s in enumerate(starts):
            want.append((d, k, s, [*starts, len(x)][k + 1], own.count(k), sum(o == k < e for o, e in zip(own, last))))
    got = token_counts.attributed(frame(spark), vocabulary=PATH).collect()
    assert by(map(tuple, got)) == by(want)
    assert token_counts.attributed(frame(spark).limit(0), vocabulary=PATH).collect() == []


def brute_quality(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = {}
    for k in range(len(w) - 4):
        windows.setdefault(tuple(w[k : k + 5]), []).append(k)
    repeat = {i for ks in windows.values() if len(ks) > 1 for k in ks for i in range(k, k + 5)}
    failed = len(w) < 10 or 100 * len(repeat) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat), failed


def test_quality_base_and_ratio(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(string.ascii_lowercase[:8]) for _ in range(rng.randint(1, 3)))
    good = [" ".join(word() for _ in range(200)) for _ in range(60)]
    bad = ["!! ".join(word().upper() for _ in range(200)) for _ in range(30)]
    texts = [*TEXTS, *good, *bad]
    labels = spark.createDataFrame([(k, int(k < len(TEXTS) + 60), "x") for k in range(len(TEXTS), len(texts), 2)] + [(None, 1, "x"), (5, None, "x")], "doc_id long, quality int, text string")
    got = {r.doc_id: r for r in quality.verdicts(frame(spark, texts), labels).collect() if r.doc_id not in (4, None)}
    for k, t in enumerate(texts):
        if k != 4:
            r = got[k]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t)
            assert not (r.kept and r.base_failed)
    assert all(got[k].kept for k in range(len(TEXTS), len(TEXTS) + 60))
    assert not any(got[k].kept for k in range(len(TEXTS) + 60, len(texts)))
    none = quality.verdicts(frame(spark, texts), labels.limit(0)).collect()
    assert all(r.llr == 0 and r.kept != r.base_failed for r in none)
    assert quality.verdicts(frame(spark).limit(0), labels).collect() == []


def test_quality_ratio_by_hand(spark):
    texts = ["a b a", "b c", "!! !! d"]
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ratio, _ = quality.fit(docs, labels)
    grams = []
    for t in texts:
        h = [int(x) for x in quality.hash_words(t.split())]
        pairs = [int(quality.Grams.pair(np.array([a], np.uint64), np.array([b], np.uint64))[0]) for a, b in zip(h, h[1:])]
        grams.append([x % quality.BUCKETS for x in h] + pairs)
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for k, g in enumerate(grams):
        np.add.at(raw, g, 1)
        if not k:
            np.add.at(target, g, 1)
    assert np.allclose(ratio, np.log(target / target.sum()) - np.log(raw / raw.sum()))
    got = {r.doc_id: r.llr for r in quality.judged(docs, ratio).collect()}
    assert all(abs(got[k] - ratio[g].mean()) < 1e-9 for k, g in enumerate(grams))
    # Without its own counts in the target, a text scores as if it weren't trusted.
    got = quality.judged(docs.where("doc_id = 0"), (raw, target)).first().llr
    for g in grams[:1]:
        np.add.at(target, g, -1)
        assert abs(got - (np.log(target / target.sum()) - np.log(raw / raw.sum()))[g].mean()) < 1e-9


def test_quality_threshold():
    rng = np.random.default_rng(3)
    x = np.sort(rng.normal(size=1000)) / 20
    bins = dict(zip(*np.unique(np.floor(x / quality.BIN).astype(int), return_counts=True)))
    want = x[499] - quality.FENCE * (x[499] - x[9])
    assert abs(quality.fence({int(k): int(n) for k, n in bins.items()}) - want) < 0.02
    assert quality.fence({}) == -np.inf and quality.fence({7: 1}) == 7 * quality.BIN


def test_quality_threshold_does_its_work():
    """Few trusted rows have a wide spread; the threshold must not lie below all that a text can score."""
    good = {k: 1 for k in range(-490, -60, 6)}  # sf0.001 has such scores
    junk = {k: 1 for k in range(-1680, -1400, 50)}
    assert quality.fence(good) < -1.68 < -1.4 < quality.cut(good, junk) < -0.49
    assert quality.cut(good, {}) == quality.cut(good, {-100: 3}) == quality.reach(good) and -1.4 < quality.reach(good) < -0.49
    # A trusted row that is junk doesn't keep the rest of it in.
    odd = good | {-1550: 1}
    assert quality.reach(odd) < -1.68 and -1.4 < quality.cut(odd, junk) < -0.49
    # A few rows not good among the trusted ones don't draw it there.
    many = {k: 40 for k in good}
    assert quality.cut(many, {-1500: 200, -480: 5}) == quality.reach(many)
    # Wherever the labels decide, no threshold leaves fewer on the wrong side.
    rng = np.random.default_rng(5)
    for _ in range(200):
        g = {int(k): int(n) for k, n in zip(rng.integers(-300, 100, 20), rng.integers(1, 9, 20))}
        b = {int(k): int(n) for k, n in zip(rng.integers(-600, 0, 20), rng.integers(1, 9, 20))}
        weigh = max(1, sum(b.values()) / sum(g.values()))
        wrong = lambda t: weigh * sum(n for k, n in g.items() if (k + 0.5) * quality.BIN < t) + sum(n for k, n in b.items() if (k + 0.5) * quality.BIN >= t)  # noqa: B023, E731
        best, got = min(wrong(k * quality.BIN) for k in range(-601, 102)), quality.cut(g, b)
        if got != quality.reach(g):
            assert abs(wrong(got) - best) < 1e-6
        elif wrong(-9) > best + 1e-6:
            assert wrong(got) <= best + quality.SLACK * sum(b.values()) + 1e-6
    assert quality.cut({}, junk) == -np.inf and quality.cut({}, {}) == -np.inf


def test_quality_rejects_on_few_documents(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{x}.parquet") for x in ("documents", "labels"))
    label = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality.verdicts(docs, labels).collect() if not r.base_failed]
    # Without the labels of rows not good the trusted ones decide.
    alone = [r for r in quality.verdicts(docs, labels.where("quality = 1")).collect() if not r.base_failed]
    for found in (rows, alone):
        assert {label.get(r.doc_id) for r in found if r.kept} == {1, None} and len([r for r in found if label.get(r.doc_id) == 0]) == 6
        assert all(r.kept for r in found if label.get(r.doc_id) == 1)
    # One trusted row is junk, a table of words with bars: the labels of those not good put the threshold right.
    odd = 148
    assert label[odd] == 0 and odd in {r.doc_id for r in rows}
    told = labels.selectExpr("doc_id", f"if(doc_id = {odd}, 1, quality) as quality")
    found = [r for r in quality.verdicts(docs, told).collect() if not r.base_failed and label.get(r.doc_id) is not None and r.doc_id != odd]
    assert all(r.kept == (label[r.doc_id] == 1) for r in found)


@pytest.mark.parametrize("broadcast", [10 << 20, -1])
def test_quality_counts_all_trusted_rows(spark, broadcast):
    n = 5000
    docs = spark.createDataFrame([*((k, "a") for k in range(n)), (n, "b"), (0, "b"), (None, "b")], "doc_id long, text string")
    # Labels of rows that aren't in the table take no places; a row labelled twice counts once.
    labels = spark.createDataFrame([*((k, 1) for k in range(2 * n) if k != n), (0, 1), (1, 0), (n, 0), (n, None), (None, 1)], "doc_id long, quality int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        ratio, _ = quality.fit(docs, labels)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    a, b = (int(x) % quality.BUCKETS for x in quality.hash_words(["a", "b"]))
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    raw[a], raw[b], target[a], target[b] = n + 1, 4, n + 1, 2
    assert np.allclose(ratio, np.log(target / target.sum()) - np.log(raw / raw.sum()))


def test_toxicity(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 5)))
    texts, label = [], []
    for k in range(400):
        w = [word() for _ in range(rng.randint(20, 200))]
        if k % 5 == 0:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["vile,", "Nasty", "brutexx" + rng.choice("abc"), "brute" + word()])
        texts.append(" ".join(w))
        label.append(int(k % 5 == 0))
    base = len(TEXTS)
    labels = spark.createDataFrame([(base + k, y, 9.9) for k, y in enumerate(label)] + [(None, 1, 0.0), (base, None, 0.0), (base, 1, 0.0)], "doc_id long, toxic int, score double")
    docs = frame(spark, [*TEXTS, *texts])
    got = toxicity.verdicts(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.doc_id >= base]
    assert {r.doc_id for r in got if r.held_out} == {k for k in range(base + 400) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([r.predicted == label[r.doc_id - base] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(not r.predicted for r in got if r.doc_id is not None and r.doc_id < base and r.doc_id not in (7,))
    assert all(r.score < 0.01 for r in toxicity.verdicts(docs, labels.limit(0)).collect())
    assert toxicity.verdicts(docs.limit(0), labels).collect() == []


def plain_ftrl(rows):
    """FTRL-proximal, a coordinate at a time; the last one is the bias, without an L1 penalty."""
    seen = {}
    for x, _ in rows:
        for f in x.tolist():
            seen[f] = seen.get(f, 0) + 1
    names = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= toxicity.LEAST_TEXTS))}
    z, n = [0.0] * (len(names) + 1), [0.0] * (len(names) + 1)

    def weight(i):
        l1 = 0.0 if i == len(names) else toxicity.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * l1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(11)
    for _ in range(toxicity.EPOCHS):
        for k in order.permutation(len(rows)):
            x, y = rows[k]
            own = [names[f] for f in x.tolist() if f in names] + [len(names)]
            w = [weight(i) for i in own]
            g = 1 / (1 + np.exp(-max(-30, min(30, sum(w))))) - y
            for i, v in zip(own, w):
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA
                z[i] += g - sigma * v
                n[i] += g * g
    return {f: weight(i) for f, i in names.items() if weight(i)}, weight(len(names))


def test_training_is_ftrl_and_scores_are_its_sums(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(rng.randint(0, 25))) + rng.choice(["", " vile word", " nasty"]) for _ in range(120)]
    import pyarrow as pa

    x = list(toxicity.features(pa.array(texts)))
    rows = [(f, int("vile" in t or "nasty" in t)) for f, t in zip(x, texts)]
    names, weights, bias = toxicity.train(rows)
    want, own_bias = plain_ftrl(rows)
    assert dict(zip(names.tolist(), weights.tolist())) == pytest.approx(want)
    logit = [own_bias + sum(want.get(f, 0) for f in set(x_.tolist())) for x_ in x]
    low, high = np.quantile([v for v, (_, y) in zip(logit, rows) if not y], toxicity.QUANTILES[0]), np.quantile([v for v, (_, y) in zip(logit, rows) if y], toxicity.QUANTILES[1])
    shift = max(low + toxicity.SHARE * (high - low), own_bias + 0.5)
    assert bias == pytest.approx(own_bias - shift)
    got = {r.k: r.score for r in toxicity.scored(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), (names, weights, bias)).collect()}
    assert [got[k] for k in range(len(texts))] == pytest.approx([1 / (1 + np.exp(-(v - shift))) for v in logit])


def test_training_sample_is_bounded(spark):
    assert toxicity.within({5: 3, 1: 3, 2: 10, 9: 1}, 7) == [9, 1, 5] and toxicity.within({1: 5}, 4) == []
    docs = spark.createDataFrame([(k, ("vile " if k % 2 else "kind ") * 3 + "word " * (9 if k < 40 else 0) + " ".join(f"w{j}" for j in range(3000 if k >= 40 else 0))) for k in range(44)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(44)], "doc_id long, toxic int")
    few, all_ = toxicity.fit(docs, labels, features_at_most=2000), toxicity.fit(docs, labels)
    assert len(few[0]) and len(all_[0])


def test_only_the_model_comes_to_the_driver(spark, monkeypatch):
    import pyarrow as pa

    texts = [("vile " if k % 2 else "kind ") * 3 + " ".join(f"w{k * 2000 // 3 + j}" for j in range(2000)) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    got, collect = [], type(docs).collect

    def kept(self):
        rows = collect(self)
        got.append(sum(len(v) for r in rows for v in r if isinstance(v, bytes | bytearray)))
        return rows

    monkeypatch.setattr(type(docs), "collect", kept)
    names, weights, bias = toxicity.fit(docs, labels)
    assert sum(got) == names.nbytes + weights.nbytes < 100_000
    learn = [k for k in range(40) if zlib.crc32(str(k).encode()) % 5]
    want = toxicity.train([(x, k % 2) for k, x in zip(learn, toxicity.features(pa.array([texts[k] for k in learn])))])
    assert names.tolist() == want[0].tolist() and weights.tolist() == want[1].tolist() and bias == want[2]


def test_training_holds_the_sample_once():
    import tracemalloc

    rng = np.random.default_rng(6)
    common = rng.choice(1 << 32, 3000, replace=False).astype(np.uint32)
    rows = [(np.unique(np.r_[rng.choice(common, 500), rng.integers(0, 1 << 32, 100_000).astype(np.uint32), np.uint32(2**32 - 1 - k // 10)]), k % 2) for k in range(40)]
    seen, times = np.unique(np.concatenate([x for x, _ in rows]), return_counts=True)
    assert toxicity.frequent([x for x, _ in rows]).tolist() == seen[times >= toxicity.LEAST_TEXTS].tolist()
    assert toxicity.frequent([]).tolist() == toxicity.frequent([common[:0]]).tolist() == []
    tracemalloc.start()
    toxicity.train(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 0.5 * sum(x.nbytes for x, _ in rows)


def test_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = queries.op7_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    assert sum(r.toxic == r.predicted for r in got) / len(got) > 0.97


@pytest.mark.parametrize("rows", [0, 3, 400])
def test_topk(spark, rows):
    rng = np.random.default_rng(rows)
    v = rng.normal(size=(rows, 64)).astype("f4")
    v[rows // 2 :] = v[: rows - rows // 2] * rng.choice([1, 1, 1, 1, -1], (rows - rows // 2, 64))
    v[: rows // 4] = v[:1]
    v[rows // 3 : rows // 3 + 2, 5:9] = [[np.nan, -0.0, 0.0, -np.inf]]
    data = [(k * 5, x.tolist(), 1) for k, x in enumerate(v)] + [(7, None, 1), (None, [1.0] * 64, 1), (9, [None] * 64, 2)]
    got = topk.nearest(topk.sign_codes(spark.createDataFrame(data, "vec_id long, embedding array<float>, code int")), k=4).collect()
    want = []
    for q in range(0, rows, 4):
        near = sorted((int(((v[q] < 0) != (v[k] < 0)).sum()), k * 5) for k in range(rows) if k != q)[:4]
        want += [(q * 5, r + 1, i, d) for r, (d, i) in enumerate(near)]
    assert by(map(tuple, got)) == by(want)


def test_topk_split_groups(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 3)
    test_topk(spark, 400)


def test_topk_widths(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(300, 32)).astype("f4")
    vectors = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>")
    for segments in (4, 8):
        got = topk.nearest(topk.sign_codes(vectors, width=32), k=3, width=32, segments=segments).collect()
        want = [(q, r + 1, i, d) for q in range(0, 300, 20) for r, (d, i) in enumerate(sorted((int(((v[q] < 0) != (v[k] < 0)).sum()), k) for k in range(300) if k != q)[:3])]
        assert by(map(tuple, got)) == by(want)
    with pytest.raises(Exception, match="has 32 components, not 64"):
        topk.sign_codes(vectors).collect()
    with pytest.raises(ValueError):
        topk.nearest(topk.sign_codes(vectors), segments=7)


def test_radii_cover_all_nearer_codes():
    rng = np.random.default_rng(1)
    for step in range(1, 40):
        r = topk.radii(step, 8)
        assert sum(x + 1 for x in r) == step and max(r) - min(r) <= 1
        # A code that no segment finds is further away in each: by ``step`` at least.
        assert all((x > y for x, y in zip(d, r))) <= (sum(d) >= step) if (d := rng.integers(0, 9, 8).tolist()) else True


def test_licenses_base(spark):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    phrases = [(p.split(), x) for p, x in licenses.PHRASES.items()]
    got = licenses.scanned(frame(spark)).collect()
    want = []
    for d, x in rows_of():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(lower))
        at = [(k, name) for p, name in phrases for k in range(len(w)) if w[k : k + len(p)] == p]
        want.append((d, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({n for _, n in at}))))
    assert by((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == by(want)
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) for r in got)
    assert licenses.scanned(frame(spark).limit(0)).collect() == []


def test_licenses_templates(spark):
    long = licenses.TEMPLATES[0][1]
    cut = long.replace("including without limitation the rights to use", "with rights to use").upper()
    rows = [(0, "foo bar " * 50 + cut + " baz" * 9), (1, "Released, under: the MIT\nLicense"), (2, long[:60]), (3, "the software of the copies")]
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].labels for k in range(4)] == ["mit", "mit", "", ""]
    assert got[0].spans[0].start == 100 and 0.8 <= got[0].score < 1 and got[1].score == 1
    assert 0 < got[2].score < 0.8


def test_automaton_against_brute_force():
    rng = random.Random(4)
    sequences = [[rng.randint(1, 4) for _ in range(rng.randint(1, 25))] for _ in range(6)]
    a = licenses.Automaton(sequences)
    for _ in range(60):
        doc = [rng.randint(1, 5) for _ in range(60)]
        has = lambda x: any(s[k : k + len(x)] == x for s in sequences for k in range(len(s)))
        stat = [max(n for n in range(k + 2) if n == 0 or has(doc[k + 1 - n : k + 1])) for k in range(len(doc))]
        want = {(k + 1, n) for k, n in enumerate(stat) if n >= licenses.SHORTEST and (k + 1 == len(doc) or stat[k + 1] <= n)}
        found = a.matches(doc, 0)
        assert {(d, n) for d, n, _ in found} == want
        for d, n, state in found:
            ends = [(i, k, s[k] if k < len(s) else None) for i, s in enumerate(sequences) for k in range(n, len(s) + 1) if s[k - n : k] == doc[d - n : d]]
            assert sorted(a.places(state), key=str) == sorted(ends, key=str)
            up = a.link[state]
            assert sorted([*a.places(state), *a.further(state)], key=str) == sorted(a.places(up), key=str)
    # As many places as prefixes, however often a run repeats.
    assert len(licenses.Automaton([[1] * 5000]).all) == 5000


def test_runs_of_each_template_against_brute_force():
    rng = random.Random(5)
    sequences = [[rng.randint(1, 4) for _ in range(rng.randint(1, 25))] for _ in range(6)]
    a = licenses.Automaton(sequences)
    for _ in range(60):
        doc = [rng.randint(1, 5) for _ in range(60)]
        want = []
        for k, s in enumerate(sequences):
            for d in range(1, len(doc) + 1):
                for t in range(1, len(s) + 1):
                    n = next((n for n in range(min(d, t)) if doc[d - 1 - n] != s[t - 1 - n]), min(d, t))
                    if n >= licenses.SHORTEST and (d == len(doc) or t == len(s) or doc[d] != s[t]):
                        want.append((k, d + 7, t, n))
        assert sorted(a.shared(doc, 7)) == sorted(want)


def test_licenses_chain_and_score_against_brute_force():
    rng = random.Random(9)
    vocabulary = "p q r s t".split()
    for _ in range(150):
        template = [rng.choice(vocabulary) for _ in range(rng.randint(4, 9))]
        doc = [rng.choice([*vocabulary, "z"]) for _ in range(5)] + [w for w in template if rng.random() < 0.9] + [rng.choice(vocabulary) for _ in range(5)]
        found = sorted((d, t, n) for _, d, t, n in licenses.Automaton([[vocabulary.index(w) + 1 for w in template]]).shared([vocabulary.index(w) + 1 if w != "z" else 9 for w in doc], 0))
        # The most words that runs of SHORTEST or more cover, in order in both, no more than GAP words apart: over all subsets.
        best = 0
        for mask in range(1, 1 << min(len(found), 10)):
            cover = du = tu = 0
            last = None
            good = True
            for k in (k for k in range(len(found)) if mask >> k & 1):
                d, t, n = found[k]
                if last is None:
                    cover = n
                else:
                    own = min(n, d - last[0], t - last[1])
                    if own <= 0 or d - own - last[0] > licenses.GAP or t - own - last[1] > licenses.GAP:
                        good = False
                        break
                    cover += own
                last = (d, t)
            best = max(best, cover if good else 0)
        if found and len(found) <= 10:
            assert max(c for c, *_ in licenses.chains(found)) == best
        import pyarrow as pa

        (_, _, spans), *_ = licenses.Scanner([("x", " ".join(template))]).scan(pa.array([" ".join(doc)]))
        assert (max((s for *_, s in spans), default=0) == (best / len(template) if found else 0)) or len(found) > 10


def test_licenses_whole_notices(spark):
    notices = [(k, f"intro words {t} more words", x) for k, (x, t) in enumerate(licenses.TEMPLATES)]
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(notices, "doc_id long, text string, label string")).collect()}
    assert all(x in got[k].labels.split(",") and got[k].score == 1 for k, _, x in notices)
    text = "no licence here at all, " * 200_000 + licenses.TEMPLATES[0][1]
    (r,) = licenses.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert "mit" in r.labels and r.n_words > 1_000_000 and r.spans[0].start == 1_000_000


def test_licenses_share_passages():
    lgpl3 = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."
    # The longest run goes on in the first template where the second one's ends.
    templates = [("a", "p q r s t u v w"), ("b", "x q r s t y z k l m n o")]
    text = "p q r s t u v w y z k l m n o"
    import pyarrow as pa

    spans = {licenses.TEMPLATES[k][0]: (a, b, round(s, 3)) for k, a, b, s in licenses.Scanner().scan(pa.array([lgpl3]))[0][2]}
    assert spans["lgpl"] == (0, 43, 0.955)
    spans = {templates[k][0]: (a, b, s) for k, a, b, s in licenses.Scanner(templates).scan(pa.array([text]))[0][2]}
    assert spans == {"a": (0, 8, 1.0), "b": (1, 15, 11 / 12)}


def test_licenses_repeated(spark):
    long = licenses.TEMPLATES[0][1]
    cut = long.replace("including without limitation the rights to use", "with rights to use")
    notice = "Released under the MIT License."
    # Copies with text between them, next to each other, damaged, and after one that is broken off.
    texts = [f"{long} code code {cut} {long} {' '.join(long.split()[:30])} {long}", f"{notice} " * 500, long[:60]]
    n, m = len(long.replace("/", " ").split()), len(cut.replace("/", " ").split())
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    at = n + 2 + m
    assert [(s.start, s.end) for s in got[0].spans] == [(0, n), (n + 2, at), (at, at + n), (at + n + 30, at + 2 * n + 30)]
    assert [s.share for s in got[0].spans].count(1) == 3 and got[0].labels == "mit"
    # The template 'Licensed under the MIT License' has four of five words of each.
    assert [(s.start, s.end) for s in got[1].spans if s.share == 1] == [(5 * k, 5 * k + 5) for k in range(500)]
    assert got[2].spans == [] and got[2].score > 0


def test_chains_left_between_chosen_ones():
    assert licenses.chained([(12, 12, 12), (24, 12, 12), (31, 7, 7)], 12, 0.8) == [(12, 0, 12), (12, 12, 24)]
    rng = random.Random(6)
    for _ in range(300):
        found = []
        for _ in range(rng.randint(1, 9)):
            n, d, t = rng.randint(3, 8), rng.randint(8, 50), rng.randint(8, 10)
            found.append((d, t, n))
        got = licenses.chained(found, 10, 0.5)
        assert all(a[2] <= b[1] for a, b in zip(got, got[1:]))
        best = max(c for c, *_ in licenses.chains(sorted(found)))
        assert max(c for c, *_ in got) == best
        if best >= 5:
            # No single match that is long enough is left between them.
            assert all(c >= 5 for c, *_ in got)
            for d, _, n in found:
                assert n < 5 or any(a < d and d - n < b for _, a, b in got)


def test_blocks():
    page = '<!DOCTYPE html><head><title>T</title><style>p{}</style></head><body><p>One &amp; <b>two</b>\n three<br>four<p>five<ul><li><a href="x>y">six</a><li>seven</ul><script>var x="</p>";</script><!-- no --><div>eight&nbsp;nine <table><tr><td>a<td>b</table>'
    assert [b.text for b in html_text.blocks_of(page)] == ["One & two three four", "five", "six", "seven", "eight nine", "a", "b"]
    assert html_text.blocks_of("") == [] and [b.text for b in html_text.blocks_of("<p>cut <a href='")] != []


def test_blocks_after_raw_elements():
    blocks = lambda page: [b.text for b in html_text.blocks_of(page)]
    assert blocks('<p>a</p><svg class="i"/><p>body text</p>') == ["a", "body text"]
    assert blocks('<p>a</p><svg-icon name="x"></svg-icon><title-bar></title-bar><p>body text</p>') == ["a", "body text"]
    for tag in ("svg", "template", "select", "textarea", "noscript", "iframe", "canvas", "title"):
        assert blocks(f"<p>a</p><{tag}><p>body text</p>") == ["a", "body text"], tag
        assert blocks(f"<p>a</p><{tag} x='>'>no<b>no</b></{tag} ><p>body text</p><{tag.upper()}>no</{tag}\n x><p>end</p>") == ["a", "body text", "end"], tag
    assert blocks("<p>a</p><script>var x = '<p>no</p>'") == ["a"] and blocks("<p>a</p><style>p{}") == ["a"]
    assert blocks("<p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><math/><p>b</p>") == ["If x=2 holds", "b"]
    assert blocks('<p>a<object data="f.swf"><param name="q"><p>fall back</p></object><p>b</p>') == ["a", "fall back", "b"]
    assert blocks("<p>a<xmp><b>x</b> &amp; y</xmp>b<xmp>open <p>c</p>") == ["a", "<b>x</b> &amp; y", "b", "open", "c"]


def test_labeller_gradients():
    rng = np.random.default_rng(0)
    model = pages_model.Labeller({k: w.astype(np.float64) for k, w in pages_model.Labeller().w.items()})
    lens, n = np.array([3, 1, 4]), 8
    ptr = np.arange(0, 2 * n + 1, 2)
    blocks = ((rng.integers(0, 9, 2 * n), ptr), (rng.integers(0, 9, 2 * n), ptr), rng.normal(size=(n, pages_model.NUMBERS)))
    y = rng.integers(0, 2, n).astype(float)
    # The labeller's loss is divided by the number of sequences.
    loss = lambda: -(np.log(np.where(y == 1, p := model.predict(blocks, lens), 1 - p))).sum() / len(lens)
    g = model.gradients(blocks, lens, y)
    for k, w in model.w.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), w.shape)
        keep = w[at]
        w[at] = keep + 1e-4
        up = loss()
        w[at] = keep - 1e-4
        down = loss()
        w[at] = keep
        assert abs((up - down) / 2e-4 - g[k][at]) < 1e-3 * max(1, abs(g[k][at])), k


def test_odd_pages():
    import resource

    model = html_text.Labeller(pages_model.trained())
    main = lambda page: html_text.main_texts(model, [page])[0]
    paragraph = "Some text of it here, and more of it."
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert main("<article>" + f"<p>{paragraph}</p>" * 60_000 + "</article><footer>c</footer>") == "\n".join([paragraph] * 60_000)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000
    # A tag that closes nothing costs no search.
    began = time.perf_counter()
    assert html_text.blocks_of("<b>" * 20_000 + "</i>" * 30_000 + "x")[0].text == "x"
    assert time.perf_counter() - began < 5
    # Words are told apart by all their letters.
    a, b = (html_text._words([pages_model.Block(t, ())])[0].tolist() for t in ("advertisement", "advertising"))
    assert a != b


def test_pages_accuracy(spark):
    """Against the articles' markup, which the labeller doesn't ask for."""
    raw = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()}
    got = {r.page_id: r.text for r in queries.op9_html_text(spark, "/root/testdata/sf0.1").collect()}
    right = 0
    for k, h in raw.items():
        article = re.search(r"<article>(.*?)(</article>|\Z)", h or "", re.S)
        right += got[k] == ("\n".join(b.text for b in html_text.blocks_of(article[1])) if article else "")
    assert right / len(raw) > 0.995


def test_pages(spark):
    model, rng = html_text.Labeller(pages_model.trained()), random.Random(1234)
    right = total = 0
    for _ in range(150):
        own, page = {}, ""
        for k, (piece, main) in enumerate(pages_model.drawn_page(rng)):
            page += piece if main is None else f"m{k} {piece}"
            if main is not None:
                own[f"m{k}"] = main
        blocks = html_text.blocks_of(page)
        if blocks:
            keep = model.predict(html_text.encoded(blocks), np.array([len(blocks)])) >= 0.5
            right += sum(bool(x) == own[b.text.split()[0]] for x, b in zip(keep, blocks))
            total += len(blocks)
    assert right / total > 0.98
    rows = [(1, "u", None, "n"), (1, "u", "", "n"), (2, None, "<nav><ul><li><a>menu</a></ul></nav><article><h1>Head</h1><p>Some text &amp; more\n of it.</p></article><footer>c</footer>", "n"), (None, "v", "<<<>", "n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = by(map(tuple, html_text.extracted(pages).collect()))
    assert (2, None, "Head\nSome text & more of it.", 28) in got and (1, "u", "", 0) in got and len(got) == 4
    assert html_text.extracted(pages.limit(0)).collect() == []


def test_query_pages(spark):
    raw = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in queries.op9_html_text(spark, SMALL).collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", raw[r.page_id] or "", re.S)
        assert r.text == ("\n".join(b.text for b in html_text.blocks_of(article[1])) if article else "") and r.n_chars == len(r.text)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    all_rows = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "packing"]
    toxic = {r.doc_id for r in toxicity.verdicts(docs, labels).where("predicted = 1").collect()}
    rest = docs.where(~docs.doc_id.isin(list(toxic)) if toxic else "true")
    kept = {r.doc_id for r in quality.verdicts(rest, labels).where("kept").collect()}
    rest = docs.where(docs.doc_id.isin(list(kept)))
    sets = {}
    for d in kept:
        w = [x.lower() for x in WORD.findall(all_rows[d].text or "")]
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in kept:
        for b in kept:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    single = {d for d in kept if find(d) == d}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in got} == single
    want = {r.doc_id: r.n_tokens for r in queries.stored(docs).collect()}
    assert sum(r.length for r in got) == sum(want[d] for d in single)


def test_pipeline_odd_rows(spark):
    docs = frame(spark, [*TEXTS, "some words that are long enough to stay in the end, really " * 1]).unionByName(frame(spark))
    for name in ("toxicity", "_TOXICITY", "quality", "kept", "_kept", "n", "node", "digest", "regs", "deal", "hash", "label", "trusted"):
        docs = docs.withColumn(name, docs.doc_id)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns and len(rows) <= docs.count()
        assert stage(spark, docs.limit(0), SMALL).collect() == []
    assert near_dedup.linked(docs).count() == docs.count() and packing.SIZE == 2048
