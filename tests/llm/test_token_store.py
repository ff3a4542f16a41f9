import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cdsloom.llm import packing, token_store
from cdsloom.llm.encoders import vocabulary

PATH = vocabulary("word_bpe_49k.json")
TEXTS = [
    "Hello world, it's  a\ttest\n", None, "", "a", "éÉ ÎLE naïve é x y z w", "word " * 3000, "x" * 5000, "12345 67 <|endoftext|>a <|startoftext|> ", "日本語 テスト ok",
    "\x1c a\x1fb \x85 c", "I'LL don't we're'd", "İstanbul ΣΑΣ Σ", "Hello world, it's  a\ttest\n", " \n ", "a&b ### $$ %%%"
]


def frame(spark):
    rows = [(i * 3 - 4, t, "en", 7) for i, t in enumerate(TEXTS)] + [(None, "no id", "xx", 1), (2, "same id again", "en", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n long").repartition(3)


def expected():
    t = Tokenizer.from_file(PATH)
    rows = [(i * 3 - 4, x) for i, x in enumerate(TEXTS)] + [(None, "no id"), (2, "same id again")]
    return [(d, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for d, x in rows]


@pytest.mark.parametrize("block_ids", [1, 40, token_store.BLOCK_IDS])
def test_store_round_trip(spark, block_ids):
    got = token_store.round_trip(frame(spark), vocabulary=PATH, block_ids=block_ids).collect()
    assert sorted((r.doc_id or -99, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((d or -99, ids) for d, ids in expected())
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])


def test_store_of_many_short_and_equal_rows(spark, tmp_path):
    n = 200_000
    docs = spark.range(n).selectExpr("if(id < 150000, 7, id) as doc_id", "if(id % 2 = 0, '', null) as text")
    token_store.write(docs, str(tmp_path / "store"), vocabulary=PATH)
    blocks = spark.read.parquet(str(tmp_path / "store/blocks")).collect()
    # Equal doc_ids are dealt to several parts.
    assert sum(len(x.doc_ids) for x in blocks) == n and len({x.part for x in blocks if 7 in x.doc_ids}) > 1
    got = token_store.read(spark, str(tmp_path / "store"))
    assert got.where("n_tokens = 1 and hex(ids) = '01000000'").select("start").distinct().count() == n
    assert got.agg({"start": "max"}).first()[0] == n - 1 and got.where("doc_id = 7").count() == 150_000


def test_blocks_end_with_documents():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    sizes = [rng.integers(0, 9, 50), np.zeros(0, int), np.zeros(7, int), rng.integers(0, 30, 20)]
    ids = [[rng.integers(0, 60_000, n).astype("<u2") for n in s] for s in sizes]
    batches = [pa.record_batch([pa.array(range(len(x)), pa.int64()), pa.array([y.tobytes() for y in x], pa.binary())], ["doc_id", "ids"]) for x in ids]
    want, block = [], []
    for doc in (y for x in ids for y in x):
        block.append(doc)
        if sum(map(len, block)) >= 25:
            want.append(block)
            block = []
    want += [block] if block else []
    got = list(token_store.blocks_of(batches, 25))
    assert [s.tolist() for _, s, _ in got] == [[len(y) for y in x] for x in want]
    assert all((i == np.concatenate(x)).all() for (_, _, i), x in zip(got, want, strict=True))


def test_long_text_is_whole(spark):
    text = "Hello, world 12 "
    docs = spark.createDataFrame([(1, "a b"), (2, text * 250_000), (3, "x" * 300_000)], "doc_id long, text string")
    one = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    got = {r.doc_id: np.frombuffer(r.ids, "<u4") for r in token_store.round_trip(docs, vocabulary=PATH).collect()}
    assert (got[2] == [*one * 250_000, 1]).all() and len(got) == 3
    pieces = packing.packed(docs, vocabulary=PATH).where("doc_id = 2").orderBy("start").collect()
    assert (np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]) == got[2]).all()


def test_store_of_nothing(spark):
    assert token_store.round_trip(frame(spark).limit(0), vocabulary=PATH).collect() == []


@pytest.mark.parametrize("n", [1, 2, 5, 40_000])
def test_code_is_prefix_free_and_limited(n):
    rng = np.random.default_rng(n)
    counts = np.zeros(50_000, np.int64)
    counts[rng.choice(50_000, n, replace=False)] = (rng.pareto(0.6, n) * 10 + 1).astype(np.int64)
    bits = token_store.code_lengths(counts)
    used = bits[bits > 0].astype(int)
    assert len(used) == n and used.max() <= token_store.MAX_BITS and (2.0**-used).sum() <= 1
    if n == 5:
        import heapq

        h = sorted(counts[counts > 0].tolist())
        cost = 0
        while len(h) > 1:
            x = heapq.heappop(h) + heapq.heappop(h)
            cost += x
            heapq.heappush(h, x)
        assert (bits.astype(int) * counts).sum() == cost
    ids = rng.choice(np.flatnonzero(bits), 3000 + n % 7)
    block = token_store.encode_block(ids, bits, token_store.canonical(bits))
    assert (token_store.decode_block(block, *token_store.decoding_table(bits)) == ids).all()


def check_pieces(pieces, want, size):
    """Every id in one piece, sequences without gaps; returns tokens and padded tokens of all sequences."""
    own, seqs = {}, {}
    for r in pieces:
        assert r.length == len(r.ids) // 4 > 0
        own.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    docs = {}
    for d, ids in want:
        docs.setdefault((d, len(ids)), []).append(tuple(ids))
    assert own.keys() == docs.keys()
    for key, texts in docs.items():
        # Rows of one doc_id and length can't be told apart: their pieces hold the same ids in all, at the same places.
        assert sorted((start + k, x) for start, ids in own[key] for k, x in enumerate(ids)) == sorted((k, x) for ids in texts for k, x in enumerate(ids))
        if len(texts) == 1:
            assert tuple(x for _, ids in sorted(own[key]) for x in ids) == texts[0]
    tokens = padded = 0
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= size
        tokens += at
        padded += at if at & (at - 1) == 0 else size
    return tokens, padded


def test_packing(spark):
    got = packing.packed(frame(spark), vocabulary=PATH, size=64, group_docs=5).collect()
    tokens, padded = check_pieces(got, expected(), 64)
    assert tokens == sum(len(ids) for _, ids in expected()) == padded


def test_packing_equal_rows(spark):
    docs = spark.createDataFrame([(1, "one two three")] * 3000, "doc_id long, text string").repartition(2)
    got = packing.packed(docs, vocabulary=PATH, size=64, group_docs=100).collect()
    ids = Tokenizer.from_file(PATH).encode("one two three", add_special_tokens=False).ids
    tokens, padded = check_pieces(got, [(1, [*ids, 1])] * 3000, 64)
    assert tokens == padded == 3000 * (len(ids) + 1)
    in_group = np.bincount([r.sequence_id >> 32 for r in got])
    assert len(in_group) == 30 and in_group.max() < 200


def test_packing_query(spark):
    from cdsloom.llm import queries

    small = "/root/testdata/sf0.001"
    want = {r.doc_id: (r.n_tokens, r.ids) for r in token_store.round_trip(spark.read.parquet(f"{small}/documents.parquet"), vocabulary=PATH).collect()}
    got = queries.op4_packing(spark, small).collect()
    seqs = {}
    for r in got:
        n, ids = want[r.doc_id]
        assert r.doc_tokens == n and r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    used = [sum(n for _, n in s) for s in seqs.values()]
    total = sum(n for n, _ in want.values())
    assert sum(used) == total
    assert all(n == 2048 or n & (n - 1) == 0 for n in used)
    # As few full sequences as can be, and the rest cut into powers of two.
    assert used.count(2048) == total // 2048 and len(used) - total // 2048 == (total % 2048).bit_count()


def test_packing_by_first_fit_alone_leaves_more(spark):
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 2048, 500).tolist()
    tree, free = packing.FreeSpace(2048, 500), {}
    for n in sorted(lengths, reverse=True):
        at = tree.place(n)
        free[at] = free.get(at, 2048) - n
    padding = sum(free.values()) / (2048 * len(free))
    sequences = packing.pack(lengths, 2048)
    assert sum(n for s in sequences for *_, n in s) == sum(lengths) and 0 < padding < 0.05
    assert sum(sum(n for *_, n in s) == 2048 for s in sequences) == sum(lengths) // 2048


def test_packing_nothing(spark):
    assert packing.packed(frame(spark).limit(0), vocabulary=PATH).collect() == []


def test_first_fit_is_first_fit():
    tree, caps = packing.FreeSpace(10, 40), []
    rng = np.random.default_rng(3)
    for need in sorted(rng.integers(1, 11, 40).tolist(), reverse=True):
        at = tree.place(need)
        brute = next((k for k, c in enumerate(caps) if c >= need), len(caps))
        if brute == len(caps):
            caps.append(10)
        caps[brute] -= need
        assert at == brute


def test_query_digest(spark):
    from cdsloom.llm import queries

    got = {r.doc_id: r for r in queries.stored(frame(spark)).collect() if r.doc_id not in (2, None)}
    for d, ids in expected():
        if d not in (2, None):
            assert got[d].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and got[d].n_tokens == len(ids)
