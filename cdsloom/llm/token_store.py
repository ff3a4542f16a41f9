"""Token ids in canonical, length-limited Huffman code.

A store is a folder with two Parquet tables that any Spark reader can open:

``codebook``  id, bits: the code length of every id that occurs.  The code is
              canonical, so the lengths are all a reader needs.
``blocks``    part, block, first (ids of the part before this block), doc_ids,
              n_ids (per document), payload.

Parts follow each other in ascending order of doc_id, blocks in a part
likewise; a block holds whole documents.  A payload is: magic ``HUF1``, ids in
all, ids between checkpoints and bits (32-bit little-endian numbers each), the
bit offset of each checkpoint (the same), then the code words as big-endian
32-bit words.  Each block is decoded by itself, and within it all checkpoints
run side by side through one lookup table.

Code lengths come from the counts of all ids in the corpus by package-merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cdsloom.llm.common import binary_column, binary_items, drop, mix, new_path, slices, stash, texts
from cdsloom.llm.encoders import SLICE_BYTES, WordEncoder, with_end

#: Bits of the longest code word; the decoding table has 2 to this power entries.
MAX_BITS = 18
#: Ids between two checkpoints, and ids after which a block ends with its document.
CHECKPOINT, BLOCK_IDS = 128, 1 << 17
MAGIC = b"HUF1"


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``most`` bits (0 where the count is 0)."""
    bits = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        bits[used] = 1
        return bits
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids don't fit in code words of {most} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    w = counts[used].astype(np.int64)
    n, level, leaf = len(w), w, [np.ones(len(w), bool)]
    for _ in range(most - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([w, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        leaf.append(order < n)
    take = 2 * n - 2
    for is_leaf in reversed(leaf):
        k = int(is_leaf[:take].sum())
        bits[used[:k]] += 1
        take = 2 * (take - k)
    return bits


def canonical(bits: np.ndarray) -> np.ndarray:
    """Code words for the lengths ``bits``, in the order of length, then id."""
    codes = np.zeros(len(bits), np.uint32)
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    lens = bits[order].astype(np.int64)
    if len(order):
        top = int(lens.max())
        ends = np.cumsum(1 << (top - lens))
        codes[order] = ((ends - (1 << (top - lens))) >> (top - lens)).astype(np.uint32)
    return codes


def decoding_table(bits: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Id and length of the code word that starts each sequence of ``most`` bits."""
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    n = 1 << (most - bits[order].astype(np.int64))
    ids, lens = np.zeros(1 << most, np.uint32), np.zeros(1 << most, np.uint8)
    ids[: n.sum()] = np.repeat(order, n)
    lens[: n.sum()] = np.repeat(bits[order], n)
    return ids, lens


def encode_block(ids: np.ndarray, bits: np.ndarray, codes: np.ndarray) -> bytes:
    lens = bits[ids].astype(np.int64)
    ends = np.cumsum(lens)
    starts = ends - lens
    total = int(ends[-1]) if len(ids) else 0
    words = np.zeros(total // 32 + 2, np.uint64)
    if len(ids):
        shifted = codes[ids].astype(np.uint64) << (64 - (starts & 31) - lens).astype(np.uint64)
        word = starts >> 5
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[first]] += np.add.reduceat(shifted >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
    head = np.array([len(ids), CHECKPOINT, total], "<u4").tobytes()
    return MAGIC + head + starts[::CHECKPOINT].astype("<u4").tobytes() + words[: -(-total // 32)].astype(">u4").tobytes()


def decode_block(payload: bytes, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
    if payload[:4] != MAGIC:
        raise ValueError("not a block of Huffman code")
    n, step, _ = (int(x) for x in np.frombuffer(payload, "<u4", 3, 4))
    rows = -(-n // step)
    at = np.frombuffer(payload, "<u4", rows, 16).astype(np.int64)
    words = np.r_[np.frombuffer(payload, ">u4", offset=16 + 4 * rows), [0, 0]].astype(np.uint64)
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    most = int(len(ids)).bit_length() - 1
    mask = np.uint64(len(ids) - 1)
    out = np.empty((step, rows), np.uint32)
    last = len(pairs) - 1
    for k in range(step):
        window = (pairs[np.minimum(at >> 5, last)] >> (64 - most - (at & 31)).astype(np.uint64)) & mask
        out[k] = ids[window]
        at += lens[window]
    return out.T.reshape(-1)[:n]


def tokenized(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id, n (ids with the end id), ids (little-endian 16-bit), place: one row per document; and for each task a row with counts.

    ``place`` tells rows with equal doc_ids apart.  ``counts``, null in documents'
    rows, has the task's count of each id below 65536.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "ids", "place", "counts"]
        encoder = WordEncoder.of(path)
        counts = np.zeros(1 << 16, np.int64)
        task, rows = TaskContext.get().partitionId() << 40, 0
        for b in slices(batches, most=SLICE_BYTES):
            ids, ptr = with_end(*encoder.encode(b.column("text")), end)
            counts += np.bincount(ids, minlength=1 << 16)
            place = mix(task + rows + np.arange(b.num_rows)).view(np.int64)
            rows += b.num_rows
            yield pa.record_batch([b.column("doc_id"), pa.array(np.diff(ptr)), binary_column(ids, ptr, 2), pa.array(place), pa.nulls(b.num_rows, pa.binary())], names)
        if rows:
            yield pa.record_batch([pa.array([None], pa.int64()), pa.array([0]), pa.array([b""]), pa.array([0]), pa.array([counts.tobytes()])], names)

    return texts(docs).mapInArrow(run, "doc_id long, n long, ids binary, place long, counts binary")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """Counts of all ids below 65536: at most so many rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 16, np.int64)
        for b in batches:
            for x in b.column("counts"):
                n += np.frombuffer(x.as_buffer(), np.int64)
        seen = np.flatnonzero(n)
        yield pa.record_batch([pa.array(seen), pa.array(n[seen])], ["id", "n"])

    rows = tokens.select("counts").where("counts is not null").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << 16, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def blocks_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, ids per document, ids) of blocks: one ends with the document that brings it to ``most`` ids."""
    names, sizes, ids, n = [], [], [], 0
    for b in batches:
        own, ptr = binary_items(b.column("ids"), "<u2")
        at = 0
        while at < b.num_rows:
            # Up to the first document whose end is ``most`` ids or more from the block's start.
            end = min(int(np.searchsorted(ptr, ptr[at] + most - n, "left")), b.num_rows)
            end = max(end, at + 1)
            names.append(b.column("doc_id").slice(at, end - at))
            sizes.append(np.diff(ptr[at : end + 1]))
            ids.append(own[ptr[at] : ptr[end]].copy())
            n += int(ptr[end] - ptr[at])
            at = end
            if n >= most:
                yield pa.concat_arrays(names), np.concatenate(sizes), np.concatenate(ids)
                names, sizes, ids, n = [], [], [], 0
    if names:
        yield pa.concat_arrays(names), np.concatenate(sizes), np.concatenate(ids)


def write(docs: DataFrame, path: str, *, vocabulary: str, end: int = 1, block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text of ``docs`` (doc_id, text; a null text is empty) and write a store at ``path``.

    Documents are written in ascending order of doc_id (nulls first, equal ids
    next to each other, dealt to as many tasks as others).  A block ends with the
    document that brings it to ``block_ids`` ids, so a very long text makes a
    long block; one of over 2 GB of ids is an error.  An empty table gives a
    store without blocks.  Other columns are not read.
    """
    spark = docs.sparkSession
    tokens = stash(tokenized(docs, vocabulary, end), "tokens")
    bits = code_lengths(id_counts(tokens))
    codes = canonical(bits)
    book = [(int(i), int(bits[i])) for i in np.flatnonzero(bits)]
    spark.createDataFrame(book, "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        WordEncoder.forget()
        first = 0
        for block, (names, sizes, ids) in enumerate(blocks_of(batches, block_ids)):
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (names, pa.array(sizes, pa.int64()))]
            yield pa.record_batch([pa.array([block]), pa.array([first]), *lists, pa.array([encode_block(ids, bits, codes)])], ["block", "first", "doc_ids", "n_ids", "payload"])
            first += len(ids)

    rows = tokens.where("counts is null").select("doc_id", "ids", "place")
    blocks = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "ids").mapInArrow(run, "block long, first long, doc_ids array<long>, n_ids array<long>, payload binary")
    blocks.select(F.spark_partition_id().alias("part"), "*").write.parquet(f"{path}/blocks")
    drop(tokens)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit): a row per document.

    The codebook (at most 65536 rows) and one number for each part reach the driver.
    """
    bits = np.zeros(1 << 16, np.uint8)
    for r in spark.read.parquet(f"{path}/codebook").collect():
        bits[r["id"]] = r["bits"]
    blocks = spark.read.schema("part int, block long, first long, doc_ids array<long>, n_ids array<long>, payload binary").parquet(f"{path}/blocks")
    total = F.aggregate("n_ids", F.lit(0).cast("long"), lambda s, x: s + x)
    parts = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.max(F.col("first") + total).alias("n")).collect()}
    before, n = {}, 0
    for part in sorted(parts):
        before[part], n = n, n + parts[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(bits)
        for b in batches:
            for part, first, names, sizes, payload in zip(*(b.column(c) for c in ("part", "first", "doc_ids", "n_ids", "payload")), strict=True):
                ids = decode_block(payload.as_py(), *table)
                ptr = np.r_[0, np.cumsum(np.array(sizes.as_py(), np.int64))]
                start = before[part.as_py()] + first.as_py() + ptr[:-1]
                yield pa.record_batch([names.values, pa.array(start), pa.array(np.diff(ptr)), binary_column(ids.astype("<u4"), ptr, 4)], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, *, vocabulary: str, end: int = 1, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write a store in the shared folder and read it back; the same cases as write()."""
    path = new_path(docs.sparkSession, "store")
    write(docs, path, vocabulary=vocabulary, end=end, block_ids=block_ids)
    return read(docs.sparkSession, path)
