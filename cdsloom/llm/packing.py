"""Packing documents' tokens into sequences of one length.

Documents are dealt at random (by a hash) into groups of about ``group_docs``.
A group packs by itself: whole stretches of ``size`` tokens are sequences of
their own; what is left of each document goes, longest first, into the first
sequence with room, found through a tournament tree of free capacities.  Then
gaps are filled with stretches cut from the emptiest sequences, and the one
sequence that stays unfilled is cut into lengths that are powers of two, which
need no padding.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdsloom.llm.common import binary_column, mix, slices, texts
from cdsloom.llm.encoders import SLICE_BYTES, WordEncoder, with_end

SIZE, GROUP_DOCS = 2048, 4096


class FreeSpace:
    """Bins of one size; finds the first with room for an item in O(log bins).

    A node of the tournament holds the largest free capacity below it.
    """

    def __init__(self, size: int, bins: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [size] * (2 * self.leaves)

    def place(self, need: int) -> int:
        free, k = self.free, 1
        while k < self.leaves:
            k *= 2
            if free[k] < need:
                k += 1
        free[k] -= need
        found = k - self.leaves
        while k > 1:
            k //= 2
            most = max(free[2 * k], free[2 * k + 1])
            if free[k] == most:
                break
            free[k] = most
        return found


def pack(lengths: list[int], size: int = SIZE) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start in it, length); every item of 1 to ``size`` tokens is used up once."""
    order = sorted(range(len(lengths)), key=lambda k: (-lengths[k], k))
    tree = FreeSpace(size, len(lengths))
    bins: list[list[tuple[int, int, int]]] = []
    for k in order:
        at = tree.place(lengths[k])
        if at == len(bins):
            bins.append([])
        bins[at].append((k, 0, lengths[k]))
    used = [sum(x[2] for x in b) for b in bins]
    by_use = sorted(range(len(bins)), key=lambda b: (-used[b], b))
    low, high = 0, len(by_use) - 1
    while low < high:
        to, source = by_use[low], by_use[high]
        gap = size - used[to]
        if not gap:
            low += 1
        elif not bins[source]:
            high -= 1
        else:
            item, start, n = bins[source].pop()
            take = min(gap, n)
            bins[to].append((item, start + n - take, take))
            if take < n:
                bins[source].append((item, start, n - take))
            used[to] += take
            used[source] -= take
    out = []
    for b in (b for b in bins if b):
        left = sum(x[2] for x in b)
        if left == size:
            out.append(b)
            continue
        rest = list(reversed(b))
        while left:
            room = want = 1 << (left.bit_length() - 1)
            one = []
            while room:
                item, start, n = rest.pop()
                take = min(room, n)
                one.append((item, start, take))
                if take < n:
                    rest.append((item, start + take, n - take))
                room -= take
            out.append(one)
            left -= want
    return out


def packed(docs: DataFrame, *, vocabulary: str, end: int = 1, size: int = SIZE, group_docs: int = GROUP_DOCS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all ``docs``: a row per piece.

    doc_id, start (the document's tokens before the piece), length, ids
    (little-endian unsigned 32-bit), doc_tokens (with the end id), sequence_id,
    offset (of the piece in its sequence).  A null or empty text is its end id
    alone; rows that share a doc_id are documents of their own, and rows that
    repeat both are dealt to different groups like any others; a very long text
    fills sequences of its own; an empty table gives no pieces; other columns are
    not read.
    """
    rows = texts(docs, doc_id=doc_id, text=text).select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit(20)).alias("hash"))
    groups = max(1, -(-docs.count() // group_docs))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(vocabulary)
        # A row's group follows from its content, its partition and how many like it came before: a task that runs again deals alike.
        task, times = np.uint64(TaskContext.get().partitionId()), Counter()
        for b in slices(batches, most=SLICE_BYTES):
            ids, ptr = with_end(*encoder.encode(b.column("text")), end)
            hashes = b.column("hash").to_numpy()
            before = np.zeros(len(hashes), np.uint64)
            for k, h in enumerate(hashes.tolist()):
                before[k] = times[h]
                times[h] += 1
            deal = (mix(hashes.view(np.uint64) ^ mix(mix(task + np.uint64(1)) + before)) % np.uint64(groups)).astype(np.int64)
            yield pa.record_batch([pa.array(deal), b.column("doc_id"), binary_column(ids, ptr, 2)], ["deal", "doc_id", "ids"])

    def fill(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        docs_ = sorted(((-1 if d is None else d, d, np.frombuffer(x, "<u2")) for d, x in zip(group.column("doc_id").to_pylist(), group.column("ids").to_pylist(), strict=True)), key=lambda x: (x[0], x[2].tobytes()))
        whole = [(k, at) for k, (_, _, ids) in enumerate(docs_) for at in range(0, len(ids) - size + 1, size)]
        tails = [(k, len(ids) // size * size) for k, (_, _, ids) in enumerate(docs_) if len(ids) % size]
        sequences = [[(k, at, size)] for k, at in whole]
        for one in pack([len(docs_[k][2]) - at for k, at in tails], size):
            sequences.append([(tails[item][0], tails[item][1] + start, n) for item, start, n in one])
        base = key[0].as_py() << 32
        pieces = [(k, start, n, base + s, at) for s, one in enumerate(sequences) for (k, start, n), at in zip(one, np.cumsum([0, *(x[2] for x in one)]).tolist(), strict=False)]
        ptr = np.r_[0, np.cumsum([p[2] for p in pieces])].astype(np.int64)
        ids = np.concatenate([docs_[k][2][start : start + n] for k, start, n, _, _ in pieces]).astype("<u4")
        long = pa.int64()
        return pa.table(
            {
                "doc_id": pa.array([docs_[p[0]][1] for p in pieces], long), "start": pa.array([p[1] for p in pieces], long), "length": pa.array([p[2] for p in pieces], long), "ids": binary_column(ids, ptr, 4),
                "doc_tokens": pa.array([len(docs_[p[0]][2]) for p in pieces], long), "sequence_id": pa.array([p[3] for p in pieces], long), "offset": pa.array([p[4] for p in pieces], long),
            }
        )

    return rows.mapInArrow(cut, "deal long, doc_id long, ids binary").groupBy("deal").applyInArrow(fill, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
