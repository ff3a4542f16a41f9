"""Exact top-k by Hamming distance over binary codes: incremental multi-index hashing.

Codes are cut into ``segments``; an index has a row for each segment of each
distinct code, found by the segment's whole value.  A query visits the values
within a radius of its own segment's value.  The radius grows by one, segment by
segment: once it is r + 1 in the first a segments and r in the others, every code
up to a distance of segments * (r + 1) + a - 1 has been met, for a code further
away in each segment is further away in all.  Each visit goes to values that the
query hasn't visited yet.  A query is done when its kth verified distance is
within what is covered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cdsloom.llm.common import drop, stash

WIDTH = 64
#: Segments of a code.  Best where a segment has about log2(rows) bits.
SEGMENTS = 8
#: Index rows of one value that one task holds; more are split into blocks.
BLOCK = 8192
#: Distances computed at once.
_AT_ONCE = 1 << 20


def sign_codes(vectors: DataFrame, *, width: int = WIDTH, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, code): bit k is set where component k isn't negative; NaN isn't, nor is -0.0.

    Rows without an id, without a vector or with a null component are left out.
    A vector that has not ``width`` components (64 at most) is an error: the
    job fails and names the id.  An empty table gives no codes; other columns
    are not read.
    """
    if not 1 <= width <= 64:
        raise ValueError(f"a width of {width}: codes have 1 to 64 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sizes = np.diff(b.column("vector").offsets.to_numpy())
            if (sizes != width).any():
                at = int((sizes != width).argmax())
                raise ValueError(f"vector {b.column('id')[at].as_py()} has {sizes[at]} components, not {width}")
            v = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            code = np.zeros((len(v), 64), bool)
            code[:, :width] = ~(v < 0)
            yield pa.record_batch([b.column("id"), pa.array(np.packbits(code, axis=1, bitorder="little").view("<i8").ravel())], ["id", "code"])

    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector")).where("id is not null and vector is not null").where(~F.exists("vector", lambda x: x.isNull()))
    return rows.mapInArrow(run, "id long, code long")


def radii(step: int, segments: int) -> list[int]:
    """The radius searched in each segment after ``step`` growths by one; -1: none yet."""
    return [(step - s + segments - 1) // segments - 1 for s in range(segments)]


def growths(step: int, segments: int, bounded: bool) -> int:
    """The next step: all segments at radius 0, all at radius 1, then one segment at a time.

    While some query knows no kth distance yet (``bounded`` is false), all
    segments grow at once.
    """
    return step + segments if step < 2 * segments or not bounded else step + 1


def neighbours(codes: DataFrame, queries: DataFrame, k: int, *, width: int = WIDTH, segments: int = SEGMENTS) -> DataFrame:
    """(code, found array<struct<distance, id>>): for each distinct query code its ``k`` nearest rows of ``codes``.

    Equal distances go by smallest id.  ``queries`` has a column code.
    """
    best = W.partitionBy("code").orderBy("id")
    # Of rows with one code only the k smallest ids can be among a query's k nearest; the window drops the rest before its shuffle.
    salted = codes.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    salted = salted.withColumn("rank", F.row_number().over(W.partitionBy("code", "salt").orderBy("id"))).where(f"rank <= {k}")
    ranked = salted.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}")
    classes = stash(ranked.groupBy("code").agg(F.min("id").alias("least"), F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    bits = width // segments
    masks = [[x for x in range(1 << bits) if x.bit_count() == r] for r in range(bits + 1)]
    value = lambda s: F.expr(f"cast(shiftrightunsigned(code, {s * bits}) & {(1 << bits) - 1} as int)")
    each = F.posexplode(F.array(*map(value, range(segments)))).alias("segment", "value")
    base = classes.select("code", F.col("least").alias("other"), each)
    sizes = stash(base.groupBy("segment", "value").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    base = stash(base.join(sizes, ["segment", "value"]).select("segment", "value", F.pmod(F.xxhash64("code"), "blocks").cast("int").alias("block"), F.lit(0).alias("probe"), "code", "other"), "base")
    pending = stash(queries.select("code").distinct().select("code", F.lit(width).cast("long").alias("bound")), "pending")
    seen = None
    step, bounded = 0, False
    while True:
        now = min(growths(step, segments, bounded), segments * (bits + 1))
        new = [list(range(a + 1, b + 1)) for a, b in zip(radii(step, segments), radii(now, segments), strict=True)]
        flips = [F.array(*(F.struct(F.lit(s).alias("segment"), F.lit(x).alias("flip")) for r in new[s] for x in masks[r])) for s in range(segments) if new[s]]
        values = F.array(*map(value, range(segments)))
        probes = pending.select("code", "bound", F.inline(F.concat(*flips))).select("code", "bound", "segment", F.get(values, F.col("segment")).bitwiseXOR(F.col("flip")).alias("value"))
        probes = probes.join(sizes, ["segment", "value"]).select("segment", "value", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("probe"), "code", F.col("bound").alias("other"))
        key = ["segment", "value", "block", "probe"]
        found = base.union(probes).repartition(*key[:3]).sortWithinPartitions(*key).mapInArrow(_compare(k), "code long, least long, distance int, other long")
        every = found if seen is None else found.unionByName(seen)
        order = W.partitionBy("code").orderBy("distance", "least")
        every = stash(every.distinct().withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").drop("rank"), "found")
        if seen is not None:
            drop(seen)
        seen, step = every, now
        # The kth nearest row: classes stand for as many rows as they have ids.
        running = seen.join(classes.select(F.col("code").alias("other"), F.size("ids").alias("n")), "other").withColumn("upto", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)))
        kth = running.where(f"upto >= {k}").groupBy("code").agg(F.min("distance").alias("kth"))
        left = pending.join(kth, "code", "left").select("code", F.least("bound", F.coalesce("kth", F.lit(width))).cast("long").alias("bound")).where(f"bound >= {step}")
        left = stash(left, "pending")
        drop(pending)
        pending = left
        furthest = pending.agg(F.max("bound")).first()[0]
        if furthest is None or min(radii(step, segments)) >= bits:
            break
        bounded = furthest < width
    drop(base, sizes, pending)
    rows = seen.join(classes.select(F.col("code").alias("other"), "ids"), "other").select("code", "distance", F.explode("ids").alias("id"))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("code").orderBy("distance", "id"))).where(f"rank <= {k}")
    return rows.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("found"))


def _compare(k: int):
    """Rows sorted by (segment, value, block, probe): each block's codes are held, its probes stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was, codes, leasts, code, least = None, [], [], None, None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy() for c in ("segment", "value", "block", "probe")], 1)
            own, other = b.column("code").to_numpy(), b.column("other").to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            out: list[list[np.ndarray]] = [[], [], [], []]
            for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if was != (now := tuple(key[at, :3])):
                    was, codes, leasts, code = now, [], [], None
                if not key[at, 3]:
                    codes.append(own[at:end])
                    leasts.append(other[at:end])
                    continue
                if not codes:
                    continue  # a block that no code fell to
                if code is None:
                    code, least = np.concatenate(codes), np.concatenate(leasts)
                    order = np.argsort(least)
                    code, least = code[order], least[order]
                for c, v in zip(out, _nearest(own[at:end], other[at:end], code, least, k), strict=True):
                    c.append(v)
            if out[0]:
                c, n, d, o = map(np.concatenate, out)
                yield pa.record_batch([pa.array(c), pa.array(n), pa.array(d.astype(np.int32)), pa.array(o)], ["code", "least", "distance", "other"])

    return run


def _nearest(query: np.ndarray, bound: np.ndarray, code: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, least, distance, code) of each query's ``k`` nearest within its bound; ``code`` in the order of ``least``."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    size = max(1, _AT_ONCE // len(code))
    for at in range(0, len(query), size):
        q = query[at : at + size]
        d = np.bitwise_count(q[:, None].view(np.uint64) ^ code.view(np.uint64))
        i, j = np.nonzero(d <= bound[at : at + size, None])
        d = d[i, j].astype(np.int64)
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        good = np.arange(len(i)) - np.searchsorted(i, i) < k
        for c, v in zip(out, (q[i[good]], least[j[good]], d[good], code[j[good]]), strict=True):
            c.append(v)
    return tuple(map(np.concatenate, out))


def nearest(codes: DataFrame, *, k: int = 10, every: int = 20, width: int = WIDTH, segments: int = SEGMENTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, distance: the ``k`` rows nearest to each row whose id is divisible by ``every``.

    A row isn't its own neighbour; equal codes are at distance 0; equal
    distances go by smallest id.  Rows that repeat an id and a code are that
    many rows.  With fewer rows there are fewer neighbours, and an empty table
    gives none.
    """
    if width % segments or width // segments > 16:
        raise ValueError(f"{segments} segments of {width} bits: a segment has a whole number of bits, 16 at most")
    codes = stash(codes.select("id", "code"), "codes")
    queries = codes.where(F.col("id") % every == 0)
    found = neighbours(codes, queries, k + 1, width=width, segments=segments)
    both = queries.join(found, "code").select(F.col("id").alias("query_id"), F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, k).alias("found"))
    return both.select("query_id", F.posexplode("found")).select("query_id", (F.col("pos") + 1).cast("long").alias("rank"), F.col("col.id").alias("vec_id"), F.col("col.distance").cast("long").alias("distance"))
