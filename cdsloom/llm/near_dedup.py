"""Near-duplicates by SetSketch registers.

A document's set is its distinct word shingles.  A sketch has ``REGISTERS``
registers: a register holds the smallest of exponentially distributed hashes
of the elements, on a scale of powers of ``BASE``, truncated to 16 bits.
Registers of a union are the larger of both (so sketches merge), and equal
registers become likelier with similarity (so they can be banded).

1. Equal sets are one class.  Everything below works on classes; a class is
   named by 64 bits of its set's 128-bit digest, and classes whose 64 bits are
   equal get different names.
2. Registers in bands of ``ROWS`` give buckets.  Two sets of similarity 0.8
   miss each other in all buckets with a probability of 5e-8.
3. First round: a class that shares ``SHARED`` or more buckets with their first
   class joins that one's group; the full sets of a group are shipped once, to
   one block, and the block links what is similar.
4. Second round: buckets that still hold several components compare registers
   across components (``outside``), in blocks, and tell which classes have a
   partner that the registers don't rule out; only their full sets are shipped,
   to the first bucket that the two share, and linked there.

A block estimates similarity by maximum likelihood, jointly from the numbers of
smaller, equal and larger registers and the sets' sizes, passes over pairs that
are estimated ``SLACK`` or more below the threshold (a pair of similarity 0.8
with a probability of 5e-8), verifies the rest on the full sets, the likeliest
first, and never a pair whose classes are connected already.  It returns only
links that join two components, so no table of pairs is ever made: rows grow
with the number of classes, not with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cdsloom.llm.common import Words, binary_column, by_group, csr, drop, hash_words, mix, per_row, release, slices, small, stash, texts
from cdsloom.llm.components import components

REGISTERS, ROWS, BASE, RATE = 128, 4, 1.001, 20.0
BANDS = REGISTERS // ROWS
_WIDTH = 2 * ROWS
#: An estimate may be so far below the threshold: six standard deviations.
SLACK = 0.21
#: Buckets that a class shares with the first class of a first-round group, at least.
SHARED = 3
#: What a part of a group holds: so many shingles, a class counting for ``LEAST`` at least.  Larger groups are split into parts.
PART, LEAST = 1 << 20, 1 << 10
#: Rows and shingles that a worker handles at once, and pairs whose registers it compares at once.
CHUNK_ROWS, CHUNK_SHINGLES, CHUNK_PAIRS = 4096, 1 << 21, 1 << 16
#: Bits of a digest that name a class.
NAME_BITS = 64

_ODD = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(text: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles.

    ASCII letters are lowered.  A text of fewer words is one shingle, an empty
    one has none.
    """
    w = Words(pc.ascii_lower(pc.fill_null(text, "")))
    h = hash_words(w.uniq.to_pylist())[w.idx]
    for a, b in zip(w.ptr, w.ptr[1:], strict=False):
        own = h[a:b]
        n = max(1, len(own) - words + 1)
        size = min(words, len(own))
        if not size:
            yield own
            continue
        s = np.full(n, size, np.uint64)
        for k in range(size):
            s = mix(s * _FACTOR + own[k : k + n])
        yield np.unique(s)


def registers(elements: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes."""
    least = np.full(REGISTERS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(elements), 1024):
        least = np.minimum(least, mix_each(elements[at : at + 1024]).min(0))
    share = (least.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(share, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype("<u2")


def mix_each(elements: np.ndarray) -> np.ndarray:
    """A hash for each element and register."""
    x = elements[:, None] * _ODD
    x ^= x >> np.uint64(32)
    x *= _FACTOR
    return x


def likeliest(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Estimates of similarity by maximum likelihood.

    ``larger`` and ``smaller``: registers of the first set that are so against
    the second one's; ``n_a``, ``n_b``: sizes of the sets.  The likelihood is
    concave, so its slope is halved in.
    """
    q, scale = (BASE - 1) / BASE, np.log(BASE)
    u = n_a / (n_a + n_b)
    v = 1 - u
    equal = REGISTERS - larger - smaller
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(11):
        j = (low + high) / 2
        x, y = u - v * j, v - u * j
        up, down = np.maximum(-np.log1p(-x * q) / scale, 1e-12), np.maximum(-np.log1p(-y * q) / scale, 1e-12)
        d_up, d_down = v * q / ((1 - x * q) * scale), u * q / ((1 - y * q) * scale)
        slope = equal * (d_up + d_down) / np.maximum(1 - up - down, 1e-12) - larger * d_up / up - smaller * d_down / down
        low, high = np.where(slope > 0, j, low), np.where(slope > 0, high, j)
    return (low + high) / 2


def _named(digests: list[bytes | None], bits: int) -> pa.Array:
    """The first ``bits`` bits of each digest."""
    return pa.array([None if d is None else int.from_bytes(d[:8], "little", signed=True) >> (64 - bits) for d in digests], pa.int64())


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (set size), node (bits of the set's digest), digest, regs."""
    bits = NAME_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for b in slices(batches):
            digests, regs, n = [], [], []
            for s in shingle_sets(b.column("text"), words):
                n.append(len(s))
                d = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                if d is not None and d not in known:
                    if len(known) > 20_000:
                        known.clear()
                    known[d] = registers(s).tobytes()
                digests.append(d)
                regs.append(known.get(d))
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), _named(digests, bits), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n", "node", "digest", "regs"])

    return texts(docs).mapInArrow(run, "doc_id long, n long, node long, digest binary, regs binary")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """node, digest, shingles (sorted 64-bit hashes): each set once in a task."""
    bits = NAME_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for b in slices(batches):
            sets = {xxhash.xxh3_128_digest(x): x for s in shingle_sets(b.column("text"), words) if (x := s.tobytes())}
            new = [d for d in sets if d not in known]
            known.update(new)
            yield pa.record_batch([_named(new, bits), pa.array(new, pa.binary()), pa.array([sets[d] for d in new], pa.binary())], ["node", "digest", "shingles"])

    return texts(docs).mapInArrow(run, "node long, digest binary, shingles binary")


class Twins:
    """Different classes whose digests begin alike: next to none, but each gets a name of its own."""

    def __init__(self, classes: DataFrame):
        again = classes.groupBy("node").count().where("count > 1").select("node")
        self.rows = stash(classes.join(again, "node").groupBy("node").agg(F.sort_array(F.collect_list("digest")).alias("alike")), "twins")

    def renamed(self, rows: DataFrame) -> DataFrame:
        place = F.array_position("alike", F.col("digest"))
        return rows.join(self.rows, "node", "left").withColumn("node", F.when(place > 1, F.xxhash64("node", place)).otherwise(F.col("node"))).drop("alike", "digest")


def buckets(classes: DataFrame) -> DataFrame:
    """node, band, bucket: a row for each band."""
    each = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda band: F.xxhash64(band, F.substring("regs", band * _WIDTH + 1, F.lit(_WIDTH))))
    return classes.select("node", F.posexplode(each).alias("band", "bucket"))


class Block:
    """Rows of some groups, sorted by group, and the pairs in them.

    ``own`` and ``out`` say on which side of a comparison a row stands: pairs
    are made of an ``out`` row and an ``own`` row of its group, of different
    roots and of sizes that allow the similarity.  Two rows that are both
    ``outside`` meet twice; they are a pair where the ``out`` row's node is larger.
    """

    def __init__(self, t: pa.Table, group: np.ndarray, percent: int):
        self.percent, self.group = percent, group
        self.node, self.root, self.n = (t.column(c).to_numpy() for c in ("node", "root", "n"))
        self.own, self.out, self.outside = (t.column(c).to_numpy(zero_copy_only=False) for c in ("own", "out", "outside"))
        self.regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), "<u2").reshape(-1, REGISTERS)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(row, row, estimate, bands shared) of pairs that the registers don't rule out, some at a time."""
        mine = np.flatnonzero(self.own)
        size = np.bincount(self.group[mine], minlength=int(self.group[-1]) + 1)
        outs = np.flatnonzero(self.out)
        upto = np.cumsum(size[self.group[outs]])
        least = self.percent / 100 - SLACK
        at = 0
        while at < len(outs):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 16 * CHUNK_PAIRS, "right")))
            places, ptr = csr(size, self.group[outs[at:end]])
            k, j = np.repeat(outs[at:end], np.diff(ptr)), mine[places]
            at = end
            good = (self.root[k] != self.root[j]) & (~self.outside[j] | (self.node[j] < self.node[k]))
            good &= 100 * np.minimum(self.n[k], self.n[j]) >= self.percent * np.maximum(self.n[k], self.n[j])
            k, j = k[good], j[good]
            for a in range(0, len(k), CHUNK_PAIRS):
                x, y = k[a : a + CHUNK_PAIRS], j[a : a + CHUNK_PAIRS]
                same = self.regs[x] == self.regs[y]
                near = np.flatnonzero(same.sum(1) >= REGISTERS * least - 8)
                x, y, same = x[near], y[near], same[near]
                larger = (self.regs[x] > self.regs[y]).sum(1)
                e = likeliest(larger, REGISTERS - larger - same.sum(1), self.n[x].astype(float), self.n[y].astype(float))
                keep = e >= least
                if keep.any():
                    yield x[keep], y[keep], e[keep], same[keep].reshape(-1, BANDS, ROWS).all(2)


def shipped(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """``placed`` (key columns g, task; node, ...) with what ``sets`` has of each node, the rows of a key together."""
    return placed.join(sets, "node").repartition("g", "task").sortWithinPartitions("g", "task")


def grouped(batches: Iterator[pa.RecordBatch], percent: int, shingles: bool) -> Iterator[tuple[pa.Table, Block]]:
    """Whole groups of (g, task), as many at a time as a worker takes."""
    held, rows, load = [], 0, 0
    for t in by_group(batches, ("g", "task")):
        held.append(t)
        rows += t.num_rows
        load += pc.sum(t.column("n")).as_py() if shingles else 0
        if rows >= CHUNK_ROWS or load >= CHUNK_SHINGLES:
            yield _block(held, percent)
            held, rows, load = [], 0, 0
    if held:
        yield _block(held, percent)


def _block(held: list[pa.Table], percent: int) -> tuple[pa.Table, Block]:
    t = pa.concat_tables(held).combine_chunks()
    return t, Block(t, np.repeat(np.arange(len(held)), [x.num_rows for x in held]), percent)


class Sets:
    """Full sets of a block's rows, for exact verification."""

    def __init__(self, column: pa.ChunkedArray, percent: int):
        data = [np.frombuffer(x.as_buffer(), "<u8") for x in column]
        self.percent, self.size = percent, np.array([len(x) for x in data], np.int64)
        uniq, self.ids = np.unique(np.concatenate(data), return_inverse=True)
        self.span = len(uniq)
        self.flat = self.ids + np.repeat(np.arange(len(data)), self.size) * self.span

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        swap = self.size[a] > self.size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        upto = np.cumsum(self.size[a])
        at = 0
        while at < len(a):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 20), "right")))
            places, ptr = csr(self.size, a[at:end])
            want = self.ids[places] + np.repeat(b[at:end], np.diff(ptr)) * self.span
            found = self.flat[np.minimum(np.searchsorted(self.flat, want), len(self.flat) - 1)] == want
            shared = per_row(found.astype(np.int64), ptr)
            out[at:end] = 100 * shared >= self.percent * (self.size[a[at:end]] + self.size[b[at:end]] - shared)
            at = end
        return out


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray, e: np.ndarray, similar) -> Iterator[tuple[int, int]]:
    """Rows whose link joins two components, until no pair (a, b) of different ones is left unverified.

    Each component verifies its likeliest pairs; if that leaves any, twice as many.
    """
    names, comp = np.unique(root, return_inverse=True)
    up = list(range(len(names)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    order = np.argsort(-e, kind="stable")
    a, b = a[order], b[order]
    most = 1
    while True:
        now = np.fromiter(map(find, range(len(up))), np.int64, len(up))[comp]
        open_ = now[a] != now[b]
        a, b = a[open_], b[open_]
        if not len(a):
            return
        sides = np.concatenate([now[a], now[b]])
        by = np.argsort(sides, kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by)) - np.searchsorted(sides[by], sides[by])
        rank = np.minimum(rank[: len(a)], rank[len(a) :])
        pick = rank < most
        yes = similar(a[pick], b[pick])
        for x, y in zip(a[pick][yes].tolist(), b[pick][yes].tolist(), strict=True):
            p, q = find(comp[x]), find(comp[y])
            if p != q:
                up[max(p, q)] = min(p, q)
                yield x, y
        a, b = a[~pick], b[~pick]
        most *= 2


def links(rows: DataFrame, percent: int, first_shared: bool) -> DataFrame:
    """(u, v): verified links that join components of a block; ``rows``: shipped() with full sets.

    ``first_shared``: a pair counts in the group of the first band only that it shares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, block in grouped(batches, percent, True):
            found = list(_here(t, block) if first_shared else block.pairs())
            if not found:
                continue
            a, b, e = (np.concatenate(x) for x in list(zip(*found, strict=True))[:3])
            sets = Sets(t.column("shingles"), percent)
            got = np.array(list(joined(block.root, a, b, e, sets.similar)), np.int64).reshape(-1, 2)
            if len(got):
                x, y = block.node[got[:, 0]], block.node[got[:, 1]]
                yield pa.record_batch([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def _here(t: pa.Table, block: Block):
    """Those pairs of a block whose first shared band is their group's."""
    band = t.column("band").to_numpy()
    for x, y, e, shared in block.pairs():
        here = shared.argmax(1) == band[x]
        yield x[here], y[here], e[here]


def with_partners(rows: DataFrame, percent: int) -> DataFrame:
    """g, band, node: classes that have a partner here that the registers don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, block in grouped(batches, percent, False):
            some = np.zeros(t.num_rows, bool)
            for x, y, _ in _here(t, block):
                some[x], some[y] = True, True
            at = pa.array(np.flatnonzero(some))
            yield from t.select(["g", "band", "node"]).take(at).combine_chunks().to_batches()

    return rows.mapInArrow(run, "g long, band int, node long").distinct()


def weight() -> Column:
    """What a class counts for in a part of a group."""
    return F.expr(f"greatest(n, {LEAST})")


def parts(total: Column) -> Column:
    """Parts for rows of this weight in all."""
    return F.greatest(F.ceil(total / PART), F.lit(1)).cast("int")


def around_hubs(hubs: DataFrame, sets: DataFrame) -> DataFrame:
    """The first round's groups: a hub, in all parts of its group, and the classes that chose it."""
    rows = hubs.select(F.col("hub").alias("g"), "node").union(hubs.select(F.col("hub").alias("g"), F.col("hub").alias("node")).distinct())
    rows = rows.join(sets.select("node", "n"), "node")
    sizes = rows.groupBy("g").agg(parts(F.sum(weight())).alias("parts"))
    home = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    tasks = F.when(F.col("g") == F.col("node"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(home))
    yes = F.lit(True)
    return rows.join(sizes, "g").select("g", "node", F.explode(tasks).alias("task"), F.col("node").alias("root"), yes.alias("own"), yes.alias("out"), yes.alias("outside"))


def across_components(rows: DataFrame) -> DataFrame:
    """The second round's groups: buckets that hold several components.

    ``rows``: g, band, node, n, root.  A row is outside if its root isn't its
    bucket's least one.  Outside rows are compared with all, part against part,
    so that no task has more than two parts; the others stand on one side only.
    """
    each = rows.groupBy("g", "root").agg(F.sum(weight()).alias("w"))
    mixed = each.groupBy("g").agg(F.min("root").alias("main"), F.max("root").alias("other"), parts(F.sum("w")).alias("p"), parts(F.sum("w") - F.min_by("w", "root")).alias("q"))
    rows = rows.join(mixed.where("main <> other").drop("other"), "g").withColumn("outside", F.expr("root <> main"))
    rows = rows.withColumn("a", F.pmod(F.xxhash64("node"), F.col("p")).cast("int")).withColumn("b", F.pmod(F.xxhash64("node", F.lit(1)), F.col("q")).cast("int"))
    tasks = F.expr("array_distinct(concat(transform(sequence(0, q - 1), x -> a * q + x), if(outside, transform(sequence(0, p - 1), x -> x * q + b), array())))")
    rows = rows.withColumn("task", F.explode(tasks))
    return rows.select("g", "band", "node", "task", "root", F.expr("task div q = a").alias("own"), F.expr("outside and task % q = b").alias("out"), "outside")


def linked(docs: DataFrame, *, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of shingles of ``words`` words are
    similar by ``percent`` or more; component_id is the smallest doc_id
    reachable over links, the document's own included; kept marks the document
    that has it.  Documents without words (a null or empty text) are linked
    with nothing, nor is a row without a doc_id: it is kept, with a null
    component.  Rows that share a doc_id are documents of their own.  Texts
    count whole, whatever their length; an empty table gives no rows; columns
    of ``docs`` beside the two named ones are not read and can't clash.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    signed = stash(sketched(rows, words), "sketches")
    grouped_ = signed.where("n > 0 and doc_id is not null").groupBy("node", "digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    unnamed = stash(grouped_, "classes")
    twins = Twins(unnamed)
    classes = twins.renamed(unnamed)
    release(spark)

    members = buckets(classes)
    firsts = members.groupBy("bucket").agg(F.min("node").alias("v"), F.count("*").alias("m")).where("m > 1").drop("m")
    several = stash(members.join(firsts, "bucket"), "buckets")
    release(spark)
    chosen = several.where("node <> v").groupBy("node", "v").agg(F.count("*").alias("c")).where(f"c >= {SHARED}")
    hubs = stash(chosen.groupBy("node").agg(F.max_by("v", "c").alias("hub")), "hubs")

    def sets_of(nodes: DataFrame) -> DataFrame:
        """node, n, regs, shingles of classes; each set is made from the text of one document."""
        wanted = classes.join(nodes, "node", "left_semi")
        own = rows.join(small(wanted.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi")
        sets = twins.renamed(full_sets(own, words)).groupBy("node").agg(F.first("shingles").alias("shingles"))
        out = stash(wanted.select("node", "n", "regs").join(sets, "node"), "sets")
        release(spark)
        return out

    sets = sets_of(hubs.select("node").union(hubs.select("hub")).distinct())
    near = stash(links(shipped(around_hubs(hubs, sets), sets), percent, False), "links")
    release(spark)
    roots = components(near)

    place = several.join(classes.select("node", "n"), "node").join(roots, "node", "left").select(F.col("bucket").alias("g"), "band", "node", "n", F.coalesce("root", "node").alias("root"))
    partners = stash(with_partners(shipped(across_components(stash(place, "placed")), classes.select("node", "n", "regs")), percent), "partners")
    release(spark)
    more = sets_of(partners.select("node").distinct().join(sets.select("node"), "node", "left_anti"))
    both = sets.union(more)
    again = partners.join(both.select("node", "n"), "node").join(roots, "node", "left").select("g", "band", "node", "n", F.coalesce("root", "node").alias("root"))
    further = stash(links(shipped(across_components(again), both), percent, True), "links")
    drop(sets, more, several, hubs, partners)
    release(spark)
    roots = components(roots.toDF("u", "v").union(further))

    names = classes.join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = names.groupBy("root").agg(F.min("rep").alias("least"))
    named = names.join(least, "root").select("node", "least")
    found = signed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"), "digest")
    with_class = twins.renamed(found.where("node is not null")).join(named, "node").select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    found = with_class.union(found.where("node is null").select("doc_id", "n_shingles", "doc_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
