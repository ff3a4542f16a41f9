"""What the operators share: tables, the shared folder, and text in Arrow columns."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker handles at once; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``.  Where that is unset, a local
    session (driver and executors in one process) gets a temporary folder; on a
    cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="cdsloom-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return "file://" + _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, hadoop = _fs(spark, path)
    fs.deleteOnExit(hadoop)
    return path


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    Unlike a local checkpoint it outlives any executor.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


#: Rows of one number each that are broadcast: 16 MB at most.
SMALL_ROWS = 2_000_000


def small(ids: DataFrame, name: str = "ids") -> DataFrame:
    """``ids`` (one column of numbers) for a join: broadcast where they are counted to be few; beyond that the join is a shuffle, with the same rows."""
    ids = stash(ids, name)
    return F.broadcast(ids) if ids.count() <= SMALL_ROWS else ids


def fresh(name: str, df: DataFrame) -> str:
    """A name for a temporary column that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def drop(*stashed: DataFrame) -> None:
    """Delete what stash() wrote, once no plan reads it any more."""
    for df in stashed:
        fs, hadoop = _fs(df.sparkSession, df._stashed_at)
        fs.delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Have the driver's JVM collect its garbage: Spark deletes the shuffle files of plans that nothing refers to any more.

    Between the steps of a long job; else they lie on disk to its end.
    """
    gc.collect()
    spark._jvm.System.gc()


def by_group(batches: Iterable[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each key, from batches that are sorted by ``key`` (columns of integers without nulls)."""
    held: list[pa.RecordBatch] = []
    was = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(c).to_numpy() for c in key]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], 0)) + 1
        for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            now = tuple(int(c[at]) for c in columns)
            if held and now != was:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(at, end - at))
            was = now
    if held:
        yield pa.Table.from_batches(held)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Deal batches out again, so that each holds about ``most`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // most
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


class Words:
    """The white-space separated words of a slice of texts, each distinct word once.

    ``uniq`` the distinct words, ``idx`` the words of all texts in order, as
    places in ``uniq``; text i has words ``ptr[i]`` up to ``ptr[i + 1]``.
    White space is U+0020 and U+0009 to U+000D; nulls count as empty texts.
    """

    def __init__(self, text: pa.Array):
        lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
        flat = lists.flatten()
        ptr = lists.offsets.to_numpy().astype(np.int64)
        full = pc.greater(pc.binary_length(flat), 0)
        before = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))]
        d = flat.filter(full).dictionary_encode()
        self.ptr = before[ptr - ptr[0]]
        self.uniq, self.idx = d.dictionary, d.indices.to_numpy().astype(np.int64)


def csr(lens: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a pool of ragged rows: row k has ``lens[k]`` items; rows ``idx`` are wanted in order.

    Returns the places, and where each wanted row starts among them (one more entry than rows).
    """
    starts = np.cumsum(lens) - lens
    n = lens[idx]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    places = np.repeat(starts[idx] - (ends - n), n) + np.arange(total)
    return places, np.r_[0, ends].astype(np.int64)


def hash_words(words: list[str], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def per_row(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the ragged rows ``ptr``; 0 for empty rows."""
    total = np.r_[0, np.cumsum(values)]
    return total[ptr[1:]] - total[ptr[:-1]]


def binary_column(pool: bytes | np.ndarray, ptr: np.ndarray, width: int = 1) -> pa.Array:
    """A binary column out of one buffer: row i is items ``ptr[i]`` to ``ptr[i + 1]`` of ``width`` bytes.

    Arrow's offsets have 31 bits; more bytes in one column are an error, never a wrong column.
    """
    if len(ptr) and int(ptr[-1]) * width >= 1 << 31:
        raise OverflowError(f"{int(ptr[-1]) * width} bytes in one column: a text is too long")
    data = pool if isinstance(pool, bytes) else np.ascontiguousarray(pool)
    return pa.Array.from_buffers(pa.binary(), len(ptr) - 1, [None, pa.py_buffer((ptr * width).astype(np.int32)), pa.py_buffer(data)])


def binary_items(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The items of all rows of a binary column without nulls in one array, and where each row's start (one more entry than rows)."""
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data.view(dtype), (at - at[0]) // np.dtype(dtype).itemsize


def no_workers_pool() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def texts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) of whole texts, nulls as empty ones; other columns stay behind."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def extended(docs: DataFrame, fields: str, make, *, text: str = "text") -> DataFrame:
    """``docs`` with the columns ``fields`` (DDL) added, computed from whole texts in Arrow batches.

    ``make()`` runs once in each task and returns a function from an array of
    texts (nulls filled with empty ones) and the batch to the new columns.
    """
    names = docs.columns
    added = T.StructType.fromDDL(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in slices(batches, text):
            new = f(pc.fill_null(b.column(text), ""), b)
            yield pa.record_batch([*b.columns, *new], [*names, *added.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))


def picked_labels(labels: DataFrame, column: str, value: int, most: int, *, where: str = "true") -> np.ndarray:
    """At most ``most`` doc_ids whose label ``column`` is ``value``, the same ones in every run: those of least hash."""
    one = labels.where("doc_id is not null").where(where).groupBy("doc_id").agg(F.max(column).alias("label")).where(F.col("label") == value)
    rows = one.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(most).select("doc_id").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64))


def translated(text: pa.Array, table: bytes) -> pa.Array:
    """``text`` (without nulls) with its bytes replaced by ``table``, which leaves those from 0x80 on as they are."""
    at = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, 4 * text.offset)
    data = bytes(memoryview(text.buffers()[2] or b"")[at[0] : at[-1]]).translate(table)
    return pa.Array.from_buffers(pa.string(), len(text), [None, pa.py_buffer(at - at[0]), pa.py_buffer(data)])
