"""One query for each operator, over its whole table, and the SQL that checks it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cdsloom.llm import byte_bpe, html_text, licenses, near_dedup, packing, quality, token_counts, token_store, topk, toxicity
from cdsloom.llm.common import table
from cdsloom.llm.encoders import vocabulary

Query = Callable[[SparkSession, str], DataFrame]


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh
  FROM w
), n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
u AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT p.a, p.b FROM p JOIN n na ON p.a = na.doc_id JOIN n nb ON p.b = nb.doc_id WHERE 100 * p.c >= 80 * (na.n + nb.n - p.c)
), r AS (
  SELECT doc_id, doc_id AS to_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM r JOIN l ON r.to_id = l.a
)
SELECT n.doc_id, n.n AS n_shingles, min(r.to_id) AS component_id, n.doc_id = min(r.to_id) AS kept
FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY n.doc_id, n.n
"""

OP8_SQL = r"""
WITH e AS (
  SELECT CAST(vec_id AS BIGINT) AS id, embedding AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL), true)
), p AS (
  SELECT q.id AS query_id, b.id AS vec_id,
    CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (q.v[i] >= 0) <> (b.v[i] >= 0) THEN 1 ELSE 0 END)) AS BIGINT) AS distance
  FROM e q JOIN e b ON q.id <> b.id WHERE q.id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS BIGINT) AS rank, vec_id, distance FROM p
)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""


def stored(docs: DataFrame) -> DataFrame:
    ids = token_store.round_trip(docs, vocabulary=vocabulary("word_bpe_49k.json"), end=1)
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.linked(table(spark, sf_dir, "documents"), words=2, percent=80)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(table(spark, sf_dir, "documents"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the decimal ids, joined by commas, and of the decoded text."""
    decimal = [str(k) for k in range(1 << 16)]
    for b in batches:
        ids = [hashlib.sha256(",".join(map(decimal.__getitem__, np.frombuffer(x.as_buffer(), "<u2").tolist())).encode()).hexdigest() for x in b.column("ids")]
        text = [hashlib.sha256(x.as_buffer()).hexdigest() for x in b.column("decoded")]
        yield pa.record_batch([b.column("doc_id"), b.column("n_tokens"), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def recoded(docs: DataFrame) -> DataFrame:
    return byte_bpe.round_trip(docs, _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", vocabulary=vocabulary("byte_bpe_50k.json"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recoded(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), vocabulary=vocabulary("word_bpe_49k.json"), end=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.attributed(table(spark, sf_dir, "documents"), vocabulary=vocabulary("byte_bpe_50k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(topk.sign_codes(table(spark, sf_dir, "embeddings")), k=10, every=20)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents")).drop("spans")


def queries() -> dict[str, Query]:
    all_ = (op1_near_dedup, op2_token_store, op3_byte_bpe, op4_packing, op5_quality, op6_token_counts, op7_toxicity, op8_hamming_topk, op9_html_text, op10_licenses)
    return {f.__name__: f for f in all_}


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": OP1_SQL, "op8_hamming_topk": OP8_SQL}
