"""A pipeline over documents: each stage's rows are written and are the next stage's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cdsloom.llm import near_dedup, packing, quality, toxicity
from cdsloom.llm.common import fresh, stash, table
from cdsloom.llm.encoders import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go (operator 7).

    All other rows stay as they are, repeated ones too; null, empty and very long
    texts are scored like any other; an empty table stays empty; columns of any
    name may stand beside doc_id and text.
    """
    model, score = toxicity.fit(docs, table(spark, sf_dir, "labels")), fresh("toxicity", docs)
    return toxicity.scored(docs, model, score=score).where(F.col(score) < 0.5).select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go (operator 5).

    Null and empty texts fail them.  All other rows stay as they are, repeated
    ones too; an empty table stays empty; columns of any name may stand beside
    doc_id and text.
    """
    (ratio, least), found = quality.fit(docs, table(spark, sf_dir, "labels")), fresh("quality", docs)
    return quality.judged(docs, ratio, least=least, into=found).where(F.col(found)["kept"]).select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (operator 1): five words, similarity 0.8.

    Rows that repeat a doc_id and its text count once.  Of rows that share a
    doc_id and have different texts all stay or none.  Rows without a doc_id, a
    text or a word stay; a very long text counts whole; an empty table stays
    empty; columns of any name may stand beside doc_id and text.
    """
    name = fresh("kept", docs)
    kept = near_dedup.linked(docs, words=5, percent=80).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens (operator 4).

    Every row's tokens and its end id are packed, those of a null or empty text
    are the end id alone; an empty table gives no pieces; other columns are not read.
    """
    pieces = packing.packed(docs, vocabulary=vocabulary("word_bpe_49k.json"), end=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [("toxicity", toxic), ("quality", rules), ("near_dedup", dedup), ("packing", pack)]

#: SQL can't express the stages; the tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"stage-{name}")
    return docs
