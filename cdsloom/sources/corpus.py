"""The corpus of view sources as a DataFrame."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def column_of(df: DataFrame, *candidates: str, required: bool = True) -> str | None:
    """The first of the candidates that ``df`` has, in any case."""
    found = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in found:
            return found[c.lower()]
    if required:
        raise ValueError(f"none of {', '.join(candidates)} in {', '.join(df.columns)}")
    return None


def sources_of(df: DataFrame) -> DataFrame:
    """(ddlname, source, as4local) of a corpus table, whatever its columns are called."""
    version = column_of(df, "as4local", required=False)
    return df.select(
        F.trim(F.col(column_of(df, "ddlname")).cast("string")).alias("ddlname"),
        F.col(column_of(df, "source", "ddlsource")).cast("string").alias("source"),
        (F.col(version).cast("string") if version else F.lit(None).cast("string")).alias("as4local"),
    )


def deduplicated(sources: DataFrame) -> DataFrame:
    """(ddlname, source): one version of each name in upper case, the least as4local, then the least source.

    Blank and null names are left out, null sources are empty.  The minimum is
    combined before the shuffle, so versions of one name never meet in a sort.
    """
    keyed = sources.where("trim(ddlname) <> ''").select(F.upper(F.trim("ddlname")).alias("ddlname"), F.struct(F.coalesce("as4local", F.lit("")).alias("v"), F.trim(F.coalesce("source", F.lit(""))).alias("source")).alias("s"))
    return keyed.groupBy("ddlname").agg(F.min("s").alias("s")).select("ddlname", F.col("s.source").alias("source"))


def looked_up(sources: DataFrame, name: str) -> DataFrame:
    """The source of one name, at most one row."""
    return sources.where(F.upper(F.trim("ddlname")) == name.strip().upper()).select("ddlname", "source").orderBy("as4local", "source").limit(1)


def in_memory(spark: SparkSession, entries: dict[str, str] | Iterable[tuple[str, str]]) -> DataFrame:
    rows = list(entries.items() if isinstance(entries, dict) else entries)
    return spark.createDataFrame([(n, s, None) for n, s in rows], "ddlname string, source string, as4local string")
