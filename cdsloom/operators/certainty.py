"""Compiling a whole corpus in the executors, and what came of it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdsloom.operators.graph import written
from cdsloom.plans.compile import lowered
from cdsloom.plans.syntax import View, parse

FIELDS = "ddlname string, entidade string, tipo string, gerou_sql boolean, n_campos int, n_associacoes int, n_joins int, n_branches_union int, n_avisos int, avisos string"


def certainty(sources: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """A row per source: whether it gives SQL, its counts, and its advisories joined by ' | '.

    With ``named`` (alias, source) paths over several associations are resolved in
    the views that they lead to; without, such paths are advised on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        for b in batches:
            rows = []
            for name, source, targets in zip(*(b.column(c).to_pylist() for c in ("ddlname", "source", "targets")), strict=True):
                v, known = parse(name, source), {k: parse(k, x) for k, x in targets or ()}
                if v.parsed:
                    lowered(v, lambda n, known=known: known.get(n.upper().strip()))
                rows.append((name, v.entity, v.kind, v.parsed, sum(len(x.items) for x in v.blocks[:1]), sum(len(x.associations) for x in v.blocks), sum(len(x.joins) for x in v.blocks), len(v.blocks) if len(v.blocks) > 1 else 0, len(v.advisories), " | ".join(v.advisories)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            kinds = [pa.string()] * 3 + [pa.bool_()] + [pa.int32()] * 5 + [pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = sources.select("ddlname", "source")
    rows = rows.withColumn("targets", F.lit(None).cast("map<string, string>")) if named is None else _with_targets(rows, named)
    return rows.mapInArrow(run, FIELDS)


#: Associations of a path that are followed from view to view.
HOPS = 5


def _targets(rows: DataFrame, name: str, only_paths: bool) -> DataFrame:
    """(name, target): the targets of each source's associations; ``only_paths``: where a path goes on behind an association."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for n, source in zip(b.column(name).to_pylist(), b.column("source").to_pylist(), strict=True):
                v = parse(n, source)
                if not only_paths or goes_on(v):
                    found += [(n, t) for t in dict.fromkeys(a.target.upper().strip() for x in v.blocks for a in x.associations)]
            yield pa.record_batch([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], [name, "target"])

    return rows.select(name, "source").mapInArrow(run, f"{name} string, target string")


def goes_on(view: View) -> bool:
    """Whether some path of the view has two names or more behind an association."""
    for b in view.blocks:
        own = {a.alias.lower() for a in b.associations}
        for e in (*(i.expr for i in b.items), b.where, b.having, *b.group):
            text = ["." if t.text in "[]" else t.low for t in e]
            if any(t in own and text[k:].count(".") > 1 for k, t in enumerate(text)):
                return True
    return False


def _with_targets(rows: DataFrame, named: DataFrame) -> DataFrame:
    """``rows`` with the sources of the views that their paths may lead to, by name; few rows have any."""
    front = written(_targets(rows, "ddlname", True).distinct())
    every = front
    if not front.isEmpty():
        onward = written(_targets(named, "alias", False).select(F.col("alias").alias("target"), F.col("target").alias("next")).distinct())
        for _ in range(HOPS - 1):
            front = written(front.join(onward, "target").select("ddlname", F.col("next").alias("target")).distinct().join(every, ["ddlname", "target"], "left_anti"))
            if front.isEmpty():
                break
            every = written(every.union(front))
    found = every.join(named.select(F.col("alias").alias("target"), F.col("source").alias("text")), "target").groupBy("ddlname").agg(F.map_from_entries(F.collect_list(F.struct("target", "text"))).alias("targets"))
    return rows.join(found, "ddlname", "left").select("ddlname", "source", "targets")


def guaranteed(c: DataFrame) -> DataFrame:
    return c.where("gerou_sql and n_avisos = 0")


def with_advice(c: DataFrame) -> DataFrame:
    return c.where("gerou_sql and n_avisos > 0")


def failed(c: DataFrame) -> DataFrame:
    return c.where("not gerou_sql")


def advice_counts(c: DataFrame, most: int = 20) -> DataFrame:
    """(aviso, n): the commonest advisories without what stands behind the dash, ties by text."""
    each = c.where("avisos <> ''").select(F.explode(F.split("avisos", r" \| ")).alias("a"))
    return each.select(F.substring_index("a", " - ", 1).alias("aviso")).groupBy("aviso").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "aviso").limit(most)


def by_fields(c: DataFrame) -> DataFrame:
    """The guaranteed ones, the simplest first."""
    return guaranteed(c).select("ddlname", "entidade", "tipo", "n_campos").orderBy("n_campos", "ddlname")


def counts(c: DataFrame) -> DataFrame:
    """One row: total, garantidas, com_aviso, falhou."""
    return c.agg(F.count("*").alias("total"), F.count_if(F.expr("gerou_sql and n_avisos = 0")).alias("garantidas"), F.count_if(F.expr("gerou_sql and n_avisos > 0")).alias("com_aviso"), F.count_if(F.expr("not gerou_sql")).alias("falhou"))


def summary(c: DataFrame) -> str:
    n = counts(c).first()
    return f"{n['garantidas']:>10,}  without advisories\n{n['com_aviso']:>10,}  with advisories\n{n['falhou']:>10,}  without SQL\n{n['total']:>10,}  in all"
