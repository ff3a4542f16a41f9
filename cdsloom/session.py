"""The engine's front door: one corpus, its settings, and what can be asked of them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import cached_property
from pathlib import Path

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cdsloom.operators import certainty as C
from cdsloom.operators import graph as G
from cdsloom.operators import metrics as M
from cdsloom.operators.tree import Tree, below, tree
from cdsloom.plans import guard
from cdsloom.plans.compile import frame, statement, validated
from cdsloom.plans.names import Resolver, Settings, cleaned, folder
from cdsloom.plans.syntax import View, parse
from cdsloom.sources import corpus as S


@dataclass
class Result:
    name: str
    found: bool
    sql: str = ""
    view: View | None = None
    tree: Tree | None = None
    advisories: list[str] = field(default_factory=list)
    df: DataFrame | None = None
    #: Whether Spark could analyse it; None: not asked.
    analysed: bool | None = None

    @property
    def generated(self) -> bool:
        return self.view is not None and self.view.parsed

    @property
    def guaranteed(self) -> bool:
        """SQL without advisories that Spark, where it was asked, can analyse."""
        return self.generated and not self.advisories and self.analysed is not False

    def seal(self) -> str:
        if not self.found or not self.generated:
            return "not generated" if self.found else "not found"
        if self.analysed is False:
            return "not analysed"
        return f"{len(self.advisories)} advisories" if self.advisories else "clean"


class Session:
    """``sources``: a corpus table (ddlname, source or ddlsource, as4local) or {name: source}.

    ``tables``: gives the DataFrame of a table that a view reads; without it views are translated, not run.
    Views are found by source name, and by entity name through the corpus's alias map; what a
    call needs is fetched level by level, a Spark job for all names of a level.
    """

    #: Parsed views that are remembered; they are fetched again beyond that.
    MOST_VIEWS = 20_000

    def __init__(self, spark: SparkSession, sources: DataFrame | dict[str, str], *, settings: Settings | None = None, tables: Callable[[str], DataFrame] | None = None, known_truncated=()):
        self.spark, self.settings, self.tables = spark, settings or Settings(), tables
        self.raw = S.in_memory(spark, sources) if isinstance(sources, dict) else S.sources_of(sources)
        self.sources = S.deduplicated(self.raw)
        self.known_truncated = frozenset(n.upper() for n in known_truncated)
        self.found: DataFrame | None = None
        self._views: dict[str, View | None] = {}

    @cached_property
    def named(self) -> DataFrame:
        """(alias, ddlname, source): each source under its own name and, where that is free, its entity's; written once."""
        sources = G.written(self.sources)
        aliases = G.alias_map(M.classified(M.metrics(sources)))
        own = sources.select(F.col("ddlname").alias("alias"), "ddlname")
        others = aliases.join(own.select("alias"), "alias", "left_anti")
        return G.written(own.union(others.select("alias", "ddlname")).join(sources, "ddlname").select("alias", "ddlname", "source"))

    def _load(self, names: Iterable[str]) -> list[View]:
        """Parse the sources of names that aren't known yet, in one job; the views of all that have one."""
        names = list(dict.fromkeys(n.upper().strip() for n in names))
        if len(self._views) > self.MOST_VIEWS:
            self._views.clear()
        new = [n for n in names if n not in self._views]
        if new:
            self._views.update(dict.fromkeys(new))
            for r in self.named.where(F.col("alias").isin(*new)).collect():
                self._views[r["alias"]] = parse(r["ddlname"], r["source"])
        return [v for n in names if (v := self._views[n]) is not None]

    def _load_below(self, name: str, associations: bool, depth: int = 15, nodes: int = 4000) -> None:
        """All views below a name, a job for each level."""
        level, seen = [name], {name.upper().strip()}
        for _ in range(depth + 1):
            views = self._load(level)
            level = [n for v in views for n in below(v, associations) if (up := n.upper().strip()) not in seen and not seen.add(up)]
            if not level or len(seen) > nodes:
                break

    def _lookup(self, name: str) -> View | None:
        self._load([name])
        return self._views[name.upper().strip()]

    def source(self, name: str) -> str | None:
        row = S.looked_up(self.raw, name).first()
        return row["source"] if row else None

    def exists(self, name: str) -> bool:
        return self._lookup(name) is not None

    def read(self, name: str, parameters: dict | None = None) -> DataFrame:
        """The rows of a name: a view is compiled into its own plan, so stacked views are one plan."""
        self._load_below(name, True)
        return self._read(name, parameters)

    def _read(self, name: str, parameters: dict | None) -> DataFrame:
        view = self._lookup(name)
        if view is None:
            if self.tables is None:
                raise ValueError(f"no table source for {name}")
            return self.tables(name)
        return frame(view, lambda n: self._read(n, parameters), self._lookup, parameters)

    def translate(self, name: str, *, associations: bool = False, depth: int = 15, nodes: int = 4000, with_tree: bool = True, run: bool = False, parameters: dict | None = None, write_to: str | None = None, analyse: bool = False) -> Result:
        """The SQL of a view, with its tree, its rows (``run``), its files (``write_to``), and whether Spark can analyse it (``analyse``)."""
        name = name.upper().strip()
        self._load_below(name, True, depth, nodes)
        view = self._lookup(name)
        if view is None:
            return Result(name, False, f"-- {name}: no such source")
        resolver = _LazyResolver(self.settings, self._lookup)
        sql = statement(view, resolver.full, f"{self.settings.target}.{cleaned(view.entity or name)}", self._lookup)
        result = Result(name, True, sql, view, advisories=list(view.advisories))
        if with_tree:
            result.tree = self.tree(name, associations=associations, depth=depth, nodes=nodes)
        if run and view.parsed:
            result.df = self.read(name, parameters)
        if analyse and view.parsed:
            result.analysed = self._analysed(name, result, parameters)
        if write_to is not None:
            save(result, write_to)
        return result

    def _analysed(self, name: str, result: Result, parameters: dict | None) -> bool:
        """Over ``tables`` if there are any, else over the catalogue."""
        if self.tables is None:
            return validated(self.spark, result.sql)
        try:
            self.read(name, parameters).schema  # noqa: B018
        except (AnalysisException, ParseException, ValueError):
            return False
        return True

    def analysed(self, names: Iterable[str], parameters: dict | None = None) -> DataFrame:
        """(ddlname, garantida, analisada): the third tier of certainty, for names that are given."""
        results = [self.translate(n, with_tree=False, analyse=True, parameters=parameters) for n in names]
        return self.spark.createDataFrame([(r.name, r.guaranteed, bool(r.analysed)) for r in results], "ddlname string, garantida boolean, analisada boolean")

    def tree(self, name: str, *, associations: bool = False, depth: int = 15, nodes: int = 4000) -> Tree:
        """The tree below a name; sources that the inventory found truncated count as such."""
        self._load_below(name, associations, depth, nodes)
        known = self.known_truncated
        if self.found is not None:
            names = [n for n, v in self._views.items() if v is not None]
            known |= {r[0] for r in self.found.where((F.col("status_fonte") == "TRUNCADO") & F.col("ddl_up").isin(*names)).select("ddl_up").collect()}
        return tree(name, self._lookup, known_truncated=known, associations=associations, depth=depth, nodes=nodes)

    def inventory(self, dictionary: DataFrame | None = None) -> DataFrame:
        """The inventory of the corpus; from then on trees and certainty() heed it."""
        if dictionary is None:
            try:
                dictionary = self.spark.table(self.settings.dependencies_table)
            except AnalysisException:
                # The dictionary only adds names; a corpus without one is fine.
                dictionary = None
        self.found = G.written(G.inventory(self.sources, dictionary))
        return self.found

    def certainty(self, names: DataFrame | None = None) -> DataFrame:
        """Of ``names`` (ddlname); else of those the inventory found apt, or of all if there is none yet."""
        if names is None and self.found is not None:
            names = self.found.where("apta").select(F.col("ddl_up").alias("ddlname"))
        chosen = self.sources if names is None else self.sources.join(names.select(F.upper(F.trim("ddlname")).alias("ddlname")), "ddlname", "left_semi")
        return C.certainty(chosen, self.named)

    def sql(self, text: str) -> DataFrame:
        return guard.read(self.spark, text)


class _LazyResolver(Resolver):
    def __init__(self, settings: Settings, lookup):
        super().__init__(settings, ())
        self.lookup = lookup

    def is_view(self, name: str) -> bool:
        return self.lookup(name) is not None


def save(result: Result, root: str, *, dry: bool = False) -> dict[str, Path]:
    """A folder for a view: its SQL, its tree, its advisories if any, and metadata; ``dry`` only names the files."""
    base = Path(root) / folder(result.name)
    view = result.view or View(result.name)
    files = {"sql": (base / f"{base.name.lower()}.sql", result.sql + "\n")}
    meta = {
        "ddlname": result.name, "entidade_cds": view.entity, "sql_view_hana": view.sql_view, "label": view.label, "tipo": view.kind, "estilo": view.blocks[0].style if view.blocks else "",
        "entidade_base": view.blocks[0].base if view.blocks else "", "n_campos": len(view.blocks[0].items) if view.blocks else 0, "n_associacoes": sum(len(b.associations) for b in view.blocks),
        "n_joins": sum(len(b.joins) for b in view.blocks), "n_branches_union": len(view.blocks) if len(view.blocks) > 1 else 0, "truncado": view.truncated, "n_avisos": len(result.advisories),
        "avisos": result.advisories, "gerado_em_utc": datetime.now(UTC).isoformat(timespec="seconds"),
    }
    if result.tree is not None:
        files["tree"] = (base / "arvore.txt", result.tree.text() + "\n")
        meta |= {"tabelas_fisicas": sorted(result.tree.tables), "cds_dependentes": sorted(result.tree.views), "dependencias_truncadas": sorted(result.tree.truncated), "dependencias_nao_encontradas": sorted(result.tree.missing)}
    if result.advisories:
        files["advisories"] = (base / "avisos.txt", "".join(f"{k:2}. {a}\n" for k, a in enumerate(result.advisories, 1)))
    files["metadata"] = (base / "metadata.json", json.dumps(meta, indent=2, ensure_ascii=False) + "\n")
    if not dry:
        base.mkdir(parents=True, exist_ok=True)
        (base / "avisos.txt").unlink(missing_ok=True)
        for path, text in files.values():
            path.write_text(text, encoding="utf-8")
    return {k: path for k, (path, _) in files.items()}


def saved(files: dict[str, Path], *, dry: bool = False) -> str:
    """What save() wrote, or would have."""
    folder_ = next(iter(files.values())).parent
    return "\n".join([f"{'not written' if dry else 'written'}: {folder_}", *(f"  {k}: {p.name}" for k, p in files.items())])


def export_certainty(certain: DataFrame, folder_: str) -> None:
    """certeza.csv, sorted, and garantidas.txt, the guaranteed names in order; both as folders that Spark writes."""
    certain.orderBy("gerou_sql", "n_avisos", "ddlname", ascending=[False, True, True]).write.mode("overwrite").csv(f"{folder_}/certeza.csv", header=True)
    # Both are small beside the corpus, and sorted as a whole.
    C.guaranteed(certain).select("ddlname").orderBy("ddlname").write.mode("overwrite").text(f"{folder_}/garantidas.txt")
