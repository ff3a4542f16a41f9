"""From views to DataFrames and to Spark SQL text: one set of rewritten expressions for both."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import date, datetime
from decimal import Decimal
from math import isfinite

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cdsloom.plans.lexer import Token
from cdsloom.plans.syntax import Association, Block, Expr, View

#: Calls that have no meaning fixed here and are only reported: fixed values.
_REPORTED = {"dats_": "date arithmetic", "tstmp_": "time stamp arithmetic", "tstmpl_": "long time stamp arithmetic", "currency_conversion": "currency conversion", "unit_conversion": "unit conversion"}
_SQL_TYPES = {"string", "int", "bigint", "double", "float", "decimal", "date", "timestamp", "boolean", "char", "varchar"}
_CHECK = "check by hand"


@dataclass
class Lowered:
    """A block with all expressions as SQL text."""

    source: Block
    joins: list[tuple[str, str, str, str]] = field(default_factory=list)  # kind, target, alias, on
    items: list[tuple[str, str, bool]] = field(default_factory=list)  # expression, name, key
    exposed: list[str] = field(default_factory=list)
    where: str = ""
    group: list[str] = field(default_factory=list)
    having: str = ""


def _joined(parts: list[str]) -> str:
    """The parts with a blank between them, but none beside a dot; what is inside a part stays as it is."""
    out = ""
    for before, p in zip(["."] + parts, parts, strict=False):
        out += p if p == "." or before == "." else f" {p}"
    return out


def quoted(value: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r") + "'"


def literal(value: object) -> str:
    """The literal of a parameter's value, of its own type."""
    match value:
        case None:
            return "NULL"
        case bool():
            return str(value).upper()
        case str():
            return quoted(value)
        case datetime():
            return f"TIMESTAMP'{value.isoformat(sep=' ')}'" if value.tzinfo else f"TIMESTAMP_NTZ'{value.isoformat(sep=' ')}'"
        case date():
            return f"DATE'{value.isoformat()}'"
        case Decimal():
            return f"{value:f}BD"
        case float():
            return f"{value!r}D" if isfinite(value) else f"CAST('{value!r}' AS DOUBLE)"
        case int():
            return str(value)
    raise TypeError(f"a parameter can't be a {type(value).__name__}")


def named(name: str) -> str:
    """A name, in back-quotes where Spark wouldn't read it as one without."""
    return name if name.isascii() and " " not in name else f"`{name}`"


def written(t: Token) -> str:
    """A token as Spark SQL reads it: '' in a literal is a quote, a backslash is itself, odd names stand in back-quotes."""
    if t.kind == "string":
        return quoted(t.text[1:-1].replace("''", "'"))
    return named(t.text) if t.kind == "name" else t.text


class Rewriter:
    """Rewrites the expressions of one block, and finds out which associations they use."""

    def __init__(self, view: View, block: Block, lookup: Callable[[str], View | None], parameters: dict[str, object] | None):
        self.view, self.block, self.lookup, self.parameters = view, block, lookup, parameters
        self.known: dict[str, Association] = {a.alias.lower(): a for a in block.associations}
        self.used: dict[str, tuple[str, str, Association]] = {}  # by alias in small letters: alias, alias of the source, association
        self.columns: dict[str, str] = {}
        for item in block.items:
            simple = [t.text for t in item.expr]
            if len(simple) == 1 and item.expr[0].kind == "name":
                self.columns[(item.alias or simple[0]).lower()] = f"{named(block.alias)}.{named(simple[0])}"
            elif len(simple) == 3 and simple[1] == "." and item.expr[2].kind == "name":
                self.columns[(item.alias or simple[2]).lower()] = f"{named(simple[0])}.{named(simple[2])}"

    def _use(self, alias: str, at: str, association: Association) -> None:
        if alias.lower() in self.used:
            return
        if association.cardinality and not association.cardinality.endswith("1"):
            self.view.advise(f"association {association.alias} [{association.cardinality}] may repeat rows - {_CHECK}")
        self.used[alias.lower()] = (alias, at, association)

    def _filtered(self, association: Association, inner: list[Token], alias: str) -> tuple[Association, str]:
        """The association narrowed by what stands in brackets behind it, [1: left outer where f = 'x'], and an alias for it."""
        cardinality, kind = association.cardinality, association.kind
        if len(inner) > 1 and inner[1].text == ":":
            cardinality, inner = inner[0].text, inner[2:]
        words = [t.low for t in inner[:3]]
        for start, name in ((["left", "outer"], "left"), (["inner"], "inner")):
            if words[: len(start)] == start:
                kind, inner = name, inner[len(start) :]
        if inner and inner[0].low == "where":
            inner = inner[1:]
        narrowed = replace(association, cardinality=cardinality, kind=kind, only=tuple(inner))
        same = next((a for a, _, x in self.used.values() if x == narrowed), None)
        return narrowed, same or f"{alias}_{1 + sum(x.alias == association.alias and bool(x.only) for _, _, x in self.used.values())}"

    def _step(self, expr: Expr, k: int, association: Association, alias: str) -> tuple[Association, str, int]:
        """The association named at token k, and the token after it and its brackets."""
        if k + 1 < len(expr) and expr[k + 1].text == "[":
            end = self._closing(expr, k + 1, "[", "]")
            association, alias = self._filtered(association, list(expr[k + 2 : end]), alias)
            return association, alias, end + 1
        return association, alias, k + 1

    def _path(self, expr: Expr, k: int) -> tuple[str, int]:
        """A path over associations that starts at token k: its SQL text and the token after it."""
        association = self.known[expr[k].low]
        source = self.block.alias
        association, alias, k = self._step(expr, k, association, association.alias)
        self._use(alias, source, association)
        while k + 1 < len(expr) and expr[k].text == ".":
            name = expr[k + 1]
            target = self.lookup(association.target)
            more = next((a for b in target.blocks for a in b.associations if a.alias.lower() == name.low), None) if target else None
            goes_on = k + 2 < len(expr) and expr[k + 2].text in (".", "[")
            if more is None and goes_on:
                self.view.advise(f"{association.target} has no known association {name.text} - {_CHECK}")
            if more is None or not goes_on:
                return f"{named(alias)}.{written(name)}", k + 2
            source = alias
            association, alias, k = self._step(expr, k + 1, more, f"{alias}{more.alias}")
            self._use(alias, source, association)
        return alias, k

    def _cast_type(self, kind: list[Token]) -> str:
        text = "".join(t.text for t in kind if t.low not in ("preserving", "type")).lower()
        m = re.fullmatch(r"abap\.(\w+?)(\d*)(?:\((\d+)(?:,(\d+))?\))?", text)
        if m and m[1] == "dec" and m[3]:
            return f"DECIMAL({m[3]},{m[4] or 0})"
        if m and m[1] == "char":
            return "STRING"
        if m and m[1] == "int" and m[2]:
            return "BIGINT" if m[2] == "8" else "INT"
        if text.split("(")[0] in _SQL_TYPES:
            return text.upper()
        self.view.advise(f"cast to {text} isn't converted - {_CHECK}")
        return text

    def sql(self, expr: Expr) -> str:
        out: list[str] = []
        k = 0
        while k < len(expr):
            t = expr[k]
            after = expr[k + 1].text if k + 1 < len(expr) else ""
            if t.text == "&&":
                out.append("||")
            elif t.low == "preserving" and k + 1 < len(expr) and expr[k + 1].low == "type":
                k += 1
            elif t.low == "cast" and after == "(":
                end = self._closing(expr, k + 1)
                inner = expr[k + 2 : end]
                at = self._last_as(inner)
                if at is None:
                    out += ["cast", "(", self.sql(inner), ")"]
                else:
                    out.append(f"CAST({self.sql(inner[:at])} AS {self._cast_type(list(inner[at + 1 :]))})")
                k = end
            elif t.low == "$projection" and after == "." and k + 2 < len(expr):
                name = expr[k + 2].text
                found = self.columns.get(name.lower())
                if found is None:
                    self.view.advise(f"$projection.{name} isn't a plain element; {self.block.alias}.{name} is used - {_CHECK}")
                    found = f"{named(self.block.alias)}.{named(name)}"
                out.append(found)
                k += 2
            elif t.low == "$parameters" and after == "." and k + 2 < len(expr):
                out.append(self._parameter(expr[k + 2].low))
                k += 2
            elif t.text == ":" and k + 1 < len(expr) and expr[k + 1].low in self.view.parameters:
                out.append(self._parameter(expr[k + 1].low))
                k += 1
            elif t.low == "$session":
                self.view.advise(f"$session needs a value - {_CHECK}")
                out.append(t.text)
            elif t.kind == "name" and t.low in self.known and after in (".", "[") and (not out or out[-1] != "."):
                text, k = self._path(expr, k)
                out.append(text)
                continue
            else:
                if t.kind == "name" and after == "(":
                    for start, what in _REPORTED.items():
                        if t.low.startswith(start):
                            self.view.advise(f"{what}: {t.text} - {_CHECK}")
                            break
                if t.low == "abap" and after == ".":
                    self.view.advise(f"a type of abap is left - {_CHECK}")
                out.append(written(t))
            k += 1
        return _joined(out)

    def _parameter(self, name: str) -> str:
        if self.parameters is None:
            return f":{name}"
        if name not in self.parameters:
            raise ValueError(f"parameter {name} has no value")
        return literal(self.parameters[name])

    @staticmethod
    def _closing(expr: Expr, k: int, start: str = "(", end: str = ")") -> int:
        depth = 0
        for i in range(k, len(expr)):
            depth += (expr[i].text == start) - (expr[i].text == end)
            if not depth:
                return i
        return len(expr)

    @staticmethod
    def _last_as(expr: Expr) -> int | None:
        depth, found = 0, None
        for i, t in enumerate(expr):
            depth += (t.text == "(") - (t.text == ")")
            if t.low == "as" and not depth:
                found = i
        return found


def lowered(view: View, lookup: Callable[[str], View | None] = lambda _: None, parameters: dict[str, object] | None = None) -> list[Lowered]:
    """The blocks of a view; advisories are added to the view."""
    out = []
    for block in view.blocks:
        low, r = Lowered(block), Rewriter(view, block, lookup, parameters)
        for item in block.items:
            first = item.expr[0]
            if len(item.expr) == 1 and first.kind == "name":
                if first.low in r.known:
                    low.exposed.append(first.text)
                    continue
                text = f"{named(block.alias)}.{named(first.text)}"
                name = item.alias or first.text
            else:
                text = r.sql(item.expr)
                name = item.alias or (item.expr[-1].text if item.expr[-1].kind == "name" and len(item.expr) > 1 and item.expr[-2].text == "." else text)
            low.items.append((text, name, item.key))
        low.where, low.having = r.sql(block.where), r.sql(block.having)
        low.group = [f"{named(block.alias)}.{named(g[0].text)}" if len(g) == 1 and g[0].kind == "name" else r.sql(g) for g in block.group]
        for j in block.joins:
            low.joins.append((j.kind, j.target, j.alias, r.sql(j.on)))
        done: set[str] = set()
        while len(done) < len(r.used):
            for key, (alias, source, a) in list(r.used.items()):
                if key not in done:
                    done.add(key)
                    low.joins.append((a.kind, a.target, alias, _on(r, a, source, alias)))
        joined = {a.alias.lower() for _, _, a in r.used.values()}
        for a in block.associations:
            if a.alias.lower() not in joined and a.alias not in low.exposed:
                view.advise(f"association {a.alias} isn't used and not joined")
        out.append(low)
    return out


def _on(r: Rewriter, a: Association, source: str, alias: str) -> str:
    """The condition of an association under ``alias``, as seen from the view that uses it."""
    own = source == r.block.alias
    tokens: list[Token] = []
    for k, t in enumerate(a.on):
        first = not k or a.on[k - 1].text != "."
        dotted = k + 1 < len(a.on) and a.on[k + 1].text == "."
        if first and dotted and t.low == a.alias.lower():
            tokens.append(Token("name", alias))
        elif first and dotted and not own and t.kind == "name":
            # Of another view's association: $projection and its own alias are what this view calls its source.
            tokens.append(Token("name", source))
        else:
            tokens.append(t)
    known, r.known = r.known, {}
    text = r.sql(tuple(tokens)) if own else _joined([written(t) for t in tokens])
    if a.only:
        # Bare names in brackets are the target's.
        inner = []
        for k, t in enumerate(a.only):
            beside = k and a.only[k - 1].text == "." or k + 1 < len(a.only) and a.only[k + 1].text in (".", "(")
            inner += [Token("name", alias), Token("sign", "."), t] if t.kind == "name" and not beside and t.low not in _WORDS else [t]
        only = r.sql(tuple(inner))
        text = f"({text}) AND ({only})" if text else only
    r.known = known
    return text


#: Words of conditions, which aren't names of elements: fixed values.
_WORDS = frozenset("and or not is null like in between escape case when then else end true false as".split())


Reader = Callable[[str], DataFrame]


def frame(view: View, read: Reader, lookup: Callable[[str], View | None] = lambda _: None, parameters: dict[str, object] | None = None) -> DataFrame:
    """The DataFrame of a view; ``read`` gives the DataFrame of a name that it selects from."""
    if not view.parsed:
        raise ValueError(f"{view.name} has no plan: {'; '.join(view.advisories) or 'nothing parsed'}")
    if view.left_out:
        raise ValueError(f"{view.name} isn't run: {', '.join(view.left_out)} would be left out")
    result: DataFrame | None = None
    for low in lowered(view, lookup, parameters):
        b = low.source
        df = read(b.base).alias(b.alias)
        for kind, target, alias, on in low.joins:
            other = read(target).alias(alias)
            df = df.crossJoin(other) if kind == "cross" else df.join(other, F.expr(on), kind)
        if low.where:
            df = df.where(F.expr(low.where))
        columns = [F.expr(e).alias(n, metadata={"key": True}) if key else F.expr(e).alias(n) for e, n, key in low.items]
        if low.group:
            names = [f"__g{k}" for k in range(len(low.group))]
            plain = {e: n for e, n in zip(low.group, names, strict=True)}
            whole = [F.expr(e).alias(n) for e, n in zip(low.group, names, strict=True)]
            outs = [c for c, (e, _, _) in zip(columns, low.items, strict=True) if e not in plain]
            grouped = df.groupBy(*whole)
            extra = [F.expr(low.having).alias("__having")] if low.having else []
            df = grouped.agg(*outs, *extra) if outs or extra else df.select(*whole).distinct()
            if low.having:
                df = df.where("__having")
            df = df.select(*(F.col(plain[e]).alias(n) if e in plain else F.col(f"`{n}`") for e, n, _ in low.items))
        else:
            df = df.select(*columns)
            if low.having:
                df = df.where(F.expr(low.having))
        if b.distinct:
            df = df.distinct()
        if result is None:
            result = df
        else:
            result = {
                "union all": lambda: result.unionAll(df), "union": lambda: result.union(df).distinct(), "intersect": lambda: result.intersect(df),
                "intersect all": lambda: result.intersectAll(df), "except": lambda: result.subtract(df), "except all": lambda: result.exceptAll(df),
            }[b.operation]()
    return result


_JOIN_SQL = {"inner": "INNER JOIN", "left": "LEFT OUTER JOIN", "right": "RIGHT OUTER JOIN", "full": "FULL OUTER JOIN", "cross": "CROSS JOIN"}


def body(view: View, full: Callable[[str], str], lookup: Callable[[str], View | None] = lambda _: None, parameters: dict[str, object] | None = None) -> str:
    """The select statement of a view in Spark SQL; ``full`` gives the catalogue name of a name."""
    out = ""
    for low in lowered(view, lookup, parameters):
        b = low.source
        lines = ["SELECT DISTINCT" if b.distinct else "SELECT"]
        for k, (e, n, key) in enumerate(low.items):
            lines.append(f"  {e} AS `{n}`" + ("," if k < len(low.items) - 1 else "") + ("  -- key" if key else ""))
        lines.append(f"FROM {full(b.base)} AS {named(b.alias)}")
        for kind, target, alias, on in low.joins:
            lines.append(f"{_JOIN_SQL[kind]} {full(target)} AS {named(alias)}" + (f" ON {on}" if kind != "cross" else ""))
        if low.where:
            lines.append(f"WHERE {low.where}")
        if low.group:
            lines.append("GROUP BY " + ", ".join(low.group))
        if low.having:
            lines.append(f"HAVING {low.having}")
        text = "\n".join(lines)
        # Set operations go from left to right, whatever their rank in SQL.
        out = text if not out else f"(\n{out}\n)\n{b.operation.upper()}\n{text}" if "\nINTERSECT" in out or b.operation.startswith("intersect") else f"{out}\n{b.operation.upper()}\n{text}"
    return out


def statement(view: View, full: Callable[[str], str], target: str, lookup: Callable[[str], View | None] = lambda _: None) -> str:
    """A script for a reader: comments on the view, a commented CREATE, and its select."""
    if not view.parsed:
        return f"-- {view.name}: not translated ({'; '.join(view.advisories) or 'nothing parsed'})"
    text = body(view, full, lookup)
    head = [f"-- source: {view.name}"]
    if view.label:
        head.append(f"-- label: {view.label}")
    if view.sql_view:
        head.append(f"-- SQL view: {view.sql_view}")
    head.append(f"-- entity: {view.entity} ({view.kind})")
    if any(b.style == "classic" for b in view.blocks):
        head.append("-- classic select list")
    if len(view.blocks) > 1:
        head.append(f"-- blocks: {len(view.blocks)}")
    head.append(f"-- CREATE OR REPLACE VIEW {target} AS")
    return "\n".join(head) + "\n" + text


def validated(spark: SparkSession, sql: str) -> bool:
    """Whether Spark can analyse the statement."""
    from pyspark.errors import AnalysisException, ParseException

    try:
        spark.sql(sql).schema  # noqa: B018
    except (AnalysisException, ParseException):
        return False
    return True
