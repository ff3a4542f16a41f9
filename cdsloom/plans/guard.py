"""Read-only statements: judged by Spark's own parser, on the plan."""

from __future__ import annotations

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession


class NotAllowed(PermissionError):
    pass


#: Commands that only read: fixed values.
_READING = ("DescribeRelation", "DescribeColumn", "DescribeQueryCommand", "DescribeNamespace", "DescribeFunction", "DescribeFunctionCommand", "DescribeTableCommand", "DescribeTablePartition", "ExplainCommand", "ShowTables", "ShowTablesCommand", "ShowColumns", "ShowNamespaces", "ShowFunctions", "ShowViews", "ShowTableProperties", "ShowPartitions", "ShowCreateTable", "ShowCatalogsCommand", "ShowTableExtended", "ShowCurrentNamespaceCommand", "ShowNamespacesCommand", "ShowTableStatus")
#: Nodes of queries: fixed values.  Any other node is refused.
_QUERY = frozenset(
    "Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Limit Offset Tail Distinct Deduplicate Union Intersect Except OneRowRelation SubqueryAlias Generate Pivot Unpivot Sample Window "
    "WithWindowDefinition UnresolvedWith UnresolvedRelation UnresolvedInlineTable UnresolvedHaving UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedHint ResolvedInlineTable LocalRelation RelationTimeTravel CTERelationDef RepartitionByExpression "
    "UnresolvedTable UnresolvedTableOrView UnresolvedNamespace UnresolvedFunctionName".split()
)
#: Functions that run code of the caller's choice: fixed values.
_CALLING = frozenset({"reflect", "java_method", "try_reflect"})


def _items(seq):
    return (seq.apply(k) for k in range(seq.size()))


def _expressions(plan):
    found = list(_items(plan.expressions()))
    while found:
        e = found.pop()
        yield e
        found += _items(e.children())


def _nodes(plan):
    """A plan's nodes, those of its subqueries and of the plans inside commands."""
    yield plan
    # What is explained or described is no child of the command.
    if _name(plan) == "ExplainCommand":
        yield from _nodes(plan.logicalPlan())
    if _name(plan) == "DescribeQueryCommand":
        yield from _nodes(plan.plan())
    for group in (plan.children(), plan.innerChildren(), plan.subqueries()):
        for child in _items(group):
            if hasattr(child, "children") and ".plans." in child.getClass().getName() or ".analysis.Unresolved" in child.getClass().getName():
                yield from _nodes(child)


def _name(x) -> str:
    return x.getClass().getSimpleName().rstrip("$")


def check(spark: SparkSession, sql: str) -> None:
    """Raise NotAllowed unless ``sql`` is one statement that only reads, and calls no code but Spark's functions."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as why:
        if isinstance(why, ParseException) or "ParseException" in str(type(why)) or "PARSE" in str(why):
            raise NotAllowed(f"not one readable statement: {str(why).splitlines()[0]}") from None
        raise
    for node in _nodes(plan):
        name = _name(node)
        if name not in _QUERY and name not in _READING:
            raise NotAllowed(f"{name} isn't known to read only")
        for e in _expressions(node):
            kind = _name(e)
            if kind == "UnresolvedFunction" and _items(e.nameParts()) and list(_items(e.nameParts()))[-1].lower() in _CALLING:
                raise NotAllowed(f"{list(_items(e.nameParts()))[-1]} calls other code")
            if "UnresolvedIdentifier" in kind:
                raise NotAllowed("a name that is computed can't be judged")


def read(spark: SparkSession, sql: str) -> DataFrame:
    """The only way from text to Spark."""
    check(spark, sql)
    return spark.sql(sql)
