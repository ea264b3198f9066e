"""Ad-hoc statements over given views: what a statement may do is decided by its parsed and resolved plans, not by words in its text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

#: Nodes that a query is made of. Commands, table functions, scripts and all else are refused.
QUERY_NODES = set(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Limit Offset Tail Join LateralJoin SubqueryAlias UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedWith Union Distinct Deduplicate Intersect Except "
    "UnresolvedHaving WithWindowDefinition OneRowRelation LocalRelation UnresolvedInlineTable UnresolvedHint Generate Pivot UnresolvedPivot Unpivot Window Expand BaseGroupingSets".split()
)

#: Kinds of functions that compute from their arguments alone, as Spark groups its own; `misc_funcs` hold reflection, the session's settings and the like.
FUNCTION_GROUPS = set(
    "agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs predicate_funcs string_funcs "
    "struct_funcs url_funcs variant_funcs window_funcs xml_funcs".split()
)

#: Names that resolve to facts about the session if no column has them.
SESSION_FACTS = {"CurrentUser", "CurrentCatalog", "CurrentDatabase", "CurrentSchema"}

_SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"}


class Refused(ValueError):
    """The statement isn't a single query over the given views."""


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _expressions(plan) -> Iterator:
    """All expressions of a node, but not those of the plans inside them."""
    found = _items(plan.expressions())
    while found:
        e = found.pop()
        yield e
        found += _items(e.children())


def _plans(plan, closed: tuple[str, ...] = ()) -> Iterator:
    """A plan's nodes with those of subqueries and common table expressions; what stands below a node named in `closed` isn't looked at."""
    found = [plan]
    while found:
        node = found.pop()
        yield node
        if _name(node) in closed:
            continue
        found += _items(node.children())
        if _name(node) in ("UnresolvedWith", "WithCTE"):
            found += _items(node.innerChildren())
        found += [e.plan() for e in _expressions(node) if _name(e) in _SUBQUERIES]


def check_parsed(spark: SparkSession, statement: str, views: set[str]) -> None:
    """Refuses a statement that is no single query, reads another relation than the views, or calls a function that does more than compute."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except Exception as e:  # the parser's own error, whatever class it has
        raise Refused("only a single SELECT is allowed") from e
    nodes = list(_plans(plan))
    odd = sorted({_name(n) for n in nodes} - QUERY_NODES)
    if odd:
        raise Refused(f"only a single SELECT is allowed: {', '.join(odd)}")
    # names of common table expressions are subquery aliases as well, so this allows what the statement itself defines
    own = {n.alias().lower() for n in nodes if _name(n) == "SubqueryAlias"}
    registry = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    for node in nodes:
        if _name(node) == "UnresolvedRelation":
            parts = _items(node.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in views | own:
                raise Refused(f"only the given views can be read, not {'.'.join(parts)}")
        for e in _expressions(node):
            if _name(e) in ("UnresolvedFunction", "UnresolvedGenerator"):
                parts = _items(e.nameParts()) if _name(e) == "UnresolvedFunction" else _function_parts(e)
                info = registry.lookupFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(parts[-1].lower())) if len(parts) == 1 else None
                if info is None or not info.isDefined() or info.get().getGroup() not in FUNCTION_GROUPS:
                    raise Refused(f"function {'.'.join(parts)} is not allowed")


def _function_parts(generator) -> list[str]:
    name = generator.name()
    return [*([name.database().get()] if name.database().isDefined() else []), name.funcName()]


def check_resolved(df: DataFrame, views: set[str]) -> None:
    """Refuses a resolved query that reads anything but the views, or asks for facts about the session."""
    for node in _plans(df._jdf.queryExecution().analyzed(), ("View",)):
        if _name(node) == "View" and node.desc().identifier().table().lower() not in views:
            raise Refused("only the given views can be read")
        if _name(node) != "View" and not node.children().size() and _name(node) not in ("OneRowRelation", "LocalRelation", "CTERelationRef", "UnionLoopRef"):
            raise Refused(f"only the given views can be read, not {_name(node)}")
        for e in _expressions(node):
            if _name(e) in SESSION_FACTS:
                raise Refused(f"{_name(e)} is not allowed")


def guarded_sql(spark: SparkSession, views: dict[str, DataFrame], statement: str, limit: int = 50) -> tuple[DataFrame, bool]:
    """Runs one query over the given views; at most `limit` rows come back, with whether some were left out.

    The statement is parsed and resolved in a session of its own, which holds nothing but the views: calls at the same time don't
    disturb each other, and views and settings of the caller's session stay as they are. ValueError says why a statement is refused.
    """
    names = {name.lower() for name in views}
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    text = statement.strip().rstrip(";").strip()
    check_parsed(own, text, names)
    shared = {name: f"guarded_{uuid.uuid4().hex}" for name in views}
    try:
        for name, df in views.items():
            df.createGlobalTempView(shared[name])
            own.table(f"global_temp.{shared[name]}").createOrReplaceTempView(name)
        try:
            rows = own.sql(text)
        except PySparkException as e:
            raise Refused(f"the statement can't be resolved: {e.getCondition() or 'error'}") from e
        check_resolved(rows, names)
        found = rows.limit(limit + 1).collect()  # limit + 1 rows at most
    finally:
        for name in shared.values():
            spark.catalog.dropGlobalTempView(name)
    return spark.createDataFrame(found[:limit], rows.schema), len(found) > limit
