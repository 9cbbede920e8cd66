"""Which SQL a chart spec may run: decided on the parsed statement, before anything is analysed or executed."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tablelens.sources.tables import CLEAN_VIEW

#: Parts of a plain query; a statement with any other part, such as a command, a union or a table function, is refused.
QUERY_PARTS = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Distinct", "SubqueryAlias", "UnresolvedHaving",
    "UnresolvedRelation", "WithWindowDefinition", "UnresolvedOrderBy", "Offset",
}
#: Functions that leave SQL, and those that hold all values of a group in one task.
FOREIGN_FUNCTIONS = {"reflect", "java_method", "try_reflect"}
UNBOUNDED_FUNCTIONS = {"median", "percentile", "percentile_cont", "percentile_disc", "mode", "collect_list", "collect_set", "array_agg"}


class RefusedSql(ValueError):
    """The statement is not a plain query of the cleaned view."""


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _class(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _check_expression(e) -> None:
    name = _class(e)
    if "Subquery" in name or name in ("Exists", "ListQuery"):
        raise RefusedSql("subqueries in expressions may not be used")
    if name == "UnresolvedFunction":
        function = _items(e.nameParts())[-1].lower()
        if function in FOREIGN_FUNCTIONS:
            raise RefusedSql(f"{function} may not be used")
        if function in UNBOUNDED_FUNCTIONS:
            raise RefusedSql(f"{function} holds a whole group in one task; use the aggregation MEDIAN on one column")
    if "Percentile" in name:
        raise RefusedSql("percentile holds a whole group in one task; use the aggregation MEDIAN on one column")
    for child in _items(e.children()):
        _check_expression(child)


def _check(plan) -> int:
    """Relations below this part, all of them the cleaned view."""
    name = _class(plan)
    if name not in QUERY_PARTS:
        raise RefusedSql(f"only a plain SELECT may be run, not {name}")
    found = 0
    if name == "UnresolvedRelation":
        parts = [p.lower() for p in _items(plan.multipartIdentifier())]
        if parts != [CLEAN_VIEW]:
            raise RefusedSql(f"only {CLEAN_VIEW} may be queried, not {'.'.join(parts)}")
        found = 1
    for e in _items(plan.expressions()):
        _check_expression(e)
    return found + sum(_check(child) for child in _items(plan.children()))


def check_sql(spark: SparkSession, query: str) -> None:
    """Raises RefusedSql (or a parse error) unless the text is one plain query over the cleaned view."""
    if not _check(spark._jsparkSession.sessionState().sqlParser().parsePlan(query)):
        raise RefusedSql(f"{CLEAN_VIEW} must be queried")
