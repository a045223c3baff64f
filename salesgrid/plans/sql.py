"""Read-only SQL over the registered views.

The guard reads the statement's unresolved plan, as Spark's own parser makes it, not its text:
every node must be one of the forms that read, every relation a view of the session or a table
expression of the statement, and every function one of Spark's own that stays inside the query.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

# The parser's nodes that only read.
READING = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Join LateralJoin SubqueryAlias"
    " UnresolvedSubqueryColumnAliases UnresolvedWith UnresolvedHaving UnresolvedRelation UnresolvedInlineTable"
    " UnresolvedTableValuedFunction UnresolvedTVFAliases OneRowRelation LocalRelation Generate Pivot Unpivot"
    " Union Except Intersect WithWindowDefinition Window Sample UnresolvedOrdinal".split()
)
# Functions that reach into the JVM, the files or the session.
REACHING = frozenset(
    "reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length"
    " current_user user session_user current_catalog current_database current_schema version raise_error"
    " read_files read_kafka spark_partition_id monotonically_increasing_id python_worker_logs".split()
)


def _items(seq) -> Iterator:
    for i in range(seq.size()):
        yield seq.apply(i)


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _expressions(expression) -> Iterator:
    yield expression
    for child in _items(expression.children()):
        yield from _expressions(child)


def _problem(plan, views: frozenset[str], functions: frozenset[str]) -> str | None:
    """What the plan holds that a read-only statement may not, or None."""
    kind = _name(plan)
    if kind not in READING:
        return f"statement part {kind}"
    if kind == "UnresolvedWith":
        named = set()
        for entry in _items(plan.cteRelations()):
            found = _problem(entry._2(), views | named, functions)
            if found:
                return found
            named.add(entry._1().lower())
        return _problem(plan.child(), views | named, functions)
    if kind == "UnresolvedRelation":
        parts = list(_items(plan.multipartIdentifier()))
        return None if len(parts) == 1 and parts[0].lower() in views else f"relation {'.'.join(parts)}"
    if kind == "UnresolvedTableValuedFunction":
        parts = list(_items(plan.name()))
        if len(parts) != 1 or parts[0].lower() not in functions:
            return f"function {'.'.join(parts)}"
    for top in _items(plan.expressions()):
        for e in _expressions(top):
            if _name(e) == "UnresolvedFunction":
                parts = list(_items(e.nameParts()))
                if len(parts) != 1 or parts[0].lower() not in functions:
                    return f"function {'.'.join(parts)}"
            elif _name(e) == "UnresolvedGenerator":
                if e.name().unquotedString().lower() not in functions:
                    return f"function {e.name().unquotedString()}"
            elif _name(e) in ("ScalarSubquery", "LateralSubquery", "Exists", "ListQuery"):
                found = _problem(e.plan(), views, functions)
                if found:
                    return found
    for child in _items(plan.children()):
        found = _problem(child, views, functions)
        if found:
            return found
    return None


def safe_sql(spark: SparkSession, sql: str) -> tuple[str | None, str]:
    """(why the statement is refused, or None; the statement without its trailing semicolon)."""
    statement = sql.strip().rstrip(";").strip()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except ParseException:
        return "not one statement", statement
    views = frozenset(t.name.lower() for t in spark.catalog.listTables() if t.isTemporary)
    own = frozenset(r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect())
    return _problem(plan, views, own - REACHING), statement


def run_sql(spark: SparkSession, sql: str, max_rows: int | None = None) -> DataFrame:
    """Run a SELECT over the session's temporary views; all its rows, or at most `max_rows`."""
    refused, statement = safe_sql(spark, sql)
    if refused:
        raise ValueError(f"Only SELECT statements over the registered views are allowed: {refused}.")
    rows = spark.sql(statement)
    return rows if max_rows is None else rows.limit(max_rows)
