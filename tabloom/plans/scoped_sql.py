"""Read-only SQL over the tables of a scope.

Parsing, name resolution, planning and execution are Spark's; this module decides which names are visible and which
statements are allowed, by looking at the plan Spark's parser returns.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.ranking import page

MAX_CHARS = 50_000
# The plan nodes a SELECT may consist of; commands, writes, scripts and names built at run time are not among them.
QUERY_NODES = frozenset(
    """
    Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset
    OneRowRelation PipeOperator Pivot Project Sample Sort SubqueryAlias Union Unpivot UnresolvedHaving UnresolvedHint
    UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction
    UnresolvedTVFAliases UnresolvedWith Window WithWindowDefinition
    """.split()
)
ROOTS_WITHOUT_SELECT = frozenset({"LocalRelation", "UnresolvedInlineTable", "UnresolvedRelation"})


class ReadOnlyError(ValueError):
    """A statement that is not one plain SELECT."""


class ScopeError(ValueError):
    """A statement that names a table outside its scope, or one that several datasets have."""


def _items(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def _nodes(plan) -> Iterator:
    """A parsed plan and all plans inside it: inputs, common table expressions and subqueries."""
    yield plan
    for part in [*_items(plan.children()), *_items(plan.innerChildren())]:
        yield from _nodes(part)


# Built-in functions that call code outside the engine.
OUTSIDE_FUNCTIONS = {"reflect", "java_method", "try_reflect"}


def _function_names(expressions):
    for expression in expressions:
        if _kind(expression) == "UnresolvedFunction":
            yield [part.lower() for part in _items(expression.nameParts())]
        yield from _function_names(_items(expression.children()))


def _check_function(spark: SparkSession, parts: list[str], registry: str) -> None:
    """Only functions of Spark itself: one that a user registered may read files."""
    analysis = spark._jvm.org.apache.spark.sql.catalyst
    known = getattr(analysis.analysis, registry).builtin()
    if len(parts) > 1 or parts[0] in OUTSIDE_FUNCTIONS or not known.functionExists(analysis.FunctionIdentifier(parts[0])):
        raise ReadOnlyError(f"{'.'.join(parts)} is not allowed")


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _parsed(spark: SparkSession, sql: str):
    if not sql.strip():
        raise ReadOnlyError("empty statement")
    if len(sql) > MAX_CHARS:
        raise ReadOnlyError(f"statement exceeds {MAX_CHARS} characters")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as bad:
        raise ReadOnlyError("not one valid statement") from bad
    if _kind(plan) in ROOTS_WITHOUT_SELECT:
        raise ReadOnlyError("only SELECT and WITH are allowed")
    for node in _nodes(plan):
        if _kind(node) not in QUERY_NODES:
            raise ReadOnlyError(f"{_kind(node)} is not allowed")
        for parts in _function_names(_items(node.expressions())):
            _check_function(spark, parts, "FunctionRegistry")
        if _kind(node) == "UnresolvedTableValuedFunction":
            _check_function(spark, [part.lower() for part in _items(node.name())], "TableFunctionRegistry")
    return plan


def check_read_only(spark: SparkSession, sql: str) -> str:
    """The statement, if it is one SELECT or WITH that changes nothing."""
    _parsed(spark, sql)
    return sql.strip()


def _table_names(plan) -> tuple[set[str], set[str]]:
    """Names of the relations in a statement, and those that it defines itself.

    A name may be both: a definition hides a table in what follows it, not in its own body.
    """
    nodes = list(_nodes(plan))
    own = {
        cte.alias().lower()
        for node in nodes
        if _kind(node) == "UnresolvedWith"
        for cte in _items(node.innerChildren())
        if _kind(cte) == "SubqueryAlias"
    }
    named = {
        ".".join(_items(node.multipartIdentifier())).lower() for node in nodes if _kind(node) == "UnresolvedRelation"
    }
    return named, own


def resolve_tables(catalog: DataFrame) -> DataFrame:
    """Table names of a scope, in how many of its datasets each occurs, and whether it is ambiguous by itself."""
    return (
        catalog.groupBy("table_name", "dataset_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("table_name")
        .agg(F.count(F.lit(1)).alias("datasets"), F.min("dataset_id").alias("first_dataset"))
        .withColumn("ambiguous", F.col("datasets") > 1)
    )


def run_query(
    spark: SparkSession,
    sql: str,
    scope: Mapping[str, Mapping[str, DataFrame]],
    limit: int | None = None,
    offset: int = 0,
    order_by: list[str] | None = None,
) -> DataFrame:
    """Run one SELECT over a scope of ``{dataset: {table: DataFrame}}``.

    A table is visible as ``dataset__table`` and, when only one dataset of the scope has it, by its own name.
    """
    plan = _parsed(spark, sql)
    owners: dict[str, list[str]] = {}
    visible: dict[str, DataFrame] = {}
    for dataset, tables in scope.items():
        for table, df in tables.items():
            owners.setdefault(table.lower(), []).append(dataset)
            visible[f"{dataset}__{table}".lower()] = df
    for dataset, tables in scope.items():
        for table, df in tables.items():
            if len(owners[table.lower()]) == 1:
                visible[table.lower()] = df
    named, own = _table_names(plan)
    for name in sorted(named - own):
        if len(owners.get(name, [])) > 1:
            raise ScopeError(f"{name} is ambiguous: {', '.join(sorted(owners[name]))}")
        if name not in visible:
            raise ScopeError(f"{name} is not in the scope")
    for name in sorted((named & own) - set(visible)):
        if spark.catalog.tableExists(name):  # where the definition does not hide it, it must not lead out of the scope
            raise ScopeError(f"{name} is not in the scope")
    result = _analysed(spark, sql.strip().rstrip(";"), {name: visible[name] for name in named & set(visible)})
    return result if limit is None else page(result, limit, offset, order_by)


def _analysed(spark: SparkSession, sql: str, views: Mapping[str, DataFrame]) -> DataFrame:
    """A statement resolved in a session of its own, which has the same settings and no other names than ``views``.

    The caller's views and functions are neither seen nor touched, and statements of several threads do not meet.  The resolved
    plan comes back to the caller's session and runs there.
    """
    dataset, own, private = spark._jvm.org.apache.spark.sql.classic.Dataset, spark._jsparkSession, spark._jsparkSession.newSession()
    private.sessionState().conf().settings().putAll(own.sessionState().conf().settings())
    for name, df in views.items():
        dataset.ofRows(private, df._jdf.queryExecution().analyzed()).createOrReplaceTempView(name)
    return DataFrame(dataset.ofRows(own, private.sql(sql).queryExecution().analyzed()), spark)
