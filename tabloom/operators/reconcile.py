"""Does the target hold what the source holds: counts, fingerprints, losses between stages."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom import types as hub
from tabloom.functions.convert import DECIMAL_LIMIT

# Years a target database can hold.
FIRST_YEAR, LAST_YEAR = 1753, 9999
LEAF_LINES = 65_536  # distinct rows per leaf of the fingerprint tree, about
STEP_DIGITS = 4  # hex digits by which the tree narrows per level: 65 536 children at most


def compared_text(value: Column, data_type: T.DataType) -> Column:
    """One value as source and target spell it alike: what a target cannot hold is NULL, decimals have four places."""
    canonical = hub.canonical_from_spark(data_type)
    text = value.cast("string")
    if canonical in (hub.DATE, hub.DATETIME):
        text = F.when(F.year(value).between(FIRST_YEAR, LAST_YEAR), text)
    elif canonical == hub.DECIMAL:
        text = F.when(F.abs(value) < DECIMAL_LIMIT, value.try_cast(T.DecimalType(18, 4)).cast("string"))
    elif isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(value)
    return text


def line_digests(df: DataFrame, *beside: Column) -> DataFrame:
    """MD5 of every row's compared text, and columns ``beside`` it.

    A value stands behind its length in bytes, NULL is a dash: a bar inside a value, an empty text and NULL differ.
    """
    texts = [compared_text(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    fields = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return df.select(F.md5(F.concat_ws("|", *fields)).alias("h"), *beside)


def leaf_digits(row_count: int) -> int:
    """Hex digits of the leaf prefix that keep a leaf near ``LEAF_LINES`` distinct rows."""
    return max(1, math.ceil(math.log(max(row_count, 1) / LEAF_LINES, 16))) if row_count > LEAF_LINES else 1


def table_fingerprint(df: DataFrame, digits: int) -> DataFrame:
    """Row count and one digest of the content, whatever the order of the rows.

    Equal rows are counted before the shuffle, so a row that repeats without end is one line.  The sorted lines of all
    hashes with the same prefix make a leaf; leaves are digested level by level.  No task sees more than a leaf, or
    65 536 children.  Both sides of a comparison must use the same ``digits`` (``leaf_digits`` of the larger count).
    """
    counted = line_digests(df).groupBy("h").agg(F.count(F.lit(1)).alias("n"))

    def joined(line: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_list(line)), "")

    level = counted.groupBy(F.substring("h", 1, digits).alias("prefix")).agg(
        F.md5(joined(F.concat_ws(":", "h", "n"))).alias("digest"), F.sum("n").alias("row_count")
    )
    while digits > 0:
        digits = max(0, digits - STEP_DIGITS)
        parent = F.substring("prefix", 1, digits)
        level = level.groupBy(parent.alias("prefix")).agg(
            F.md5(joined(F.concat("prefix", F.lit("="), "digest"))).alias("digest"),
            F.sum("row_count").alias("row_count"),
        )
    return level.select("row_count", F.col("digest").alias("fingerprint"))


def fingerprint_sums(df: DataFrame, *parts: Column) -> DataFrame:
    """Row count and two sums over the row digests, for each value of named columns ``parts`` if any are given: no shuffle of rows
    at all, one partial sum per task.

    Each sum adds fifteen hex digits of all digests.  A task adds their upper 28 and lower 32 bits as whole numbers, which
    hold the rows of any task; these few sums are then added as decimals.
    """
    starts = {"sum_high": 1, "sum_low": 17}
    digests = line_digests(df, *parts)
    names = digests.columns[1:]
    numbers = digests.select(
        F.spark_partition_id().alias("task"),
        *names,
        *[F.conv(F.substring("h", start, 15), 16, 10).cast("bigint").alias(name) for name, start in starts.items()],
    )
    upper = [F.sum(F.shiftright(name, 32)).alias(f"{name}_upper") for name in starts]
    lower = [F.sum(F.col(name).bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"{name}_lower") for name in starts]
    tasks = numbers.groupBy("task", *names).agg(F.count(F.lit(1)).alias("n"), *upper, *lower)

    def whole(name: str) -> Column:
        return F.coalesce(F.sum(F.col(name).cast("decimal(28,0)")), F.lit(0).cast("decimal(38,0)"))

    return tasks.groupBy(*names).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        *[(whole(f"{name}_upper") * 2**32 + whole(f"{name}_lower")).cast("string").alias(name) for name in starts],
    )


def compare_tables(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Counts of two tables and whether their content is equal, for each named pair."""
    return compare_sums({name: (fingerprint_sums(a), fingerprint_sums(b)) for name, (a, b) in pairs.items()})


def compare_sums(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``compare_tables`` of what ``fingerprint_sums`` says of source and target."""
    def one(name: str, source: DataFrame, target: DataFrame) -> DataFrame:
        sides = source.withColumn("side", F.lit("source")).unionByName(target.withColumn("side", F.lit("target")))

        def of(side: str, column: str) -> Column:
            return F.max(F.when(F.col("side") == side, F.col(column)))

        same = [of("source", c) == of("target", c) for c in ("row_count", "sum_high", "sum_low")]
        return sides.agg(
            of("source", "row_count").alias("source_count"),
            of("target", "row_count").alias("target_count"),
            reduce(lambda a, b: a & b, same).alias("equal"),
        ).select(F.lit(name).alias("table_name"), "source_count", "target_count", "equal")

    return reduce(DataFrame.unionByName, [one(name, a, b) for name, (a, b) in pairs.items()])


def table_counts(tables: dict[str, DataFrame], label: str) -> DataFrame:
    """Physical row count of each named table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias(label)).select(F.lit(name).alias("table_name"), label)
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def count_audit(sources: DataFrame, targets: DataFrame, catalog: DataFrame) -> DataFrame:
    """Source, physical and recorded count of each table, and whether the three agree."""
    joined = sources.join(targets, "table_name", "full").join(catalog, "table_name", "full")
    agree = F.col("source_count").eqNullSafe(F.col("target_count")) & F.col("catalog_count").eqNullSafe(
        F.col("target_count")
    )
    return joined.select(
        "table_name",
        "source_count",
        "target_count",
        "catalog_count",
        F.when(agree, "ok").otherwise("diff").alias("status"),
    )


def loss_funnel(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows at each stage of a load and how many were lost since the stage before."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(i).cast("bigint").alias("step"), F.lit(name).alias("stage"), "row_count"
        )
        for i, (name, df) in enumerate(stages, start=1)
    ]
    in_order = Window.partitionBy(F.lit(0)).orderBy("step")  # one row per stage
    return reduce(DataFrame.unionByName, counts).withColumn(
        "lost", F.coalesce(F.lag("row_count").over(in_order) - F.col("row_count"), F.lit(0))
    )


def content_check(df: DataFrame, group: str, number: str) -> DataFrame:
    """Count, extent and sum of a number per lot, to see that an expected lot arrived whole."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(number).alias("min_value"),
        F.max(number).alias("max_value"),
        F.sum(number).alias("sum_value"),
    )


def orphan_staging(tables: DataFrame, prefix: str) -> DataFrame:
    """Staging tables that an interrupted load left behind, by their name."""
    return tables.where(F.col("table_name").startswith(prefix))
