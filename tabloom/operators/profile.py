"""Column statistics, type inference and table profiles over raw text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom import types as hub
from tabloom.functions import convert, dates
from tabloom.functions.text import BLANKS, left_trimmed
from tabloom.naming import header_marks_identifier, normalize_headers
from tabloom.types import ColumnSpec, header_of

# One bit per property of a value.
_INT, _DECIMAL, _DATE, _CLOCK = 1, 2, 4, 8  # must hold for all values of a column
_TIME_PART, _IDENTIFIER = 16, 32  # one value is enough


def _value_bits(text: Column) -> Column:
    """The properties of one value as a bit set; NULL for a blank, which aggregates skip.

    ``text`` has no blanks at its start and may have some at its end.  Plain character tests decide which shape a value
    can have at all, so that most values meet one pattern only; text that starts with a letter meets none.
    """
    end = f"[{BLANKS}]*$"
    starts_typed = ((text >= "0") & (text < ":")) | text.startswith("-")
    is_date = dates.date_of(text, end).isNotNull()
    timed = F.when(text.rlike(dates.CLOCK + end), _CLOCK).when(is_date, _DATE | _TIME_PART)
    zero_led = text.startswith("0") & text.rlike(convert.LEADING_ZERO)
    whole = F.when(zero_led, _IDENTIFIER).otherwise(_INT | _DECIMAL)
    shape = (
        F.when(text.contains(":"), timed)
        .when(text.contains("/"), F.when(is_date, _DATE))
        .when(text.contains(",") | text.contains("."), F.when(text.rlike(convert.DECIMAL + end), _DECIMAL))
        .when(text.rlike(convert.INTEGER + end), whole)
        .when(is_date, _DATE)
    )
    return F.when(starts_typed, F.coalesce(shape, F.lit(0))).when(text != "", 0)


STATS = (
    "ordinal", "column_name", "sample_count", "has_null", "max_len", "all_int", "all_decimal", "all_date", "has_time",
    "all_time", "looks_identifier",
)
MEASURES = ("row_count", "sample_count", "every", "some", "max_len", "text_bytes")


def column_stats(df: DataFrame) -> DataFrame:
    """One row per column over all rows of a text DataFrame: what its values have in common."""
    return _full_stats(df).select(*STATS)


def _measured(df: DataFrame, part: Column | None = None) -> DataFrame:
    """What the values at each position have in common, for each ``part`` of the rows if one is given.

    Rows are turned into (position, value) pairs, so that one small expression, compiled once, classifies the values of
    all columns however wide the table is.  Bitwise aggregates by position, combined inside each map task, then answer
    all questions in one pass; what is shuffled is one row per column, part and task.
    """
    pairs = F.posexplode(F.array(*[F.col(f"`{c}`") for c in df.columns])).alias("at", "value")
    values = df.select(pairs) if part is None else df.select(part.alias("part"), pairs)
    return (
        values.withColumn("text", left_trimmed(F.col("value")))
        .withColumn("bits", _value_bits(F.col("text")))
        .groupBy("at", *[] if part is None else ["part"])
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count("bits").alias("sample_count"),
            F.bit_and("bits").alias("every"),
            F.bit_or("bits").alias("some"),
            F.max(F.when(F.col("bits").isNotNull(), F.length("value"))).alias("max_len"),
            F.sum(F.octet_length("value")).alias("text_bytes"),
        )
    )


def part_profiles(df: DataFrame, part: Column) -> DataFrame:
    """(part, column_name, ...) for each part of the rows, such as a file: one row per column, to be stored and merged.

    A part without rows has none.  ``merged_stats`` of the profiles of any parts is ``column_stats`` of their rows, so a table
    that grows by files is profiled by its new files alone.
    """
    names = F.array(*[F.lit(c) for c in df.columns])
    measured = _measured(df, part)
    return measured.select("part", F.element_at(names, F.col("at") + 1).alias("column_name"), *MEASURES)


def merged_stats(profiles: DataFrame, names: list[str]) -> DataFrame:
    """``column_stats`` of all rows from the profiles of their parts; a column that a part lacks counts as NULL there.

    Profiles are small rows, combined in map tasks; only sums, maxima and bits are formed, in any order.
    """
    whole = profiles.groupBy("part").agg(F.max("row_count").alias("part_rows"))
    rows = whole.agg(F.sum("part_rows").alias("all_rows"))
    at = F.array_position(F.array(*[F.lit(c) for c in names]), F.col("column_name"))
    combined = (
        profiles.withColumn("at", (at - 1).cast("int"))
        .where("at >= 0")
        .groupBy("at")
        .agg(
            F.sum("sample_count").alias("sample_count"),
            F.bit_and("every").alias("every"),
            F.bit_or("some").alias("some"),
            F.max("max_len").alias("max_len"),
            F.sum("text_bytes").alias("text_bytes"),
        )
        .withColumn("row_count", rows.scalar())
    )
    return _stats_of(combined, names).select(*STATS)


def _full_stats(df: DataFrame) -> DataFrame:
    """Column statistics with row count and text size."""
    return _stats_of(_measured(df), df.columns)


def _stats_of(per_column: DataFrame, names: list[str]) -> DataFrame:
    """The statistics that bits and counts by position amount to."""
    # A table without rows still has columns.
    columns = per_column.sparkSession.range(len(names), numPartitions=1).select(F.col("id").cast("int").alias("at"))
    found = columns.join(F.broadcast(per_column), "at", "left")  # one row per column on either side

    def every(bit: int) -> Column:
        return F.coalesce(F.col("every").bitwiseAND(bit) != 0, F.lit(True))

    def some(bit: int) -> Column:
        return F.coalesce(F.col("some").bitwiseAND(bit) != 0, F.lit(False))

    def number(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)

    return found.select(
        (F.col("at") + 1).alias("ordinal"),
        F.element_at(F.array(*[F.lit(c) for c in names]), F.col("at") + 1).alias("column_name"),
        number("sample_count"),
        F.coalesce(F.col("sample_count") < F.col("row_count"), F.lit(False)).alias("has_null"),
        number("max_len"),
        every(_INT).alias("all_int"),
        every(_DECIMAL).alias("all_decimal"),
        every(_DATE).alias("all_date"),
        some(_TIME_PART).alias("has_time"),
        every(_CLOCK).alias("all_time"),
        some(_IDENTIFIER).alias("looks_identifier"),
        number("row_count"),
        number("text_bytes"),
    )


def infer_schema(df: DataFrame) -> DataFrame:
    """Ordinal, header, table column name and canonical type of every column of a text DataFrame."""
    return _typed(column_stats(df), df)


def _typed(stats: DataFrame, df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    headers = F.array(*[F.lit(header_of(f)) for f in df.schema.fields])
    names = F.array(*[F.lit(n) for n in normalize_headers(df.columns)])
    marked = F.array(*[F.lit(header_marks_identifier(header_of(f))) for f in df.schema.fields])
    position = F.col("ordinal")
    sql_type = (
        F.when(F.col("sample_count") == 0, hub.TEXT)
        .when(F.col("looks_identifier") | F.element_at(marked, position), hub.TEXT)
        .when(F.col("all_int"), hub.BIGINT)
        .when(F.col("all_decimal"), hub.DECIMAL)
        .when(F.col("all_date") & F.col("has_time"), hub.DATETIME)
        .when(F.col("all_date"), hub.DATE)
        .when(F.col("all_time"), hub.TIME)
        .otherwise(hub.TEXT)
    )
    return stats.select(
        "ordinal",
        F.element_at(headers, position).alias("original_name"),
        F.element_at(names, position).alias("sql_name"),
        sql_type.alias("sql_type"),
        *extra,
    )


def infer_mapping(df: DataFrame) -> list[ColumnSpec]:
    """The inferred columns as a mapping: an action that returns one small row per column."""
    return [
        ColumnSpec(r.original_name, r.sql_name, r.sql_type)
        for r in infer_schema(df).orderBy("ordinal").collect()
    ]


def native_mapping(df: DataFrame) -> list[ColumnSpec]:
    """Mapping from the types a reader already gave the columns; identifier headers are text all the same."""
    return [
        ColumnSpec(
            header_of(field),
            name,
            hub.TEXT if header_marks_identifier(header_of(field)) else hub.canonical_from_spark(field.dataType),
        )
        for field, name in zip(df.schema.fields, normalize_headers(df.columns))
    ]


def preview(df: DataFrame, order_by: list[str | Column], rows: int = 20) -> DataFrame:
    """The first rows, as a person sees them before a load."""
    return df.orderBy(*order_by).limit(rows)


def range_check(df: DataFrame, column: str) -> DataFrame:
    """Row count and extent of one column."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.min(column).alias("min_value"), F.max(column).alias("max_value")
    )


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns, text size and a histogram of inferred types (``BIGINT x3, DATE x1``) for each text table."""

    def one(name: str, df: DataFrame) -> DataFrame:
        stats = _full_stats(df)
        typed = _typed(stats, df, extra=("row_count", "text_bytes"))
        return (
            typed.groupBy("sql_type")
            .agg(F.count(F.lit(1)).alias("n"), F.max("row_count").alias("rows"), F.sum("text_bytes").alias("bytes"))
            .agg(
                F.max("rows").alias("row_count"),
                F.sum("n").alias("column_count"),
                F.sum("bytes").alias("text_bytes"),
                F.sort_array(F.collect_list(F.concat_ws(" x", "sql_type", "n"))).alias("types"),  # at most six
            )
            .select(
                F.lit(name).alias("table_name"),
                "row_count",
                "column_count",
                "text_bytes",
                F.array_join("types", ", ").alias("column_types"),
            )
        )

    return reduce(DataFrame.unionByName, [one(name, df) for name, df in tables.items()])


def largest(profile: DataFrame, by: str, count: int = 5) -> DataFrame:
    """The few largest (or slowest) entries of a profile, with their share of the total."""
    total = profile.agg(F.sum(by)).scalar()
    return (
        profile.withColumn("share", F.round(F.col(by) / total, 4))
        .orderBy(F.desc(by), "table_name")
        .limit(count)
    )


def list_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """Column listing of a source: table, position, column and canonical type, from analysis alone."""
    listed = [
        (name, i, f.name, hub.canonical_from_spark(f.dataType))
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(listed, "table_name string, ordinal bigint, column_name string, sql_type string")
