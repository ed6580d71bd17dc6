"""Values as people and feeds read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.moments import iso_millis, unix_micros

# Size units, each 1024 times the one before.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")


def time_cell(value: Column) -> Column:
    """Clock text of a time that arrived as a moment of 1 January 1970; other values unchanged."""
    clock = F.regexp_extract(value, r"^1970-01-01T(\d{2}:\d{2}:\d{2})", 1)
    return F.coalesce(F.nullif(clock, F.lit("")), value)


def size_text(size: Column) -> Column:
    """``1.5 KB``: whole bytes below 1024, one decimal above."""
    number = size.cast("double")
    text = F.lit(None).cast("string")
    for power, unit in enumerate(SIZE_UNITS):
        scaled = F.format_string("%.1f " + unit, number / 1024**power) if power else \
            F.concat(size.cast("bigint").cast("string"), F.lit(" " + unit))
        text = F.when(number >= 1024**power, scaled).otherwise(text)
    return F.when(F.coalesce(number, F.lit(0.0)) == 0, "0 B").otherwise(text)


def duration_text(millis: Column) -> Column:
    """``250ms``, ``12s``, ``3m 4s`` or ``2h 5m``."""
    def part(divisor: int, unit: str, modulus: int | None = None) -> Column:
        whole = F.floor(millis / divisor)
        return F.concat((whole % modulus if modulus else whole).cast("string"), F.lit(unit))

    space = F.lit(" ")
    return (
        F.when(millis < 1000, F.concat(millis.cast("string"), F.lit("ms")))
        .when(millis < 60_000, part(1000, "s"))
        .when(millis < 3_600_000, F.concat(part(60_000, "m"), space, part(1000, "s", 60)))
        .otherwise(F.concat(part(3_600_000, "h"), space, part(60_000, "m", 60)))
    )


def age_text(moment: Column, now: Column) -> Column:
    """How long ago: ``agora``, ``há 5 min``, ``há 3h`` or ``há 2d``."""
    minutes = F.floor((unix_micros(now) - unix_micros(moment)) / 60_000_000)

    def ago(divisor: int, unit: str) -> Column:
        return F.concat(F.lit("há "), F.floor(minutes / divisor).cast("string"), F.lit(unit))

    return (
        F.when(minutes < 1, "agora")
        .when(minutes < 60, ago(1, " min"))
        .when(minutes < 1440, ago(60, "h"))
        .otherwise(ago(1440, "d"))
    )


def feed_value(value: Column, data_type: T.DataType) -> Column:
    """A value as the feed carries it: numbers beyond double precision, moments and nested values as text."""
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        if isinstance(data_type, T.TimestampType):
            value = F.convert_timezone(None, F.lit("UTC"), value.cast("timestamp_ntz"))
        return iso_millis(value)
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        infinite = F.abs(value) == float("inf")
        return (
            F.when(F.isnan(value), "NaN")
            .when(infinite & (value > 0), "INF")
            .when(infinite, "-INF")
            .otherwise(value.cast("string"))
        )
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    return value.cast("string")
