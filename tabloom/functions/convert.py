"""Text to the canonical types.  A value that does not convert becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom import types as hub
from tabloom.functions.dates import to_date, to_datetime, to_time
from tabloom.functions.moments import unix_micros
from tabloom.functions.text import has_text, on_trimmed, without_controls

# How whole and decimal numbers start when types are inferred.  A leading zero makes an identifier.
INTEGER = r"^-?\d++"
LEADING_ZERO = r"^0\d++"
DECIMAL = r"^-?(?:\d{1,3}(?:[.,]\d{3})*,\d++|\d++[.,]\d++)"
DECIMAL_LIMIT = 1e14


def to_bigint(value: Column) -> Column:
    return on_trimmed(value, lambda text: F.when(text.rlike(INTEGER + "$"), text.try_cast("bigint")))


def to_decimal(value: Column) -> Column:
    """Number whose decimal mark is whichever of ``,`` and ``.`` comes last; the other one groups thousands."""

    def number(text: Column) -> Column:
        def behind(mark: str) -> Column:  # characters after the last such mark, all of them when there is none
            return F.length(F.substring_index(text, mark, -1))

        def without(mark: str) -> Column:
            return F.replace(text, F.lit(mark), F.lit(""))

        comma_decimal = F.replace(without("."), F.lit(","), F.lit("."))
        plain = F.when(behind(".") > behind(","), comma_decimal).otherwise(without(","))
        return plain.try_cast(T.DecimalType(18, 4))

    return on_trimmed(value, number)


def to_text(value: Column) -> Column:
    return F.when(has_text(value), without_controls(value))


_CONVERTERS = {
    hub.BIGINT: to_bigint,
    hub.DECIMAL: to_decimal,
    hub.DATE: to_date,
    hub.DATETIME: to_datetime,
    hub.TIME: to_time,
    hub.TEXT: to_text,
}


def convert(value: Column, sql_type: str) -> Column:
    """Text column as a canonical type."""
    return _CONVERTERS[sql_type](value)


def convert_source(value: Column, data_type: T.DataType) -> Column:
    """Column of an external source as its canonical type: what does not fit is NULL, nested values are JSON text."""
    canonical = hub.canonical_from_spark(data_type)
    if canonical == hub.DECIMAL:
        fits = F.abs(value) < DECIMAL_LIMIT
        if isinstance(data_type, (T.FloatType, T.DoubleType)):
            fits = fits & ~F.isnan(value)
        return F.when(fits, value.try_cast(hub.SPARK_TYPES[hub.DECIMAL]))
    if canonical in (hub.BIGINT, hub.DATE):
        return value.cast(hub.SPARK_TYPES[canonical])
    if canonical == hub.DATETIME:
        moment = value.cast("timestamp_ntz")
        return F.timestamp_add("MICROSECOND", -(unix_micros(moment) % 1000), moment)
    if canonical == hub.TIME:
        return F.substring(value.cast("string"), 1, 8)
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    return value.cast("string")
