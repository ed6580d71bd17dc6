"""The scalar functions hub users know from their databases, as column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions.moments import unix_micros

# Names and short names of date parts.
DATE_PARTS: dict[str, tuple[str, ...]] = {
    "year": ("year", "yy", "yyyy"),
    "quarter": ("quarter", "qq", "q"),
    "month": ("month", "mm", "m"),
    "day": ("day", "dd", "d", "dayofyear", "dy", "y"),
    "week": ("week", "wk", "ww"),
    "hour": ("hour", "hh"),
    "minute": ("minute", "mi", "n"),
    "second": ("second", "ss", "s"),
    "millisecond": ("millisecond", "ms"),
}
# Length in microseconds that a date difference counts for each part.
PART_MICROS = {
    "year": 31_536_000_000_000,
    "quarter": 7_776_000_000_000,
    "month": 2_592_000_000_000,
    "week": 604_800_000_000,
    "day": 86_400_000_000,
    "hour": 3_600_000_000,
    "minute": 60_000_000,
    "second": 1_000_000,
    "millisecond": 1_000,
}
_PART_OF = {alias: part for part, aliases in DATE_PARTS.items() for alias in aliases}


def date_part_name(part: str) -> str:
    """Canonical name of a date part; an unknown one counts as a day."""
    return _PART_OF.get(part.lower(), "day")


def date_diff(part: str, start: Column, end: Column) -> Column:
    """Whole units between two moments, every unit taken as a fixed span (a month is 30 days)."""
    return F.floor((unix_micros(end) - unix_micros(start)) / F.lit(PART_MICROS[date_part_name(part)]))


def date_add(part: str, count: Column, moment: Column) -> Column:
    """Calendar addition; a quarter is three months."""
    unit, times = date_part_name(part).upper(), count
    if unit == "QUARTER":
        unit, times = "MONTH", count * 3
    return F.timestamp_add(unit, times, moment)


def is_null(value: Column, fallback: Column) -> Column:
    return F.coalesce(value, fallback)


def char_index(needle: str, haystack: Column, start: int = 1) -> Column:
    """1-based position at or after ``start``, 0 when absent."""
    return F.locate(needle, haystack, start)


def text_length(value: Column) -> Column:
    return F.length(value)


def to_str(value: Column) -> Column:
    return value.cast("string")


def choose(index: Column, *choices: Column) -> Column:
    """The index-th choice, NULL outside the list."""
    return F.when((index >= 1) & (index <= len(choices)), F.element_at(F.array(*choices), index.cast("int")))


def try_convert(sql_type: str, value: Column) -> Column:
    """Cast that yields NULL where the value does not fit."""
    return value.try_cast(sql_type)


def new_id() -> Column:
    return F.uuid()
