"""Dates and times written as ISO or day/month/year text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions.moments import from_micros, iso_millis
from tabloom.functions.text import on_trimmed, trimmed

# The accepted spellings, for years from 100 on.  A time of day may follow a date, with fraction and zone.
TIME_PART = r"(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?"
ISO_DATE = r"^(?!00)\d{4}-\d{2}-\d{2}" + TIME_PART
SLASH_DATE = r"^\d{1,2}/\d{1,2}/(?!00)\d{4}" + TIME_PART
CLOCK = r"^\d{1,2}:\d{2}(:\d{2})?"
VALID_CLOCK = r"^(?:\d|[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d)?$"
TIME_START = r"[T ]\d{2}:\d{2}"


def date_of(text: Column, end: str = "$") -> Column:
    """Calendar date of a date-like text, NULL when there is no such day.

    Between slashes the day comes first.  Where that gives no existing day the month may come first, which can only
    succeed when the second number is too large for a month.  ``end`` is the pattern of what may follow.
    """
    first = F.substring_index(text, "/", 1)
    second = F.substring_index(F.substring_index(text, "/", 2), "/", -1)
    year = F.substring(F.substring_index(text, "/", -1), 1, 4)
    day_first = F.concat_ws("-", year, second, first).try_cast("date")
    month_first = F.concat_ws("-", year, first, second).try_cast("date")
    return F.when(text.rlike(ISO_DATE + end), F.substring(text, 1, 10).try_cast("date")).when(
        text.rlike(SLASH_DATE + end), F.coalesce(day_first, month_first)
    )


def normalize_date(value: Column) -> Column:
    """ISO spelling of a date-like text, time part unchanged; NULL when it is no existing date."""
    return on_trimmed(
        value, lambda text: F.concat(date_of(text).cast("string"), F.regexp_extract(text, f"{TIME_PART}$", 0))
    )


def has_time_part(value: Column) -> Column:
    """True for a date-like text that carries a time of day."""
    return F.coalesce(normalize_date(value).rlike(TIME_START), F.lit(False))


def to_date(value: Column) -> Column:
    """Calendar date of a date-like text, time of day dropped."""
    return on_trimmed(value, date_of)


def to_datetime(value: Column) -> Column:
    """Wall-clock timestamp of a date-like text: zone dropped, cut to milliseconds, midnight when no time is given."""

    def moment(text: Column) -> Column:
        clock = F.regexp_extract(text, r"[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,3})?)?)", 1)
        return F.concat(date_of(text).cast("string"), F.lit(" "), clock).try_cast("timestamp_ntz")

    return on_trimmed(value, moment)


def to_time(value: Column) -> Column:
    """``HH:mm:ss`` of a clock text; NULL for hours beyond 23."""

    def clock(text: Column) -> Column:
        size = F.length(text)
        tens, seconds = F.when(size.isin(4, 7), "0").otherwise(""), F.when(size < 6, ":00").otherwise("")
        return F.when(text.rlike(VALID_CLOCK), F.concat(tens, text, seconds))

    return on_trimmed(value, clock)


def excel_serial(value: Column, sql_type: str) -> Column:
    """ISO text of a spreadsheet serial day number in a date column; any other text is returned as it is."""
    text = trimmed(value)
    number = F.when(text.rlike(r"^\d+(\.\d+)?$"), text.try_cast("double"))
    millis = F.round((number - 25569) * 86400000).cast("bigint")
    moment = from_micros(millis * 1000)
    spelled = moment.cast("date").cast("string") if sql_type == "DATE" else iso_millis(moment)
    return F.when((number > 0) & (number <= 100000), spelled).otherwise(value)
