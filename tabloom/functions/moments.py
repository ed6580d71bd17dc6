"""Arithmetic and spelling of wall-clock timestamps that do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch() -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz")


def unix_micros(moment: Column) -> Column:
    """Microseconds since 1970 as the clock on the wall counts them."""
    since = (moment.cast("timestamp_ntz") - epoch()).cast("interval second")
    return (since.cast("decimal(20,6)") * 1_000_000).cast("bigint")


def from_micros(micros: Column) -> Column:
    """The wall-clock timestamp so many microseconds after 1970."""
    return F.timestamp_add("MICROSECOND", micros, epoch())


def iso_millis(moment: Column) -> Column:
    """``2024-01-31T08:30:00.000Z`` of a wall-clock timestamp."""
    text = moment.cast("timestamp_ntz").cast("string")
    clock, fraction = F.substring(text, 12, 8), F.rpad(F.substring(text, 21, 3), 3, "0")
    return F.concat(F.substring(text, 1, 10), F.lit("T"), clock, F.lit("."), fraction, F.lit("Z"))
