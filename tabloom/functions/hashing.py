"""Row fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions.text import has_text, without_controls


def _clean(value: Column) -> Column:
    """A value without control characters, breaks and bars, its quotes doubled; blank and NULL alike become empty."""
    text = value.cast("string")
    plain = F.replace(without_controls(text, also_space="|"), F.lit('"'), F.lit('""'))
    return F.when(has_text(text), plain).otherwise("")


def hash_field(value: Column) -> Column:
    """One value as it enters the row hash."""
    return F.concat(F.lit('"'), _clean(value), F.lit('"'))


def row_hash(columns: list[Column]) -> Column:
    """32 hex digits that identify the text of a row; column order matters."""
    quoted = F.concat(F.lit('"'), F.concat_ws('"|"', *[_clean(c) for c in columns]), F.lit('"'))
    return F.md5(quoted)


def digest_sum(digest: Column, start: int) -> Column:
    """Aggregate: the sum of fifteen hex digits of each digest, as text.  Order and partitioning do not matter."""
    number = F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(28,0)")
    return F.coalesce(F.sum(number), F.lit(0)).cast("string")
