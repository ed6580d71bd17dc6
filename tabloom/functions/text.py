"""Blanks, control characters and slugs."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.naming import HASH_DIGITS, MAX_SLUG

# The characters that count as blank at either end of a value.
BLANKS = "".join(
    chr(c)
    for c in (
        0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
        0x3000, 0xFEFF,
    )
)
LINE_BREAKS = "\n\r\t"
# The control characters that are dropped: C0 without TAB, LF and CR, and DEL.
CONTROLS = "".join(chr(c) for c in [*range(0x20), 0x7F] if chr(c) not in LINE_BREAKS)


_SPECIAL = r"[\x00-\x1f\x7f]"
_BLANK_EDGE = f"^[{BLANKS}]|[{BLANKS}]$"


def trimmed(value: Column) -> Column:
    """The value without blanks at either end."""
    return F.btrim(value, F.lit(BLANKS))


def left_trimmed(value: Column) -> Column:
    """The value without blanks at its start: cheap, and enough for patterns that allow blanks at the end.

    A value that starts with a visible ASCII character, as most do, is told by two comparisons and taken as it is.
    """
    return F.when((value >= "!") & (value < "\x7f"), value).otherwise(F.ltrim(value, F.lit(BLANKS)))


def has_text(value: Column) -> Column:
    """True when a value holds anything but blanks."""
    return left_trimmed(value) != ""


def on_trimmed(value: Column, convert: Callable[[Column], Column]) -> Column:
    """A conversion of the trimmed value.

    Few values have blanks at an edge, and trimming costs more than most conversions: the value is converted as it is,
    and trimmed only when that yields NULL and it has such blanks.
    """
    return F.coalesce(convert(value), F.when(value.rlike(_BLANK_EDGE), convert(trimmed(value))))


def without_controls(value: Column, also_space: str = "") -> Column:
    """Control characters dropped, line breaks (and ``also_space``) turned into spaces, in one pass over the values that
    have any."""
    spaced = LINE_BREAKS + also_space
    cleaned = F.translate(value, spaced + CONTROLS, " " * len(spaced))
    special = _SPECIAL[:-1] + also_space + "]"
    return F.when(value.rlike(special), cleaned).otherwise(value)


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by Unicode decomposition."""
    accented, base = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        folded = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if folded != chr(code) and len(folded) == 1:
            accented.append(chr(code))
            base.append(folded)
    return "".join(accented), "".join(base)


def slug(value: Column, limit: int = MAX_SLUG) -> Column:
    """Slug of each value of a column; NULL where no letter or digit is left."""
    accented, base = _accent_table()
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    plain = F.lower(F.translate(value, accented + marks, base))
    dashed = F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-"))
    digest = F.substring(F.sha2(dashed, 256), 1, HASH_DIGITS)
    shortened = F.concat(F.substring(dashed, 1, limit - HASH_DIGITS - 1), F.lit("_"), digest)
    return F.nullif(F.when(F.length(dashed) > limit, shortened).otherwise(dashed), F.lit(""))
