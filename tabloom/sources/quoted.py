"""Delimited files whose quoted values hold line breaks, read by many tasks.

Whether a line begins inside a quoted value depends on all lines before it, but only through one bit.  So a line is a function of
that bit, and so is a block of lines: functions compose, blocks are summed up independently, and a prefix over the few block
summaries of a file tells each block how it begins.  Then each block knows its records; of those that hold a break, or cross into
the next block, the lines are put together.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UTF8, WINDOWS = "UTF-8", "windows-1252"
# The characters of the bytes in which windows-1252 differs from ISO-8859-1, which Spark decodes.
_LATIN = "".join(chr(b) for b in range(0x80, 0xA0))
_WINDOWS = bytes(range(0x80, 0xA0)).decode("cp1252", errors="replace")
_THROUGH_CLOSING_QUOTE = '^(?:[^"]++|"")*+"'


def opens_quote(line: Column, separator: str) -> Column:
    """Whether a line that begins outside of quotes ends inside a quoted value: whole quoted values taken out, what is left opens
    one."""
    start, end = rf"(?:^|{re.escape(separator)})", rf"(?={re.escape(separator)}|\s*$)"
    inside = '"(?:[^"]++|"")*+'
    return F.contains(line, F.lit('"')) & F.regexp_replace(line, f'({start}){inside}"{end}', "$1").rlike(f"{start}{inside}$")


def stays_quoted(line: Column, separator: str) -> Column:
    """Whether a line that begins inside a quoted value ends inside that or another one."""
    rest = F.regexp_replace(line, _THROUGH_CLOSING_QUOTE, "")
    return ~F.contains(line, F.lit('"')) | ~line.rlike(_THROUGH_CLOSING_QUOTE) | opens_quote(rest, separator)


def windows_text(latin: str) -> str:
    """Text of windows-1252 that was read as ISO-8859-1."""
    return latin.translate(str.maketrans(_LATIN, _WINDOWS))


def decoded(line: Column, encoding: str) -> Column:
    """A line's text; the session's list of encodings is left as it is."""
    return line if encoding == UTF8 else F.translate(F.decode(line.cast("binary"), "ISO-8859-1"), _LATIN, _WINDOWS)


def _lines(spark: SparkSession, paths: list[str], separator: str, encoding: str) -> DataFrame:
    """file, block (where the part of the file begins that a task reads), at (order in it), line, and the line's function of
    whether it begins inside quotes: ``opens`` if not, ``stays`` if so."""
    rows = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), decoded(F.col("value"), encoding).alias("line"),
    )
    rows = rows.withColumn("line", F.when(F.endswith("line", F.lit("\r")), F.expr("left(line, length(line) - 1)")).otherwise(F.col("line")))
    return rows.withColumns({"opens": opens_quote(F.col("line"), separator), "stays": stays_quoted(F.col("line"), separator)})


def _prefix(outside: Column, inside: Column, before, begins: Column) -> Column:
    """The bit before a row of ``before``'s order, from ``begins`` on, where each row turns outside into ``outside`` and inside into
    ``inside``: the last row that gives the same either way decides, and how many turned the bit over since then."""
    decides = outside == inside
    turns = F.sum((outside & ~inside).cast("int"))
    past = before.rowsBetween(Window.unboundedPreceding, -1)
    turned = F.coalesce(turns.over(past), F.lit(0))
    upto = turns.over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.last(F.when(decides, F.struct(outside.alias("bit"), upto.alias("turned"))), ignorenulls=True).over(past)
    odd = (turned - F.coalesce(last["turned"], F.lit(0))) % 2 == 1
    return F.coalesce(last["bit"], begins) != odd


def _blocks(lines: DataFrame) -> DataFrame:
    """One row per block: of_file, of_block, begins and ends (inside quotes), owner (the block in which the record begins that is
    open at its start)."""
    mark = F.when(F.col("opens") | ~F.col("stays"), F.struct("at", "opens", "stays"))
    summed = lines.groupBy("file", "block").agg(F.sort_array(F.collect_list(mark)).alias("marks"))

    def after(bit: Column, m: Column) -> Column:
        return F.when(bit, m["stays"]).otherwise(m["opens"])

    def step(acc: Column, m: Column) -> Column:
        inside = after(acc["inside"], m)
        return F.struct(after(acc["outside"], m).alias("outside"), inside.alias("inside"), (acc["closed"] | ~inside).alias("closed"))

    first = F.struct(F.lit(False).alias("outside"), F.lit(True).alias("inside"), F.lit(False).alias("closed"))
    summed = summed.select("file", "block", F.aggregate("marks", first, step).alias("f"))
    order = Window.partitionBy("file").orderBy("block")
    summed = summed.withColumn("begins", _prefix(F.col("f.outside"), F.col("f.inside"), order, F.lit(False)))
    summed = summed.withColumn("ends", F.when(F.col("begins"), F.col("f.inside")).otherwise(F.col("f.outside")))
    opened = F.col("ends") & (~F.col("begins") | F.col("f.closed"))
    owner = F.last(F.when(opened, F.col("block")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return summed.select(F.col("file").alias("of_file"), F.col("block").alias("of_block"), "begins", "ends", owner.alias("owner"))


def records(spark: SparkSession, paths: list[str], separator: str, encoding: str = UTF8) -> DataFrame:
    """(record, first): the records of files as text, line breaks in quotes as line feeds; ``first`` is that of a file's header.

    Two scans: one adds the lines up by block, one deals them out by block.  Only lines of records with a break move again.
    Empty lines outside of quotes are no records.
    """
    lines = _lines(spark, paths, separator, encoding)
    blocks = _blocks(lines)
    rows = lines.join(blocks, (F.col("file") == F.col("of_file")) & (F.col("block") == F.col("of_block")))
    order = Window.partitionBy("file", "block").orderBy("at")
    rows = rows.withColumn("quoted", _prefix(F.col("opens"), F.col("stays"), order, F.col("begins")))
    rows = rows.withColumn("starts", ~F.col("quoted") & (F.col("line") != "")).where("quoted or starts")
    number = F.sum(F.col("starts").cast("long"))
    rows = rows.withColumns({
        "no": number.over(order), "last": number.over(Window.partitionBy("file", "block")),
        "breaks": F.when(F.col("quoted"), True).otherwise(F.col("opens")),
    })
    rows = rows.withColumn("first", (F.col("block") == 0) & (F.col("no") == 1))
    whole = rows.where("not breaks").select(F.col("line").alias("record"), "first")
    head, tail = F.col("no") == 0, (F.col("no") == F.col("last")) & F.col("ends")
    parts = rows.where("breaks").select(
        "file", F.when(head, F.col("owner")).otherwise(F.col("block")).alias("home"),
        F.when(head | tail, -1).otherwise(F.col("no")).alias("no"), F.struct("block", "at", "line").alias("part"), "first",
    )
    parts = parts.groupBy("file", "home", "no").agg(F.sort_array(F.collect_list("part"))["line"].alias("lines"), F.bool_or("first").alias("first"))
    return whole.unionByName(parts.select(F.array_join("lines", "\n").alias("record"), "first"))
