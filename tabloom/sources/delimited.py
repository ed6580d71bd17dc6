"""Delimited text files: hints, header binding, reading."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.hashing import digest_sum
from tabloom.naming import normalize_headers
from tabloom.session import materialize
from tabloom.sources.quoted import UTF8, WINDOWS, opens_quote, records, windows_text
from tabloom.types import ColumnSpec

# Separators in the order that decides a tie, and the lines that are counted for them.
SEPARATORS = (";", ",", "\t")
SEPARATOR_LINES = 10
_PARSER = {"escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1", "maxColumns": "100000"}


def separator_of(text: Column) -> Column:
    """Separator of a text: the one its first ten lines have most of, the earlier in the list on a tie."""
    lines = F.slice(F.split(text, "\r?\n"), 1, SEPARATOR_LINES)
    head = F.array_join(lines, "\n")

    def count(mark: str) -> Column:
        return F.length(head) - F.length(F.replace(head, F.lit(mark), F.lit("")))

    semicolons, commas, tabs = (count(s) for s in SEPARATORS)
    return (
        F.when((semicolons >= commas) & (semicolons >= tabs), SEPARATORS[0])
        .when(commas >= tabs, SEPARATORS[1])
        .otherwise(SEPARATORS[2])
    )


def detect_hints(spark: SparkSession, path: str) -> tuple[str, str]:
    """Encoding and separator of a file.

    The separator needs the first lines only.  The encoding is UTF-8 unless some byte of the whole file says otherwise;
    the search for such a byte is a distributed scan that stops at the first one.
    """
    lines = spark.read.text(path)
    head = "\n".join(r.value for r in lines.limit(SEPARATOR_LINES).collect())
    separator = max(SEPARATORS, key=head.count)  # the first of equals
    foreign = lines.where(~F.is_valid_utf8("value"))
    return (UTF8 if foreign.isEmpty() else WINDOWS), separator


@dataclass(frozen=True)
class Layout:
    """Files of a folder that are read alike."""

    paths: list[str]
    separator: str
    encoding: str
    multiline: bool
    headers: list[str]
    split: bool | None = None  # read by blocks; None: where a file has more than one


def file_hints(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of a folder: file, encoding, separator, first_line, breaks (line breaks in quoted values).

    One aggregate over all lines, combined below the shuffle, says what is true of whole files; the first lines of each
    file tell the separator.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    opened = F.array(*[opens_quote(F.col("value"), s) for s in SEPARATORS])
    flags = lines.select("file", (~F.is_valid_utf8("value")).alias("foreign"), opened.alias("opened")).groupBy("file").agg(
        F.bool_or("foreign").alias("foreign"), *[F.bool_or(F.col("opened")[i]).alias(f"opened_{i}") for i in range(len(SEPARATORS))]
    )
    order = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    heads = lines.where("block = 0").withColumn("at", F.monotonically_increasing_id()).withColumn("rn", order)
    heads = heads.where(F.col("rn") <= SEPARATOR_LINES).groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct("rn", "value")))["value"].alias("head")
    )
    separator = separator_of(F.array_join("head", "\n"))
    breaks = reduce(lambda found, i: F.when(separator == SEPARATORS[i], F.col(f"opened_{i}")).otherwise(found),
                    range(len(SEPARATORS)), F.lit(False))
    return flags.join(heads, "file").select(
        "file", F.when(F.col("foreign"), WINDOWS).otherwise(UTF8).alias("encoding"), separator.alias("separator"),
        F.col("head")[0].alias("first_line"), breaks.alias("breaks"),
    )


def layouts(
    spark: SparkSession,
    path: str,
    separator: str | None = None,
    encoding: str | None = None,
    multiline: bool | None = None,
) -> list[Layout]:
    """The files at a path, put together by how they have to be read; what is not given is found out for each file.

    The driver sees one entry per kind of file and the names of the files.
    """
    files = [unquote(f) for f in spark.read.text(path).inputFiles()]
    if len(files) == 1:
        if separator is None or encoding is None:
            found_encoding, found_separator = detect_hints(spark, path)
            separator, encoding = separator or found_separator, encoding or found_encoding
        breaks = has_quoted_breaks(spark, path, separator) if multiline is None else multiline
        return [Layout([path], separator, encoding, breaks, read_header(spark, path, separator, encoding))]
    given = {"separator": separator, "encoding": encoding, "breaks": multiline}
    hints = file_hints(spark, path).withColumns({c: F.lit(v) for c, v in given.items() if v is not None})
    kinds = hints.groupBy("separator", "encoding", "breaks", "first_line").agg(F.sort_array(F.collect_list("file")).alias("files"))
    out = []
    for kind in sorted(kinds.collect(), key=lambda k: k["files"][0]):
        paths = [unquote(f) for f in kind["files"]]
        headers = read_header(spark, paths[0], kind["separator"], kind["encoding"])
        out.append(Layout(paths, kind["separator"], kind["encoding"], kind["breaks"], headers))
    return out


def bind_header(headers: list[str], columns: list[tuple[str, str]]) -> list[int]:
    """Position in the file of each (header, name) column.

    The n-th column of a repeated header is the n-th such position; a header the file lacks falls back to the column's
    own position.
    """
    places: dict[str, list[int]] = {}
    for position, header in enumerate(headers):
        places.setdefault(header, []).append(position)
    bound = []
    for ordinal, (header, _) in enumerate(columns):
        free = places.get(header)
        bound.append(free.pop(0) if free else ordinal)
    return bound


def read_header(spark: SparkSession, path: str, separator: str, encoding: str = UTF8) -> list[str]:
    """The header cells of a file; a quoted one may hold line breaks."""
    lines = spark.read.text(path).limit(1).select(opens_quote(F.col("value"), separator).alias("open")).first()
    breaks = lines is not None and lines["open"]
    known = "ISO-8859-1" if encoding == WINDOWS else encoding
    row = _csv(spark, separator, known).option("header", False).option("multiLine", breaks).csv(path).first()
    return [windows_text(cell or "") if encoding == WINDOWS else (cell or "").removeprefix("﻿") for cell in row]


def read_for_mapping(
    spark: SparkSession, path: str, mapping: list[ColumnSpec], separator: str | None = None, encoding: str | None = None,
    multiline: bool | None = None,
) -> DataFrame:
    """A file read for an existing mapping: its text columns under the mapping's table names, in the mapping's order.

    The file's headers may stand in any order; columns the file does not reach are NULL.
    """
    missing = F.lit(None).cast("string")

    def bound(layout: Layout) -> DataFrame:
        df = _read(spark, layout)
        places = bind_header(layout.headers, [(c.original_name, c.sql_name) for c in mapping])
        return df.select(
            *[
                (df[df.columns[place]] if place < len(df.columns) else missing).alias(c.sql_name)
                for c, place in zip(mapping, places)
            ]
        )

    return reduce(DataFrame.unionByName, [bound(x) for x in layouts(spark, path, separator, encoding, multiline)])


def profile_files(spark: SparkSession, path: str) -> DataFrame:
    """Size, lines and an order-free content fingerprint of every text file of a folder.

    A large file is read by many tasks; two files hold the same lines exactly when size, lines and sums agree.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size_bytes"),
        F.md5(F.col("value").cast("binary")).alias("h"),
    )
    return lines.groupBy("file", "size_bytes").agg(
        F.count(F.lit(1)).alias("line_count"),
        digest_sum(F.col("h"), 1).alias("sum_high"),
        digest_sum(F.col("h"), 17).alias("sum_low"),
    )


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Size, lines and a digest of every text file of a folder: two files agree in all of them only if they are equal byte by byte.

    Each line is hashed with its number in the file, and hashes are added up, so that tasks read a file in any split.  The number
    is the line's place in its block and the lines of the blocks before, which a first scan counts.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size_bytes"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value",
    )
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))
    past = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialize(blocks.withColumn("past", F.coalesce(F.sum("n").over(past), F.lit(0))), "blocks")
    number = (F.col("past") + F.col("at") - F.col("first_at")).cast("string")
    digest = F.md5(F.concat(F.concat(number, F.lit(":")).cast("binary"), F.col("value").cast("binary")))
    return lines.join(blocks, ["file", "block"]).groupBy("file", "size_bytes").agg(
        F.count(F.lit(1)).alias("line_count"), digest_sum(digest, 1).alias("sum_high"), digest_sum(digest, 17).alias("sum_low")
    )


def _csv(spark: SparkSession, separator: str, encoding: str):
    return spark.read.option("sep", separator).option("encoding", encoding).options(**_PARSER)


def has_quoted_breaks(spark: SparkSession, path: str, separator: str) -> bool:
    """Whether some line ends inside a quoted value.

    Whole quoted values are taken out of each line; what is left then holds an opening quote, at the start of a value, or
    none.  Stray quotes inside values do not count.
    """
    return not spark.read.text(path).where(opens_quote(F.col("value"), separator)).isEmpty()


def _has_blocks(spark: SparkSession, paths: list[str]) -> bool:
    """Whether some file is longer than what Spark gives one task; a shorter one is read in order by one task anyway."""
    longest = spark.read.format("binaryFile").load(paths).agg(F.max("length").alias("n")).first()["n"] or 0
    return longest > spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def _read(spark: SparkSession, layout: Layout) -> DataFrame:
    """Files of one layout as text columns."""
    schema = T.StructType(
        [
            T.StructField(name, T.StringType(), True, {"original_name": header})
            for name, header in zip(normalize_headers(layout.headers), layout.headers)
        ]
    )
    by_blocks = layout.multiline and layout.encoding in (UTF8, WINDOWS) and (_has_blocks(spark, layout.paths) if layout.split is None else layout.split)
    if by_blocks or layout.encoding == WINDOWS:
        rows = records(spark, layout.paths, layout.separator, layout.encoding).where("not first")
        options = {"sep": layout.separator, **_PARSER}
        parsed = F.from_csv("record", ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema), options)
        return rows.select(parsed.alias("row")).select(
            *[F.col("row").getField(f.name).alias(f.name, metadata=f.metadata) for f in schema]
        )
    return _csv(spark, layout.separator, layout.encoding).option("header", True).option("enforceSchema", True).option(
        "multiLine", layout.multiline
    ).schema(schema).csv(layout.paths)


def read_delimited(
    spark: SparkSession,
    path: str,
    separator: str | None = None,
    encoding: str | None = None,
    headers: list[str] | None = None,
    multiline: bool | None = None,
    split: bool | None = None,
) -> DataFrame:
    """A delimited file, or a folder of them, as a DataFrame of text columns.

    Short rows end in NULLs, blank lines are skipped, a stray quote stays in its value.  Column names are the
    normalised headers; the header itself is kept as metadata.  Files are split among tasks, also where quoted values hold line
    breaks (see ``quoted``): ``multiline`` says so, and unless it is given one pass over the lines finds out.  The files of a folder may
    differ in encoding, separator, and order and number of columns: columns go by name, those of the first file first, and
    a file that lacks one has NULL there.  ``headers`` says that all files have these columns, in this order.  ``split``
    says whether files with breaks are read by blocks; else those are that Spark would give more than one task.
    """
    if headers is not None and None not in (separator, encoding, multiline):
        return _read(spark, Layout([path], separator, encoding, multiline, headers, split))
    found = layouts(spark, path, separator, encoding, multiline)
    parts = [_read(spark, replace(x, headers=x.headers if headers is None else headers, split=split)) for x in found]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
