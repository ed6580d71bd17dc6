"""Rows as lines of text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.display import feed_value, time_cell
from tabloom.session import materialized
from tabloom.types import ColumnSpec

BOM = "﻿"
LINE_END = "\r\n"
# Header and answers of the column dictionary file.
DICTIONARY_HEADER = "Coluna SQL;Nome original;Tipo;Nulável"
YES, NO = "Sim", "Não"


def _doubled(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit('""'))


def export_csv(df: DataFrame, separator: str = ";") -> DataFrame:
    """One ``line`` per row; a value is quoted only where separator, quote or line feed require it."""
    def cell(name: str) -> Column:
        text = time_cell(F.col(f"`{name}`").cast("string"))
        needs = text.contains(separator) | text.contains('"') | text.contains("\n")
        return F.coalesce(F.when(needs, F.concat(F.lit('"'), _doubled(text), F.lit('"'))).otherwise(text), F.lit(""))

    return df.select(F.concat_ws(separator, *[cell(c) for c in df.columns]).alias("line"))


def export_query(df: DataFrame) -> DataFrame:
    """One ``line`` per row of a query result, comma separated, every value quoted."""
    cells = [
        F.concat(F.lit('"'), _doubled(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))), F.lit('"'))
        for c in df.columns
    ]
    return df.select(F.concat_ws(",", *cells).alias("line"))


def export_ndjson(df: DataFrame) -> DataFrame:
    """One JSON object per row."""
    values = [feed_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias("line"))


def column_dictionary(mapping: list[ColumnSpec], spark) -> DataFrame:
    """Table column, header, type and nullability of each column, as lines."""
    lines = [
        f"{c.sql_name};{c.original_name};{c.sql_type};{YES if c.nullable else NO}" for c in mapping
    ]
    return spark.createDataFrame([(i, line) for i, line in enumerate(lines, start=1)], "ordinal bigint, line string")


def write_lines(lines: DataFrame, path: str, header: str | None = None, trailer: DataFrame | None = None) -> None:
    """Write lines as text parts that make up the file when put together in order of their names.

    The header is a part of its own, before all others, and carries the byte order mark; a trailer is the last part.
    """
    spark = lines.sparkSession
    if header is not None:
        first = spark.createDataFrame([(BOM + header,)], "line string").coalesce(1)
        lines = first.unionByName(lines)
    if trailer is not None:
        lines = lines.unionByName(trailer)
    lines.write.option("lineSep", LINE_END).text(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    """Header object with the columns, one object per row, and a trailer with the row count.

    The rows are computed once, into a working copy that is counted and exported: a source that changes meanwhile cannot
    make the trailer disagree with them.
    """
    spark = df.sparkSession
    names = [F.lit(c) for c in df.columns]
    header = spark.range(1, numPartitions=1).select(F.to_json(F.struct(F.array(*names).alias("columns"))).alias("line"))
    with materialized(export_ndjson(df), "ndjson") as lines:
        trailer = lines.agg(F.to_json(F.struct(F.count(F.lit(1)).alias("rowCount"))).alias("line"))
        header.unionByName(lines).unionByName(trailer).write.text(path)
