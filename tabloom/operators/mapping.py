"""From raw text rows to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom import types as hub
from tabloom.functions.convert import convert, convert_source
from tabloom.functions.hashing import row_hash
from tabloom.functions.text import has_text
from tabloom.naming import normalize_headers
from tabloom.types import ROW_HASH, ColumnSpec, header_of

SHOWN_CHARS = 180  # how much of a rejected value the report shows


def file_columns(df: DataFrame, mapping: list[ColumnSpec]) -> list[Column]:
    """The text column each mapped column is made of.

    Readers give columns their table names and keep the header aside, and headers may repeat.  So a column with both the
    header and the table name comes first, then one that is named like the header, then either alone.
    """
    fields = {f.name: f for f in df.schema.fields}

    def name_of(c: ColumnSpec) -> str:
        if c.sql_name in fields and header_of(fields[c.sql_name]) == c.original_name:
            return c.sql_name
        if c.original_name in fields:
            return c.original_name
        if c.sql_name in fields:
            return c.sql_name
        return next((f.name for f in df.schema.fields if header_of(f) == c.original_name), c.original_name)

    return [df[f"`{name_of(c).replace('`', '``')}`"] for c in mapping]


def apply_mapping(df: DataFrame, mapping: list[ColumnSpec], with_hash: bool = False) -> DataFrame:
    """Rename, convert and order text columns as the mapping says; optionally add the hash of the raw text.

    One projection: the text is read once for both.
    """
    if not mapping:
        raise ValueError("no mapped columns")
    texts = file_columns(df, mapping)
    typed = [
        convert(text, c.sql_type).alias(c.sql_name, metadata={"original_name": c.original_name})
        for text, c in zip(texts, mapping)
    ]
    hashed = [row_hash(texts).alias(ROW_HASH)] if with_hash else []
    return df.select(*typed, *hashed)


def canonicalize(df: DataFrame) -> DataFrame:
    """Columns of an external source as canonical types, under table names; the source's names are kept as headers."""
    return df.select(
        *[
            convert_source(df[f"`{f.name.replace('`', '``')}`"], f.dataType).alias(name, metadata={"original_name": f.name})
            for f, name in zip(df.schema.fields, normalize_headers(df.columns))
        ]
    )


def describe_source(df: DataFrame) -> list[ColumnSpec]:
    """Columns and canonical types of a source, from analysis alone: no row is read."""
    names = normalize_headers(df.columns)
    return [ColumnSpec(f.name, name, hub.canonical_from_spark(f.dataType)) for f, name in zip(df.schema.fields, names)]


def conversion_rejects(df: DataFrame, mapping: list[ColumnSpec], line_column: str) -> DataFrame:
    """Every non-blank value that does not convert: line, column, type and the value."""
    failed = [
        F.when(
            has_text(text) & convert(text, c.sql_type).isNull(),
            F.struct(
                F.lit(c.sql_name).alias("column_name"),
                F.lit(c.sql_type).alias("sql_type"),
                F.substring(text, 1, SHOWN_CHARS).alias("value"),
            ),
        )
        for text, c in zip(file_columns(df, mapping), mapping)
    ]
    listed = df.select(df[line_column].alias("line"), F.explode(F.array_compact(F.array(*failed))).alias("reject"))
    return listed.select("line", "reject.*")


def reject_counts(rejects: DataFrame) -> DataFrame:
    """Rejects per column."""
    return rejects.groupBy("column_name", "sql_type").agg(F.count(F.lit(1)).alias("rejects"))
