"""From a delimited file to a table."""

from __future__ import annotations

import time
from urllib.parse import unquote

from pyspark.sql import DataFrame

from tabloom import types as hub
from tabloom.functions.dates import excel_serial
from tabloom.operators.mapping import file_columns
from tabloom.operators.profile import infer_mapping
from tabloom.session import materialized
from tabloom.sources import delimited
from tabloom.sources.store import TableStore
from tabloom.types import ColumnSpec


def load_file(
    store: TableStore,
    table: str,
    path: str,
    mode: str,
    load_id: str,
    key: str | None = None,
    mapping: list[ColumnSpec] | None = None,
    separator: str | None = None,
    encoding: str | None = None,
    multiline: bool | None = None,
) -> DataFrame:
    """Detect, read, infer (unless a mapping is given), convert, load and verify: the rows the table then holds.

    Naming separator and encoding saves the scan that detects them, a mapping saves the one that infers types.
    """
    began = time.perf_counter()
    if mapping is None:
        raw = delimited.read_delimited(store.spark, path, separator, encoding, multiline=multiline)
        mapping = infer_mapping(raw)
    else:
        raw = delimited.read_for_mapping(store.spark, path, mapping, separator, encoding, multiline)
    inferred = time.perf_counter()
    rows = store.load(table, raw, mapping, mode, load_id, key)
    loaded = time.perf_counter()
    # detection and inference count as conversion; Spark converts the values themselves while it writes them
    detail = {"rows": rows.count(), "convertMs": (inferred - began) * 1000, "insertMs": (loaded - inferred) * 1000}
    store.log_event(table, load_id, {**detail, "totalMs": (time.perf_counter() - began) * 1000})
    return rows


def load_new_files(store: TableStore, table: str, path: str, run_id: str, **options) -> list[str]:
    """Append the files of a folder whose content no load has brought to the table yet; returns them, one of each content.

    A file's load id is made of its content.  So a run that died may be repeated, whatever files came or went since: what is
    recorded is not loaded again, and what is not recorded is new.  Names come to the driver, as they do whenever Spark lists a
    folder.
    """
    with materialized(delimited.file_digests(store.spark, path), "files") as known:
        fresh = sorted(store.new_files(table, known).collect(), key=lambda r: r["file"])
    for row in fresh:
        store.log_file(table, run_id, row)
        load_file(store, table, unquote(row["file"]), "append" if store.exists(table) else "replace", row["load_id"], **options)
    return [row["file"] for row in fresh]


def with_serial_dates(raw: DataFrame, mapping: list[ColumnSpec]) -> DataFrame:
    """Spreadsheet text in which day numbers of date columns are spelled out."""
    dated = {
        raw.select(text).columns[0]: excel_serial(text, c.sql_type)
        for text, c in zip(file_columns(raw, mapping), mapping)
        if c.sql_type in (hub.DATE, hub.DATETIME)
    }
    return raw.withColumns(dated) if dated else raw
