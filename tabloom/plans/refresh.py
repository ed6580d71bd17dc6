"""Refreshing tables from external sources."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.naming import sql_identifier
from tabloom.operators.reconcile import table_counts
from tabloom.session import materialized
from tabloom.sources.external import extract, newer_than, next_watermark
from tabloom.sources.store import TableStore


ERROR_CHARS = 500
AT_ONCE = 4  # tables refreshed or copied side by side; their jobs share the cluster
STORED = object()  # stands for the mark that the last refresh stored


@dataclass(frozen=True)
class Source:
    """One table fed from outside.  ``read`` opens the source lazily."""

    table: str
    read: Callable[[], DataFrame]
    key: str | None = None
    delta_column: str | None = None
    kind: str = "table"


@dataclass(frozen=True)
class Refreshed:
    rows: DataFrame
    watermark: object | None


def pull(source: Source, watermark=None) -> DataFrame:
    """The rows to load: beyond the mark for a keyed table with a delta column, else all."""
    rows = source.read()
    if source.kind == "table" and source.key and source.delta_column and watermark is not None:
        rows = newer_than(rows, source.delta_column, watermark)
    return extract(rows)


def refresh(store: TableStore, source: Source, load_id: str, watermark=STORED) -> Refreshed:
    """Pull a source and publish it: replaced as a whole, or upserted when it has a key and the table exists.

    The outcome is stored with the table: status, rows, error, and the mark that the next refresh starts from unless it
    is given one.  A failed refresh leaves table and mark as they are.
    """
    try:
        if watermark is STORED:
            watermark = store.watermark(source.table) if store.exists(source.table) else None
        done = _refreshed(store, source, load_id, watermark)
        store.log_refresh(source.table, load_id, "completed", done.watermark, done.rows.count())
    except Exception as error:
        store.log_refresh(source.table, load_id, "failed", error=str(error)[:ERROR_CHARS])
        raise
    return done


def _refreshed(store: TableStore, source: Source, load_id: str, watermark) -> Refreshed:
    pulled = pull(source, watermark)
    incremental = source.kind == "table" and source.key and source.delta_column

    def mark(seen: DataFrame):
        if not incremental:
            return None
        return next_watermark(seen, sql_identifier(source.delta_column), watermark).first().watermark

    if not (source.key and store.exists(source.table)):
        rows = store.publish(source.table, pulled, "replace", load_id)
        return Refreshed(rows, mark(rows))
    with materialized(pulled, "pulled") as copy:  # read from the source once, for check, join and mark
        rows = store.upsert(source.table, copy, sql_identifier(source.key), load_id)
        return Refreshed(rows, mark(copy))


def group_id(*parts: str) -> str:
    """Stable id of the sources that one definition fans out to."""
    return hashlib.md5("|".join(parts).encode()).hexdigest()


def _side_by_side(store: TableStore, work: Iterable[Callable[[], DataFrame]]) -> list[DataFrame]:
    """Results of independent loads, a few of which run at a time."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(store.spark)(w)) for w in work]]


def extract_group(store: TableStore, sources: list[Source], load_id: str) -> DataFrame:
    """Refresh all tables of one definition; returns the rows each of them now holds."""
    done = _side_by_side(store, [partial(lambda s: refresh(store, s, f"{load_id}-{s.table}").rows, s) for s in sources])
    refreshed = dict(zip([s.table for s in sources], done))
    group = group_id(*sorted(refreshed))
    return table_counts(refreshed, "row_count").withColumn("group_id", F.lit(group))


def copy_tables(store: TableStore, tables: dict[str, DataFrame], load_id: str) -> DataFrame:
    """Copy tables into a store with canonical types; returns the rows copied per table."""

    def copy(name: str) -> DataFrame:
        return store.publish(name, extract(tables[name]), "copy", f"{load_id}-{name}")

    return table_counts(dict(zip(tables, _side_by_side(store, [partial(copy, name) for name in tables]))), "copied_rows")
