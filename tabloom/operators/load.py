"""Load modes: what a table holds after a file has been loaded into it.

All modes take the current rows and the rows of the file and return the rows of the next version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.skew import keep_by_key
from tabloom.types import ROW_HASH, ColumnSpec, spark_schema


def append(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """All rows of both."""
    return target.unionByName(incoming)


def delta_changes(target: DataFrame, incoming: DataFrame, multiset: bool = False) -> DataFrame:
    """Row hashes that a replace has to touch, with how many rows each side holds.

    Only hashes are shuffled, and repeats of a hash are counted before the shuffle.  By default a hash counts as
    unchanged when both sides have it; with ``multiset`` the number of its rows must agree too.
    """
    sides = target.select(ROW_HASH, F.lit(1).alias("in_target"), F.lit(0).alias("in_file")).unionByName(
        incoming.select(ROW_HASH, F.lit(0).alias("in_target"), F.lit(1).alias("in_file"))
    )
    counted = (
        sides.where(F.col(ROW_HASH).isNotNull())
        .groupBy(ROW_HASH)
        .agg(F.sum("in_target").alias("target_rows"), F.sum("in_file").alias("file_rows"))
    )
    if multiset:
        return counted.where("target_rows <> file_rows")
    return counted.where("target_rows = 0 or file_rows = 0")


def delta_replace(target: DataFrame, incoming: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Replace that keeps the target rows the file still has and takes from the file only what is new.

    Rows are matched by ``row_hash``; target rows without one are dropped.  Both joins probe with the change set, which
    is small when little has changed, not with all hashes of the other side.  ``changes`` may pass that set in when the
    caller has written it out already.
    """
    changes = delta_changes(target, incoming) if changes is None else changes
    return rows_kept(target, changes).unionByName(new_rows(incoming, changes))


def rows_kept(target: DataFrame, changes: DataFrame) -> DataFrame:
    """The target rows that a change set leaves in place."""
    hashed = target.where(F.col(ROW_HASH).isNotNull())
    return keep_by_key(hashed, changes.where("target_rows > 0"), [ROW_HASH], present=False, unique=True)


def new_rows(incoming: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows of the file that a change set says are new."""
    return keep_by_key(incoming, changes.where("file_rows > 0"), [ROW_HASH], present=True, unique=True)


def delta_precomputed(target: DataFrame, new_rows: DataFrame, removed_hashes: DataFrame) -> DataFrame:
    """Delta whose differences the sender worked out: new rows go in, listed hashes go out.

    A new row that the target has, or that is listed, stays out: one join says both.  No join lies below another one.
    """
    known = target.select(ROW_HASH).unionByName(removed_hashes.select(ROW_HASH))
    added = keep_by_key(new_rows, known, [ROW_HASH], present=False)
    return keep_by_key(target, removed_hashes, [ROW_HASH], present=False).unionByName(added)


def delta_prep(target: DataFrame, mapping: list[ColumnSpec]) -> DataFrame:
    """The hashes a sender compares its file with; refused where a delta is not possible."""
    if ROW_HASH not in target.columns:
        raise ValueError("no-hash-col")
    if all(c.sql_type == "NVARCHAR(MAX)" for c in mapping) or schema_mismatches(target, mapping):
        raise ValueError("schema-mismatch")
    return target.select(ROW_HASH).where(F.col(ROW_HASH).isNotNull())


def duplicate_keys(df: DataFrame, key: str | list[str]) -> DataFrame:
    """Keys that occur more than once; NULLs count as equal."""
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    return repeated.withColumnRenamed("_copies", "n")


def upsert(target: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Target rows whose key the file lacks, and all rows of the file.  A NULL key matches nothing."""
    return keep_by_key(target, incoming, [key], present=False).unionByName(incoming)


def latest_per_key(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """The newest row of each key.  ``order`` lists columns from most to least important and must decide ties.

    An aggregate, not a window: each map task sends one row per key, however many a key has.
    """
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("newest")).select(*keys, "newest.*").select(*df.columns)


def upsert_counts(target: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows inserted (all of the file) and target rows replaced."""
    replaced = keep_by_key(target, incoming, [key], present=True).agg(F.count(F.lit(1)).alias("updated"))
    return incoming.agg(F.count(F.lit(1)).alias("inserted")).withColumn("updated", replaced.scalar())


def delta_counts(target: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows inserted and removed by a delta replace, from its change set."""
    unhashed = target.where(F.col(ROW_HASH).isNull()).agg(F.count(F.lit(1)))

    return changes.agg(
        F.coalesce(F.sum("file_rows"), F.lit(0)).alias("inserted"),
        (F.coalesce(F.sum("target_rows"), F.lit(0)) + unhashed.scalar()).alias("updated"),
    )


class SchemaMismatch(ValueError):
    """Rows do not have a table's columns."""


def schema_mismatches(target: DataFrame, mapping: list[ColumnSpec]) -> list[str]:
    """Why a mapping cannot be loaded into a table as it is: names in order, then types.  Empty when it can."""
    fields = [f for f in target.schema.fields if f.name != ROW_HASH]
    wanted = spark_schema(mapping).fields
    names, expected = [f.name for f in fields], [f.name for f in wanted]
    if names != expected:
        return [f"columns: expected {', '.join(expected)}; found {', '.join(names)}"]
    return [
        f"{have.name}: expected {want.dataType.simpleString()}, found {have.dataType.simpleString()}"
        for have, want in zip(fields, wanted)
        if have.dataType != want.dataType
    ]


def integrity_counts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows a load should have written, rows it has, and whether they agree."""
    have = actual.agg(F.count(F.lit(1)))
    return expected.agg(F.count(F.lit(1)).alias("expected_rows")).select(
        "expected_rows",
        have.scalar().alias("actual_rows"),
        (F.col("expected_rows") == have.scalar()).alias("complete"),
    )


def dedupe_payloads(uploads: DataFrame, seen: DataFrame, order: str) -> DataFrame:
    """Which uploads bring new content.  An upload whose size and MD5 were loaded before, or that repeats one earlier
    in the batch, is skipped.

    ``uploads`` has a ``content`` column (bytes or text); ``seen`` the ``size_bytes`` and ``md5`` of loaded ones.
    """
    marked = uploads.select(
        order,
        F.octet_length("content").cast("bigint").alias("size_bytes"),
        F.md5(F.col("content").cast("binary")).alias("md5"),
    )
    firsts = marked.groupBy("size_bytes", "md5").agg(F.min(order).alias(order))
    unseen = keep_by_key(firsts, seen, ["size_bytes", "md5"], present=False)
    return unseen.select(order, "size_bytes", "md5")
