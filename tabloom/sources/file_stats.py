"""What is known of the files of a stored table: extent of a key, sums of row digests.

Files never change, so each is described once, by the first call that asks, and its row stands in the store from then on.  A later
call reads the files that came since.  Descriptions that two callers wrote at once agree; those of files that are gone do no harm.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.reconcile import compare_sums, fingerprint_sums
from tabloom.types import ROW_HASH

KEY_RANGES = 64  # by which the keys of an upsert are held against the extents of files
FILE_NAME = "file_name"
_SUMS = ("sum_high", "sum_low")


class Measure(NamedTuple):
    """A name, and ``describe``, which makes of rows one row for each file that has any: file_name, row_count and ``columns``."""

    name: str
    columns: list[T.StructField]
    describe: object


def _file() -> Column:
    return F.col("_metadata.file_name").alias(FILE_NAME)


def key_extent(key: T.StructField) -> Measure:
    """Smallest and largest key of a file."""
    def describe(rows: DataFrame) -> DataFrame:
        keys = rows.select(_file(), F.col(f"`{key.name}`").alias("key"))
        return keys.groupBy(FILE_NAME).agg(F.count(F.lit(1)).alias("row_count"), F.min("key").alias("low"), F.max("key").alias("high"))

    columns = [T.StructField(name, key.dataType) for name in ("low", "high")]
    return Measure(f"key {key.name} {key.dataType.simpleString()}", columns, describe)


def digest_sums() -> Measure:
    """``fingerprint_sums`` of a file's rows, without the row hash, which follows from them."""
    def describe(rows: DataFrame) -> DataFrame:
        return fingerprint_sums(rows.drop(ROW_HASH), _file())

    return Measure("digest sums", [T.StructField(name, T.StringType()) for name in _SUMS], describe)


def described(store, table: str, target: DataFrame, measure: Measure) -> DataFrame:
    """One row for each file of ``target``, a version of the table: file_name, path, row_count (0 if it has no rows) and the
    columns of the measure.  Only files without a description are opened, by one aggregate over them."""
    spark = store.spark
    kinds = quote(f"{measure.name} {target.schema.simpleString()}" if measure.name == "digest sums" else measure.name, safe="")
    folder = f"{store.root}/_stats/{quote(table, safe='')}/{uuid.uuid5(uuid.NAMESPACE_URL, kinds).hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    schema = T.StructType([T.StructField(FILE_NAME, T.StringType()), T.StructField("row_count", T.LongType()), *measure.columns])
    paths = [unquote(f) for f in target.inputFiles()]
    files = spark.createDataFrame([(p.rsplit("/", 1)[1], p) for p in paths], f"{FILE_NAME} string, path string")

    def known() -> DataFrame:
        return spark.read.schema(schema).parquet(folder).select(*schema.names).dropDuplicates([FILE_NAME])

    missing = files.join(known(), FILE_NAME, "left_anti")
    unread = [r["path"] for r in missing.collect()]
    if unread:
        found = measure.describe(store._read(unread, target.schema))
        new = spark.createDataFrame([(p.rsplit("/", 1)[1],) for p in unread], f"{FILE_NAME} string").join(found, FILE_NAME, "left")
        new = new.withColumn("row_count", F.coalesce("row_count", F.lit(0)))
        new.select(*schema.names).write.parquet(f"{folder}/entry={uuid.uuid4().hex}")
    return files.join(known(), FILE_NAME)


def key_ranges(rows: DataFrame, key: str, ranges: int = KEY_RANGES) -> list[tuple]:
    """At most ``ranges`` (low, high) that hold all keys of ``rows``: each key by itself where there are so few."""
    keys = rows.select(F.col(f"`{key}`").alias("key")).where(F.col("key").isNotNull()).distinct()
    few = [r["key"] for r in keys.limit(ranges + 1).collect()]
    if len(few) <= ranges:
        return [(k, k) for k in few]
    parts = keys.repartitionByRange(ranges, "key").groupBy(F.spark_partition_id().alias("part"))
    return [(r["low"], r["high"]) for r in parts.agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()]


def admitting(store, table: str, target: DataFrame, rows: DataFrame, key: str) -> list[str]:
    """Files of ``target`` whose extent of the key admits a key of ``rows``; a file that has such a key is always among them."""
    field = target.schema[key]
    ranges = key_ranges(rows, key)
    if not ranges:
        return []
    lit = lambda value: F.lit(value).cast(field.dataType)
    bounds = F.array(*[F.struct(lit(low).alias("low"), lit(high).alias("high")) for low, high in ranges])
    meets = F.exists(bounds, lambda r: (r["low"] <= F.col("high")) & (r["high"] >= F.col("low")))
    return [r["path"] for r in described(store, table, target, key_extent(field)).where(meets).select("path").collect()]


def stored_fingerprint(store, table: str) -> DataFrame:
    """``fingerprint_sums`` of the current version, added up from its files: those described before are not opened again."""
    files = described(store, table, store.read(table), digest_sums())
    added = [F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias(c) for c in _SUMS]
    return files.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"), *added)


def compare_stored(source, target, tables: list[str]) -> DataFrame:
    """``compare_tables`` of the current versions in two stores; where all files are described, none of them is read."""
    return compare_sums({t: (stored_fingerprint(source, t), stored_fingerprint(target, t)) for t in tables})
