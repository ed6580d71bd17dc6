"""A folder of arriving files, loaded by micro-batches that each run once.

Both jobs take what is available and stop; a scheduler starts them again, and the checkpoint says where to go on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tabloom.operators.load import latest_per_key

BATCH = "batch_id"
BASES, UPTO = "_bases", "upto"  # Spark leaves out folders with this mark when it reads the batches


def arriving(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all that has arrived; the file sink's log makes each batch count once."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stream_upsert(rows: DataFrame, key: str, order: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Upsert all that has arrived, newest row per key within a batch.

    A batch is written as its own partition, which a repeated run of the same batch overwrites.  The cost of a batch
    is that of its rows: the table is not rewritten.  ``upserted`` reads the current rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = latest_per_key(batch, key, order)
        newest.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _listed(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the finished folders ``prefix``=n below a path, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    below = [status.getPath() for status in files.listStatus(folder) if status.getPath().getName().startswith(f"{prefix}=")]
    done = [p for p in below if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def _parts(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame | None, int, list[int]]:
    """The newest base with its last batch (-1 without one), and the later batches."""
    bases = _listed(spark, f"{path}/{BASES}", UPTO)
    upto = bases[-1] if bases else -1
    base = spark.read.schema(schema).parquet(f"{path}/{BASES}/{UPTO}={upto}") if bases else None
    return base, upto, [n for n in _listed(spark, path, BATCH) if n > upto]


def upserted(spark: SparkSession, path: str, schema: T.StructType, key: str, order: list[str]) -> DataFrame:
    """The table the batches add up to: the newest row of each key, and of equally new ones that of the last batch.

    Newest is by the delta column, as within a batch, so the outcome does not depend on the order files arrive in.  Only
    the newest base and the batches after it are read.
    """
    base, upto, batches = _parts(spark, path, schema)
    parts = [] if base is None else [base.withColumn(BATCH, F.lit(upto).cast("bigint"))]
    if batches:
        kept = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
        reader = spark.read.schema(kept).option("basePath", path)
        parts.append(reader.parquet(*[f"{path}/{BATCH}={n}" for n in batches]))
    if not parts:
        return spark.createDataFrame([], schema)
    return latest_per_key(reduce(DataFrame.unionByName, parts), key, [*order, BATCH]).drop(BATCH)


def compact(spark: SparkSession, path: str, schema: T.StructType, key: str, order: list[str], drop: bool = False) -> None:
    """Fold the finished batches into a new base.

    A base is named by its last batch and counts once it is whole, so readers change over at one instant and no base is
    written over another.  A batch that is run again after that is already in the base and is not read.  ``drop``
    deletes what the base before this one covers; readers of that one must have ended.
    """
    _, upto, batches = _parts(spark, path, schema)
    if batches:
        upserted(spark, path, schema, key, order).write.mode("overwrite").parquet(f"{path}/{BASES}/{UPTO}={batches[-1]}")
    if drop:
        covered = [f"{path}/{BATCH}={n}" for n in _listed(spark, path, BATCH) if n <= upto]
        covered += [f"{path}/{BASES}/{UPTO}={n}" for n in _listed(spark, f"{path}/{BASES}", UPTO) if n < upto]
        for name in covered:
            folder = spark._jvm.org.apache.hadoop.fs.Path(name)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
