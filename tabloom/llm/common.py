"""What the operators of this subpackage share: ASCII lower case, words, row keys and temporary tables."""

from __future__ import annotations

import string
import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.session import shared_dir

BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
HELD_OUT_FOLDS = 5
PYTHON_BATCH = 256
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; ``lower`` does that alone where all characters are ASCII."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def blank_split(text: Column) -> Column:
    """The runs of ``[^\\x20\\x09-\\x0D]`` of a text in order; none of NULL."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK_RUN))


def held_out(key: Column) -> Column:
    """True for the fold that nothing may be learned from; rows without an id belong to it."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % HELD_OUT_FOLDS == 0


def packed(rows: DataFrame) -> Column:
    """All columns of a row as one struct: columns of any name pass an operator unseen."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in rows.columns])


def bounded(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of short keys, to be broadcast if a count shows that it is small; else Spark joins by shuffling."""
    return F.broadcast(keys) if keys.count() <= rows else keys


class Scratch:
    """Temporary tables in the shared folder, deleted on leaving the block except for those in ``keep``."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.label, self.paths = spark, label, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*self.paths)

    def path(self) -> str:
        self.paths.append(f"{shared_dir(self.spark)}/{self.label}-{uuid.uuid4().hex}")
        return self.paths[-1]

    def write(self, rows: DataFrame, keep: bool = False) -> DataFrame:
        """The rows, written once; their lineage then starts at the files."""
        path = self.path()
        if keep:
            self.paths.remove(path)
        rows.write.parquet(path)
        written = self.spark.read.schema(rows.schema).parquet(path)
        written.scratch_path = path
        return written

    def drop(self, *paths: str) -> None:
        jvm = self.spark._jvm
        for path in paths:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
            if path in self.paths:
                self.paths.remove(path)

    def replace(self, old: DataFrame, rows: DataFrame) -> DataFrame:
        """Write ``rows``, which may read ``old``, then delete ``old``."""
        new = self.write(rows)
        self.drop(old.scratch_path)
        return new


@contextmanager
def small_batches(spark: SparkSession, rows: int = PYTHON_BATCH):
    """Bounds what a Python worker holds at once: texts are long, and Spark counts Arrow batches in rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def summed(rows: DataFrame, partial, width: int) -> np.ndarray:
    """Sum of vectors: ``partial`` makes one of each pandas batch, Python adds those of a partition, Spark the rest."""

    def of_partition(batches):
        total = np.zeros(width)
        for batch in batches:
            if len(batch):
                total += partial(batch)
        index = np.flatnonzero(total)
        yield pd.DataFrame({"i": index.astype("int32"), "v": total[index]})

    out = np.zeros(width)
    for row in rows.mapInPandas(of_partition, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[row["i"]] = row["v"]
    return out
