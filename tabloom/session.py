"""Where intermediate and published data may be written."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; anywhere else its absence is an error, for a
    machine-local folder would be lost with its executor.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="tabloom-")
    return _LOCAL_DIRS[context.applicationId]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nobody has used yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


# Settings that suit these operators.  Conversions of wide tables make long generated methods; beyond 8000 bytecodes the
# JVM would interpret them, so Spark is told to split the work of such a stage into shorter ones instead.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}


@contextmanager
def short_methods(spark: SparkSession):
    """While a block runs, stages whose generated method the JVM would only interpret are split into shorter methods, as
    ``RECOMMENDED_CONF`` has it, whatever the session says."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, RECOMMENDED_CONF[key])
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df, label: str):
    """Write a DataFrame once to the shared folder and read it back: its lineage then starts at the files."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with short_methods(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def materialized(df, label: str):
    """A written copy as long as a block runs; it is deleted on leaving, so nothing lazy may still read it then."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    try:
        with short_methods(spark):
            df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
