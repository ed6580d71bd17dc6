"""Streaming loads over the events, which arrive in several files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.checks import Registry, frames
from tabloom.operators.load import latest_per_key
from tabloom.session import fresh_path
from tabloom.streaming import ingest

registry = Registry()
KEY, ORDER = "user_id", ["ts", "event_id"]


def _arrivals(spark, folder):
    """Events in eight files by time, so that micro-batches see time go on."""
    events = frames.table(spark, folder, "events")
    path = fresh_path(spark, "arrivals")
    events.repartitionByRange(8, "ts").write.parquet(path)
    return ingest.arriving(spark, path, events.schema, files_per_batch=3), events.schema


@registry.query("stream_append", "SELECT event_id, ts, user_id, event_type, value FROM events")
def stream_append(spark, folder):
    arriving, _ = _arrivals(spark, folder)
    rows = arriving.drop("props")
    path = fresh_path(spark, "appended")
    ingest.stream_append(rows, path, fresh_path(spark, "checkpoint")).awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


@registry.query(
    "stream_upsert",
    """SELECT event_id, ts, user_id, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC,
 event_id DESC) AS rn FROM events) e WHERE rn = 1""",
)
def stream_upsert(spark, folder):
    """The newest event of each user, upserted batch by batch."""
    arriving, schema = _arrivals(spark, folder)
    path = fresh_path(spark, "upserted")
    ingest.stream_upsert(arriving, KEY, ORDER, path, fresh_path(spark, "checkpoint")).awaitTermination()
    return ingest.upserted(spark, path, schema, KEY, ORDER)


@registry.query(
    "stream_equals_batch",
    "SELECT count(DISTINCT user_id) AS users, true AS equal FROM events",
)
def stream_equals_batch(spark, folder):
    """The streamed table against the batch operator over all events at once."""
    streamed = stream_upsert(spark, folder)
    whole = latest_per_key(frames.table(spark, folder, "events"), KEY, ORDER)
    differing = streamed.exceptAll(whole).unionByName(whole.exceptAll(streamed)).agg(F.count(F.lit(1))).scalar()
    return whole.agg(F.count(F.lit(1)).alias("users")).withColumn("equal", differing == 0)
