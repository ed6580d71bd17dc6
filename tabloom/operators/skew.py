"""Joins by key that stay balanced when one key holds a large share of the rows.

The probing side keeps all its rows.  The key side holds every key once before it is shuffled: repeats collapse inside
each map task.  What remains is a probing key that repeats very often: the few keys that may do so are found by a
frequent-items sketch, whose size is bounded by its support and does not grow with the data.  Their rows, and those
without a key, are answered where they are, by a broadcast of these few keys alone; only the other rows are shuffled.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUPPORT = 0.002  # a key below this share of the rows is never worth splitting; at most 1/SUPPORT keys are above it


def frequent_keys(df: DataFrame, key: Column, support: float = SUPPORT) -> DataFrame:
    """Keys (as 64-bit hashes) that may hold more than ``support`` of the rows: a superset, of at most 1/support rows.

    One scan of the key column; map tasks send their sketch, not rows.
    """
    sketch = df.select(key.alias("hot")).freqItems(["hot"], support)
    return sketch.select(F.explode("hot_freqItems").alias("hot")).distinct()


def _fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark, by its own size estimate and threshold, would broadcast a DataFrame."""
    threshold = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= threshold


def _joined(rows: DataFrame, known: DataFrame, on: list[str], how: str) -> DataFrame:
    """Rows joined with a side that holds every key once, frequent keys and NULL apart from the rest.

    The rows are read once for the sketch and once for each of the two parts.
    """
    digest = F.xxhash64(*[F.col(c) for c in on])
    keyless = reduce(operator.or_, [F.col(c).isNull() for c in on])
    hot = F.broadcast(frequent_keys(rows.where(~keyless), digest))  # at most 1/SUPPORT rows of 8 bytes
    found = F.col("_digest") == F.col("hot")
    parts = rows.withColumn("_digest", digest).join(hot, found, "left")
    parts = parts.withColumn("_apart", F.col("hot").isNotNull() | keyless).drop("hot", "_digest")
    few = known.withColumn("_digest", digest).join(hot, found, "left_semi").drop("_digest")  # one row per frequent key
    apart = parts.where("_apart").drop("_apart").join(F.broadcast(few), on, how)
    return apart.unionByName(parts.where("not _apart").drop("_apart").join(known, on, how))


def keep_by_key(rows: DataFrame, keys: DataFrame, on: list[str], present: bool, unique: bool = False) -> DataFrame:
    """Rows whose key is present in ``keys`` (or absent from it).  A NULL key is never present.

    ``unique`` says that ``keys`` holds every key once already.
    """
    how = "left_semi" if present else "left_anti"
    known = keys.select(*on).dropna()
    if _fits_broadcast(known):
        return rows.join(known, on, how)  # the rows are not shuffled, so no key can be too frequent
    return _joined(rows, known if unique else known.distinct(), on, how).select(*rows.columns)


def look_up(rows: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """Rows with the columns of ``facts``, which holds every key once; rows without a match keep NULL there."""
    if _fits_broadcast(facts):
        return rows.join(facts, on, "left")
    return _joined(rows, facts.dropna(subset=on), on, "left")
