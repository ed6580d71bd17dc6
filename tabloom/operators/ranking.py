"""Newest rows per group, request rates, pages."""

from __future__ import annotations

import datetime
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.display import feed_value
from tabloom.functions.moments import from_micros, unix_micros

# Requests per minute each kind of call allows; page sizes.
RATE_LIMITS = {"query": 60, "upload": 10, "default": 120}
WINDOW_MICROS = 60_000_000
MAX_PAGE = 10_000
FEED_PAGE = 5_000
PREVIEW_ROWS = 100
CURSOR_PAGE = 100
NEAR_ROWS = 100_000  # an offset up to this is skipped in the sorted head of the result
RANGES = 256  # into which a result is counted to get near a larger offset
SAMPLES_PER_RANGE = 20


def keep_newest(df: DataFrame, group: str, order: list[str], keep: int = 10) -> DataFrame:
    """The newest ``keep`` rows of each group, with their rank.

    Up to a bound, Spark itself drops later rows of a group inside the map tasks (WindowGroupLimit), and a group's
    reducer receives ``keep`` rows from each of them at most.  Beyond it the same is done here: a group is first ranked
    in as many slices as there are reducers.
    """
    spark = df.sparkSession
    newest_first = [F.desc(c) for c in order]
    if keep > int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
        sliced = df.withColumn("slice", F.spark_partition_id() % slices)
        within = Window.partitionBy(group, "slice").orderBy(*newest_first)
        df = sliced.withColumn("rn", F.row_number().over(within)).where(F.col("rn") <= keep).drop("slice", "rn")
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*newest_first)))
    return ranked.where(F.col("rn") <= keep)


def _used(requests: DataFrame, principal: str, moment: str, window_micros: int) -> DataFrame:
    """Instants of each principal, their requests, and those within the window that ends there.

    Time is cut into blocks of a window's length.  An instant enters its own block; the block after has it from the start and
    loses it a window later.  So a busy principal's history is many small groups, and one running sum in each of them answers,
    however many instants a window holds.
    """
    instants = requests.groupBy(principal, unix_micros(F.col(moment)).alias("micros")).agg(
        F.count(F.lit(1)).alias("requests")
    )
    block, micros, n = F.floor(F.col("micros") / window_micros), F.col("micros"), F.col("requests")
    steps = [(block, micros, n, True), (block + 1, micros, n, False), (block + 1, micros + window_micros, -n, False)]
    places = [F.struct(at.alias("block"), when.alias("when"), by.alias("by"), F.lit(own).alias("own")) for at, when, by, own in steps]
    upto = Window.partitionBy(principal, "place.block").orderBy("place.when")  # and all of the same instant
    placed = instants.withColumn("place", F.explode(F.array(*places))).withColumn("used", F.sum("place.by").over(upto))
    return placed.where("place.own").drop("place")


def _contested(used: DataFrame, principal: str, limit: int, window_micros: int) -> DataFrame:
    """``used`` with ``contested``: whether an instant has one beyond the limit within a window after it, or is one.

    Instants stand in their own block and in the block before, which then holds all that its own ones can see.
    """
    block = F.floor(F.col("micros") / window_micros)
    places = [F.struct(at.alias("block"), F.lit(own).alias("own")) for at, own in ((block, True), (block - 1, False))]
    later = Window.partitionBy(principal, "place.block").orderBy(F.desc("micros"))
    beyond = F.min(F.when(F.col("used") > limit, F.col("micros"))).over(later)  # the nearest from here on
    placed = used.withColumn("place", F.explode(F.array(*places))).withColumn("beyond", beyond).where("place.own")
    near = F.col("beyond") - F.col("micros") < window_micros
    return placed.withColumn("contested", F.coalesce(near, F.lit(False))).drop("place", "used", "beyond")


def sliding_rate(requests: DataFrame, principal: str, moment: str, limit: int = RATE_LIMITS["query"]) -> DataFrame:
    """Requests of each principal within the minute up to each instant it made one, against its limit.

    Requests of one instant are counted first.  The instants are then cut into minutes: a minute and the one before it
    hold all that a count needs, so a busy principal's history is spread over many small windows, each read once.
    """
    return _used(requests, principal, moment, WINDOW_MICROS).select(
        principal,
        from_micros(F.col("micros")).alias("moment"),
        "requests",
        "used",
        F.greatest(F.lit(0), F.lit(limit) - F.col("used")).cast("bigint").alias("remaining"),
        (F.col("used") > limit).alias("over_limit"),
    )


def _replay(limit: int, window_micros: int):
    """Function of Arrow batches in the order of (principal, run, micros): appends how many requests of each instant pass.

    It holds the instants of the last window that let a request pass, ``limit`` at most, and starts anew with each run.
    """

    def replayed(batches):
        live, passing = deque(), 0
        for batch in batches:
            admitted = []
            for micros, run, requests in zip(*[batch.column(c).to_pylist() for c in ("micros", "run", "requests")]):
                if micros == run:
                    live.clear()
                    passing = 0
                while live and live[0][0] <= micros - window_micros:
                    passing -= live.popleft()[1]
                admitted.append(min(requests, limit - passing))
                if admitted[-1]:
                    live.append((micros, admitted[-1]))
                    passing += admitted[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(admitted, pa.int64())], [*batch.schema.names, "admitted"])

    return replayed


def admissions(
    requests: DataFrame, principal: str, moment: str, limit: int = RATE_LIMITS["query"], window_micros: int = WINDOW_MICROS
) -> DataFrame:
    """What a limiter lets pass: requests and admitted requests of each principal at each instant it made any.

    A request passes if fewer than ``limit`` have passed in the window up to it; one that is refused leaves no trace, so a
    decision depends on all before it.  Where all requests of the window fit the limit, they pass, whatever came before.  Only
    instants that have one beyond the limit within a window after them, or are one, are replayed in order, in runs that
    begin where the window before is empty of such instants.  One run is sequential by nature; it streams through a
    task that holds ``limit`` instants at most.  Requests of one instant pass in any order.  NULL is a principal like
    any other; requests without a moment are left out.
    """
    if limit < 1 or window_micros < 1:
        raise ValueError("limit and window must be positive")
    used = _used(requests.where(F.col(moment).isNotNull()), principal, moment, window_micros)
    marked = _contested(used, principal, limit, window_micros)
    free = marked.where("not contested").select(principal, "micros", "requests", F.col("requests").alias("admitted"))
    contested = marked.where("contested").drop("contested")
    history = Window.partitionBy(principal).orderBy("micros")
    gap = F.col("micros") - F.lag("micros").over(history)
    starts = contested.withColumn("start", F.when(gap.isNull() | (gap >= window_micros), F.col("micros")))
    runs = starts.withColumn("run", F.last("start", ignorenulls=True).over(history)).drop("start")
    ordered = runs.select(principal, "micros", "requests", "run").repartition(principal, "run")
    ordered = ordered.sortWithinPartitions(principal, "run", "micros")
    schema = T.StructType([*ordered.schema.fields, T.StructField("admitted", T.LongType())])
    decided = ordered.mapInArrow(_replay(limit, window_micros), schema).drop("run")
    return free.unionByName(decided).select(
        principal,
        from_micros(F.col("micros")).alias("moment"),
        "requests",
        "admitted",
        (F.col("requests") - F.col("admitted")).alias("refused"),
    )


def _checked_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"page size must be within 1..{MAX_PAGE}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def _key(df: DataFrame, order_by: list[str], values) -> Column:
    """A row's place in the order, to be compared with ``F.struct(*order_by)``; NULL comes first in both."""
    plain = [str(v) if isinstance(v, (datetime.datetime, datetime.date)) else v for v in values]
    return F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order_by, plain)])


def _near(df: DataFrame, order_by: list[str], offset: int, rows: int) -> tuple[DataFrame, int]:
    """A range of the order that holds the ``rows`` rows from ``offset`` on, and the offset within it.

    A large offset is approached by counting: a bounded sample cuts the order into ranges, one aggregate counts the rows
    of each, and only the ranges of the page are looked at further.  So no task holds the rows before a page.  The sample
    decides how even the ranges are, never which rows are found.  Rows that tie in the order stay in one range.
    """
    key = F.struct(*order_by)
    while offset > NEAR_ROWS:
        total = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
        if offset >= total:
            return df.where(F.lit(False)), 0
        share = min(1.0, RANGES * SAMPLES_PER_RANGE / total)
        drawn = df.select(*order_by).sample(fraction=share, seed=1).distinct().orderBy(*order_by).collect()
        cuts = [_key(df, order_by, values) for values in drawn[:: max(1, len(drawn) // RANGES)]]
        if not cuts:
            break
        place = F.size(F.filter(F.array(*cuts), lambda cut: cut <= key))
        counts = {r["place"]: r["n"] for r in df.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()}
        before, first = 0, 0
        while before + counts.get(first, 0) <= offset:
            before += counts.get(first, 0)
            first += 1
        upto, last = before, first
        while upto < min(total, offset + rows):
            upto += counts.get(last, 0)
            last += 1
        if first:
            df = df.where(key >= cuts[first - 1])
        if last <= len(cuts):
            df = df.where(key < cuts[last - 1])
        offset -= before
        if upto - before == total:  # one range holds all: its rows tie
            break
    return df, offset


def page(df: DataFrame, limit: int, offset: int = 0, order_by: list[str] | None = None) -> DataFrame:
    """One page of a result.  A page beyond the first needs an order, else pages would overlap.

    An offset beyond NEAR_ROWS runs counts first.  A reader that walks a result continues with ``page_after`` instead.
    """
    _checked_page(limit, offset)
    if offset and not order_by:
        raise ValueError("order_by is required with an offset")
    if order_by:
        df, offset = _near(df, order_by, offset, limit)
    ordered = df.orderBy(*order_by) if order_by else df
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def page_after(df: DataFrame, limit: int, order_by: list[str], after: tuple | None = None) -> DataFrame:
    """The page behind a place in the order: a filter that reaches the scan.  The order has to be unique."""
    _checked_page(limit, 0)
    if after is not None:
        df = df.where(F.struct(*order_by) > _key(df, order_by, after))
    return df.orderBy(*order_by).limit(limit)


def continuation(rows: DataFrame, limit: int, order_by: list[str]) -> tuple | None:
    """Where the page behind ``rows`` starts, or None when ``rows`` is not a full page.  An action on one page."""
    end = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*order_by)).alias("last")).first()
    return tuple(end["last"]) if end["n"] == limit else None


def page_with_flag(df: DataFrame, limit: int, order_by: list[str], offset: int = 0) -> DataFrame:
    """One page and, on every row of it, whether more rows follow: one row beyond the page is fetched to know."""
    _checked_page(limit, offset)
    df, offset = _near(df, order_by, offset, limit + 1)
    ordered = df.orderBy(*order_by)
    fetched = (ordered.offset(offset) if offset else ordered).limit(limit + 1)
    whole = Window.partitionBy(F.lit(0))  # a page: MAX_PAGE + 1 rows at most
    return (
        fetched.withColumn("truncated", F.count(F.lit(1)).over(whole) > limit)
        .withColumn("position", F.row_number().over(whole.orderBy(*order_by)))
        .where(F.col("position") <= limit)
        .drop("position")
    )


def feed_page(
    df: DataFrame,
    order_by: list[str],
    top: int = FEED_PAGE,
    skip: int = 0,
    select: list[str] | None = None,
    after: tuple | None = None,
) -> DataFrame:
    """A feed page: known columns of the request in table order, feed spelling of values, and a running row number.

    ``after`` is the continuation of the page before; ``skip`` then only numbers the rows.
    """
    columns = [c for c in df.columns if select is None or c in select]
    if not columns:
        raise ValueError("no known column selected")
    rows = page(df, top, skip, order_by) if after is None else page_after(df, top, order_by, after)
    numbered = rows.withColumn(
        "_row_number", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order_by)) + skip  # one page
    )
    return numbered.select(
        *[feed_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if f.name in columns],
        F.col("_row_number").cast("bigint").alias("_row_number"),
    )


def feed_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("string").alias("count"))


def cursor_page(df: DataFrame, moment: str, tie: str, before: tuple | None, rows: int = CURSOR_PAGE) -> DataFrame:
    """The rows before a cursor, newest first: a filter that reaches the scan, not an offset that re-reads pages."""
    if before is not None:
        last_moment, last_tie = before
        at = F.lit(last_moment).cast(df.schema[moment].dataType)
        df = df.where((F.col(moment) < at) | ((F.col(moment) == at) & (F.col(tie) < F.lit(last_tie))))
    return df.orderBy(F.desc(moment), F.desc(tie)).limit(rows)


def iterate_rows(df: DataFrame):
    """All rows, one partition at a time, for a client that reads a whole result in order of its partitions."""
    return df.toLocalIterator(prefetchPartitions=True)
