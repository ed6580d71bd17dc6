"""Aggregates, joins, set operations and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.checks import Registry, frames
from tabloom.functions.display import feed_value
from tabloom.operators import load, profile, ranking, reconcile
from tabloom.plans.scoped_sql import run_query

registry = Registry()
MONEY = "DECIMAL(18,4)"


def _total(column: str):
    return F.sum(F.col(column).cast("decimal(18,4)")).cast("double")


def _total_sql(column: str) -> str:
    return f"CAST(sum(CAST({column} AS {MONEY})) AS DOUBLE)"


@registry.query("agg_sum_total", f"SELECT {_total_sql('l_extendedprice')} AS total FROM lineitem")
def agg_sum_total(spark, folder):
    return frames.table(spark, folder, "lineitem").agg(_total("l_extendedprice").alias("total"))


@registry.query(
    "agg_by_category",
    f"SELECT l_returnflag, {_total_sql('l_extendedprice')} AS total, count(*) AS n FROM lineitem GROUP BY l_returnflag",
)
def agg_by_category(spark, folder):
    lines = frames.table(spark, folder, "lineitem")
    return lines.groupBy("l_returnflag").agg(_total("l_extendedprice").alias("total"), F.count(F.lit(1)).alias("n"))


@registry.query(
    "agg_range_filter",
    f"""SELECT count(*) AS n, {_total_sql('l_extendedprice')} AS total FROM lineitem
 WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'""",
)
def agg_range_filter(spark, folder):
    first, last = (F.lit(d).cast("timestamp_ntz") for d in ("1997-01-01", "1997-06-30"))
    lines = frames.table(spark, folder, "lineitem").where(F.col("l_shipdate").between(first, last))
    return lines.agg(F.count(F.lit(1)).alias("n"), _total("l_extendedprice").alias("total"))


@registry.query(
    "agg_by_date",
    f"SELECT l_shipdate, {_total_sql('l_extendedprice')} AS total FROM lineitem GROUP BY l_shipdate ORDER BY l_shipdate",
)
def agg_by_date(spark, folder):
    lines = frames.table(spark, folder, "lineitem")
    return lines.groupBy("l_shipdate").agg(_total("l_extendedprice").alias("total")).orderBy("l_shipdate")


@registry.query(
    "agg_two_keys",
    f"""SELECT l_returnflag, l_linestatus, {_total_sql('l_extendedprice')} AS total, count(*) AS n FROM lineitem
 WHERE l_extendedprice > 50000 GROUP BY l_returnflag, l_linestatus""",
)
def agg_two_keys(spark, folder):
    lines = frames.table(spark, folder, "lineitem").where("l_extendedprice > 50000")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        _total("l_extendedprice").alias("total"), F.count(F.lit(1)).alias("n")
    )


@registry.query(
    "agg_count_distinct",
    "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag",
)
def agg_count_distinct(spark, folder):
    """Distinct pairs first: repeats collapse in the map tasks and the pairs of one group are spread by part."""
    pairs = frames.table(spark, folder, "lineitem").select("l_returnflag", "l_partkey").distinct()
    return pairs.groupBy("l_returnflag").agg(F.count("l_partkey").alias("parts"))


@registry.query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
)
def duplicate_keys(spark, folder):
    return load.duplicate_keys(frames.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@registry.query(
    "content_check",
    """SELECT o_orderpriority, count(*) AS row_count, min(o_orderkey) AS min_value, max(o_orderkey) AS max_value,
 CAST(sum(o_orderkey) AS BIGINT) AS sum_value FROM orders GROUP BY o_orderpriority""",
)
def content_check(spark, folder):
    return reconcile.content_check(frames.table(spark, folder, "orders"), "o_orderpriority", "o_orderkey")


# --- SQL over a scope -------------------------------------------------------------------------------------------


def _scope(spark, folder):
    names = {
        "sales": ("orders", "lineitem", "customer"),
        "supply": ("supplier", "part"),
        "world": ("nation", "region"),
        "log": ("events", "documents", "labels"),
    }
    return {d: {t: frames.table(spark, folder, t) for t in tables} for d, tables in names.items()}


def _scoped(name: str, sql: str, oracle: str | None = None) -> None:
    registry.query(name, oracle or sql)(lambda spark, folder: run_query(spark, sql, _scope(spark, folder)))


_scoped(
    "sql_join_inner",
    f"""SELECT c_mktsegment, o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS {MONEY})) AS DOUBLE) AS total
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderpriority""",
)
_scoped(
    "sql_join_left",
    """SELECT n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey
 AND s_acctbal > 0 GROUP BY n_name""",
)
_scoped(
    "sql_join_right",
    """SELECT d.lang, count(l.doc_id) AS labelled, count(*) AS docs FROM labels l RIGHT JOIN documents d
 ON l.doc_id = d.doc_id GROUP BY d.lang""",
)
_scoped(
    "sql_join_full",
    """SELECT coalesce(c.nation, s.nation) AS nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers
 FROM
 (SELECT c_nationkey AS nation, count(*) AS customers FROM customer WHERE c_acctbal < 1000 GROUP BY c_nationkey) c
 FULL JOIN (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier WHERE s_acctbal > 2000 GROUP BY s_nationkey) s
 ON c.nation = s.nation""",
)
_scoped(
    "sql_set_ops",
    """SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)
 UNION ALL SELECT 'unused' AS kind, k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier)
 UNION SELECT 'region' AS kind, r_regionkey AS k FROM region""",
)
_scoped(
    "sql_group_having",
    "SELECT o_custkey, count(*) AS n, min(o_orderdate) AS since FROM orders GROUP BY o_custkey HAVING count(*) > 12",
)
_scoped(
    "sql_cte",
    f"""WITH per_order AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS {MONEY})) AS total FROM lineitem GROUP BY l_orderkey),
 big AS (SELECT * FROM per_order WHERE total > 200000)
 SELECT o_orderstatus, count(*) AS n, CAST(sum(total) AS DOUBLE) AS total FROM big JOIN orders ON l_orderkey = o_orderkey
 GROUP BY o_orderstatus""",
)
_scoped(
    "sql_window",
    """SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (
 PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) t WHERE rn <= 3""",
)
_scoped(
    "sql_subquery",
    """SELECT p_type, count(*) AS n FROM part WHERE p_partkey IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount > 0.05)
 AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 49) f WHERE f.l_partkey = p_partkey)
 GROUP BY p_type""",
)


# --- pages ------------------------------------------------------------------------------------------------------


@registry.query(
    "page_limit_offset",
    "SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100",
)
def page_limit_offset(spark, folder):
    orders = frames.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return ranking.page(orders, 50, 100, ["o_orderdate", "o_orderkey"])


@registry.query(
    "page_truncated",
    """SELECT c_custkey, c_name, (SELECT count(*) FROM customer) > 120 AS truncated FROM customer ORDER BY c_custkey
 LIMIT 120""",
)
def page_truncated(spark, folder):
    customers = frames.table(spark, folder, "customer").select("c_custkey", "c_name")
    return ranking.page_with_flag(customers, 120, ["c_custkey"])


@registry.query(
    "preview_rows", "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20"
)
def preview_rows(spark, folder):
    documents = frames.table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return profile.preview(documents, [F.desc("n_chars"), "doc_id"])


@registry.query(
    "feed_page",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS ts, event_type,
 200 + row_number() OVER (ORDER BY event_id) AS _row_number FROM (SELECT * FROM events ORDER BY event_id LIMIT 300 OFFSET 200)
 t""",
)
def feed_page(spark, folder):
    events = frames.table(spark, folder, "events")
    return ranking.feed_page(events, ["event_id"], 300, 200, ["event_type", "ts", "event_id", "missing"])


@registry.query("feed_count", "SELECT CAST(count(*) AS VARCHAR) AS count FROM events")
def feed_count(spark, folder):
    return ranking.feed_count(frames.table(spark, folder, "events"))


@registry.query(
    "feed_values",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS VARCHAR)
 AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders""",
)
def feed_values(spark, folder):
    typed = frames.table(spark, folder, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.col("o_totalprice").cast("decimal(18,4)").alias("o_totalprice"),
        F.col("o_orderdate").cast("date").alias("o_orderdate"),
    )
    return typed.select(*[feed_value(F.col(f.name), f.dataType).alias(f.name) for f in typed.schema.fields])


@registry.query(
    "audit_cursor_page",
    """SELECT event_id, ts, event_type FROM events WHERE ts < TIMESTAMP '2024-01-15 12:00:00' OR
 (ts = TIMESTAMP '2024-01-15 12:00:00' AND event_id < 5000) ORDER BY ts DESC, event_id DESC LIMIT 100""",
)
def audit_cursor_page(spark, folder):
    events = frames.table(spark, folder, "events").select("event_id", "ts", "event_type")
    return ranking.cursor_page(events, "ts", "event_id", ("2024-01-15 12:00:00", 5000))


@registry.query(
    "latest_per_key",
    """SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
 ORDER BY ts DESC, event_id DESC) AS rn FROM events) t WHERE rn = 1""",
)
def latest_per_key(spark, folder):
    events = frames.table(spark, folder, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return load.latest_per_key(events, ["user_id", "event_type"], ["ts", "event_id"])


@registry.query(
    "sliding_rate",
    """SELECT user_id, moment, requests, used, greatest(0, 60 - used) AS remaining, used > 60 AS over_limit FROM (
 SELECT user_id, ts AS moment, n AS requests, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN
 59999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM (SELECT user_id, ts, count(*) AS n FROM events GROUP BY
 user_id, ts) i) t""",
)
def sliding_rate(spark, folder):
    return ranking.sliding_rate(frames.table(spark, folder, "events"), "user_id", "ts")


DAY_MICROS = 86_400_000_000


@registry.query(
    "admissions",
    f"""WITH RECURSIVE i AS (SELECT event_type, epoch_us(ts) AS t, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY
 epoch_us(ts)) AS rn FROM events WHERE ts IS NOT NULL GROUP BY 1, 2), walk AS (SELECT event_type, rn, t, n, least(n, 60) AS admitted,
 [{{'t': t, 'a': least(n, 60)}}] AS live FROM i WHERE rn = 1 UNION ALL SELECT event_type, rn, t, n, least(n, room) AS admitted,
 list_append(kept, {{'t': t, 'a': least(n, room)}}) AS live FROM (SELECT event_type, rn, t, n, kept, 60 - CAST(coalesce(list_sum(
 list_transform(kept, lambda x: x.a)), 0) AS BIGINT) AS room FROM (SELECT i.event_type, i.rn, i.t, i.n, list_filter(w.live, lambda x:
 x.t > i.t - {DAY_MICROS} AND x.a > 0) AS kept FROM walk w JOIN i ON i.event_type IS NOT DISTINCT FROM w.event_type AND i.rn = w.rn + 1)
 k) r) SELECT event_type, make_timestamp(t) AS moment, n AS requests, CAST(admitted AS BIGINT) AS admitted, CAST(n - admitted AS BIGINT)
 AS refused FROM walk""",
)
def admissions(spark, folder):
    return ranking.admissions(frames.table(spark, folder, "events"), "event_type", "ts", window_micros=DAY_MICROS)
