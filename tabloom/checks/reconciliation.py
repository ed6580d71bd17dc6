"""Counts, fingerprints and losses between source and target."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.checks import Registry, frames
from tabloom.checks.loads import ORDERS_MAPPING
from tabloom.operators import load, reconcile
from tabloom.operators.mapping import apply_mapping
from tabloom.plans import refresh
from tabloom.session import fresh_path
from tabloom.sources import file_stats
from tabloom.sources.store import TableStore

registry = Registry()
DIGITS = 2
COMPARED = ("supplier", "part", "orders")


def _line_sql(table: str) -> str:
    """MD5 of a row as source and target spell it."""
    spelled = {
        "int": "CAST({0} AS VARCHAR)",
        "str": "{0}",
        "dec": "CAST(CAST({0} AS DECIMAL(18,4)) AS VARCHAR)",
        "day": "CASE WHEN year({0}) BETWEEN 1753 AND 9999 THEN strftime({0}, '%Y-%m-%d %H:%M:%S') END",
    }
    texts = [spelled[kind].format(c) for c, kind in frames.columns_of(table)]
    fields = [f"coalesce(strlen({text}) || ':' || {text}, '-')" for text in texts]
    return f"SELECT md5(concat_ws('|', {', '.join(fields)})) AS h FROM {table}"


@registry.query(
    "table_fingerprint",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, CAST(sum(n) AS BIGINT) AS row_count, md5(string_agg(prefix || '=' || digest, '' ORDER BY prefix))
 AS fingerprint FROM (SELECT h[1:{DIGITS}] AS prefix, sum(n) AS n, md5(string_agg(h || ':' || n, '' ORDER BY h)) AS digest FROM (SELECT h,
 count(*) AS n FROM ({_line_sql(t)}) l GROUP BY h) c GROUP BY 1) p"""
        for t in ("orders", "lineitem")
    ),
)
def table_fingerprint(spark, folder):
    orders, lines = (
        reconcile.table_fingerprint(frames.table(spark, folder, t), DIGITS).withColumn("table_name", F.lit(t))
        for t in ("orders", "lineitem")
    )
    return orders.unionByName(lines)


@registry.query(
    "table_fingerprint_scalable",
    f"""SELECT count(*) AS row_count, CAST(sum(CAST(('0x' || h[1:15]) AS BIGINT)) AS VARCHAR) AS sum_high, CAST(sum(CAST(('0x' || h[17:31])
 AS BIGINT)) AS VARCHAR) AS sum_low FROM ({_line_sql('lineitem')}) l""",
)
def table_fingerprint_scalable(spark, folder):
    return reconcile.fingerprint_sums(frames.table(spark, folder, "lineitem"))


@registry.query(
    "compare_tables",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, count(*) AS source_count, count(*) {"- count(*) FILTER (WHERE p_size > 40)" if t == "part" else ""} AS
 target_count, {"false" if t != "supplier" else "true"} AS equal FROM {t}"""
        for t in COMPARED
    ),
)
def compare_tables(spark, folder):
    """A faithful copy, one that lost rows, and one whose prices changed."""
    supplier, part, orders = (frames.table(spark, folder, t) for t in COMPARED)
    copied = TableStore(spark, fresh_path(spark, "store"))
    copy = copied.publish("supplier", supplier.repartition(5, "s_name"), "copy", "first")
    cheaper = orders.withColumn("o_totalprice", F.col("o_totalprice") - 0.5)
    return reconcile.compare_tables(
        {"supplier": (supplier, copy), "part": (part, part.where("p_size <= 40")), "orders": (orders, cheaper)}
    )


@registry.query(
    "count_audit",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, count(*) AS source_count, {"count(*)" if t != "part" else "count(*) FILTER (WHERE p_size <= 40)"} AS
 target_count, {"NULL" if t == "orders" else "CAST(count(*) AS VARCHAR)"} AS catalog_count, '{"ok" if t == "supplier" else "diff"}' AS status FROM {t}"""
        for t in COMPARED
    ),
)
def count_audit(spark, folder):
    supplier, part, orders = (frames.table(spark, folder, t) for t in COMPARED)
    sources = reconcile.table_counts({"supplier": supplier, "part": part, "orders": orders}, "source_count")
    targets = reconcile.table_counts(
        {"supplier": supplier, "part": part.where("p_size <= 40"), "orders": orders}, "target_count"
    )
    catalog = reconcile.table_counts({"supplier": supplier, "part": part}, "catalog_count")
    return frames.as_text(reconcile.count_audit(sources, targets, catalog), "catalog_count")


@registry.query(
    "integrity_counts",
    """SELECT count(*) AS expected_rows, count(*) AS actual_rows, true AS complete FROM lineitem""",
)
def integrity_counts(spark, folder):
    lines = frames.table(spark, folder, "lineitem")
    store = TableStore(spark, fresh_path(spark, "store"))
    return load.integrity_counts(lines, store.publish("lineitem", lines, "replace", "first"))


@registry.query(
    "row_loss_funnel",
    """WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT 1::BIGINT AS step, 'lines' AS stage,
 count(*) AS row_count FROM lines UNION ALL SELECT 2, 'not blank', count(*) FROM lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
 UNION ALL SELECT 3, 'distinct', count(DISTINCT line) FROM lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> '')
 SELECT step, stage, row_count, coalesce(lag(row_count) OVER (ORDER BY step) - row_count, 0) AS lost FROM s""",
)
def row_loss_funnel(spark, folder):
    """Lines of text on their way into a table that holds each line once."""
    lines = frames.table(spark, folder, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    filled = lines.where(F.btrim("line", F.lit(" \t\r")) != "")
    return reconcile.loss_funnel([("lines", lines), ("not blank", filled), ("distinct", filled.distinct())])


@registry.query(
    "fingerprint_of_copy",
    """SELECT 'orders' AS table_name, count(*) AS source_count, count(*) AS target_count, true AS equal FROM orders""",
)
def fingerprint_of_copy(spark, folder):
    """Orders through text, conversion and the store equal the orders that were typed directly."""
    raw = frames.text_table(spark, folder, "orders")
    store = TableStore(spark, fresh_path(spark, "store"))
    stored = store.publish("orders", apply_mapping(raw, ORDERS_MAPPING), "replace", "first")
    direct = refresh.extract(frames.table(spark, folder, "orders")).withColumn(
        "o_orderdate", F.col("o_orderdate").cast("date")
    )
    return reconcile.compare_tables({"orders": (direct, stored)})


@registry.query(
    "fingerprint_of_stored",
    f"""SELECT count(*) AS row_count, CAST(sum(CAST(('0x' || h[1:15]) AS BIGINT)) AS VARCHAR) AS sum_high, CAST(sum(CAST(('0x' || h[17:31])
 AS BIGINT)) AS VARCHAR) AS sum_low FROM ({_line_sql('orders')}) l""",
)
def fingerprint_of_stored(spark, folder):
    """Orders without the open ones are published and described; the open ones are upserted, and only their files are read again."""
    store = TableStore(spark, fresh_path(spark, "store"))
    orders = frames.table(spark, folder, "orders")
    store.publish("orders", orders.where("o_orderstatus <> 'O'"), "replace", "first")
    file_stats.stored_fingerprint(store, "orders")
    store.upsert("orders", orders.where("o_orderstatus = 'O'"), "o_orderkey", "second")
    return file_stats.stored_fingerprint(store, "orders")
