"""Load modes, refreshes, derived tables and exports, written through the store where the operator writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom import types as hub
from tabloom.checks import Registry, frames
from tabloom.functions.hashing import row_hash
from tabloom.naming import normalize_headers
from tabloom.operators import exchange, export, load, profile
from tabloom.operators.mapping import apply_mapping
from tabloom.plans import derived, refresh
from tabloom.plans.file_load import load_file, load_new_files
from tabloom.plans.refresh import Source
from tabloom.session import fresh_path, materialize
from tabloom.sources import external
from tabloom.sources.store import TableStore
from tabloom.types import ColumnSpec

registry = Registry()

ORDERS_MAPPING = [
    ColumnSpec("o_orderkey", "o_orderkey", hub.BIGINT),
    ColumnSpec("o_custkey", "o_custkey", hub.BIGINT),
    ColumnSpec("o_orderstatus", "o_orderstatus", hub.TEXT),
    ColumnSpec("o_totalprice", "o_totalprice", hub.DECIMAL),
    ColumnSpec("o_orderdate", "o_orderdate", hub.DATE),
    ColumnSpec("o_orderpriority", "o_orderpriority", hub.TEXT),
]
_FILE = f"({frames.ORDERS_FILE_SQL})"
_TYPED_ORDERS = frames.typed_sql("orders")
_TYPED_FILE = frames.typed_sql("orders", f"{_FILE} f")
_KEPT = f"SELECT * FROM ({_TYPED_ORDERS}) t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_FILE} f)"


def _store(spark) -> TableStore:
    return TableStore(spark, fresh_path(spark, "store"))


def _target_text(spark, folder):
    return frames.text_table(spark, folder, "orders")


def _file_text(spark, folder):
    changed = frames.orders_file(spark, folder)
    return changed.select(*frames.text_columns(changed))


def _hashed(raw):
    return apply_mapping(raw, ORDERS_MAPPING, with_hash=True)


def _pair(spark, folder):
    return _hashed(_target_text(spark, folder)), _hashed(_file_text(spark, folder))


def _stored_pair(spark, folder):
    """The same, converted and hashed once: for what reads either side more than once."""
    target, incoming = _pair(spark, folder)
    return materialize(target, "target"), materialize(incoming, "incoming")


def _shown(df):
    return frames.shown(df.drop(hub.ROW_HASH))


@registry.query("load_replace", _TYPED_FILE)
def load_replace(spark, folder):
    """A table without row hashes is replaced as a whole."""
    store = _store(spark)
    store.publish("orders", apply_mapping(_target_text(spark, folder), ORDERS_MAPPING), "replace", "first")
    return _shown(store.load("orders", _file_text(spark, folder), ORDERS_MAPPING, "replace", "second"))


@registry.query("load_delta_replace", _TYPED_FILE)
def load_delta_replace(spark, folder):
    store = _store(spark)
    store.load("orders", _target_text(spark, folder), ORDERS_MAPPING, "replace", "first")
    return _shown(store.load("orders", _file_text(spark, folder), ORDERS_MAPPING, "replace", "second"))


@registry.query("load_append", f"{_TYPED_ORDERS} UNION ALL {_TYPED_FILE}")
def load_append(spark, folder):
    store = _store(spark)
    store.load("orders", _target_text(spark, folder), ORDERS_MAPPING, "replace", "first")
    return _shown(store.load("orders", _file_text(spark, folder), ORDERS_MAPPING, "append", "second"))


@registry.query("load_upsert", f"{_KEPT} UNION ALL {_TYPED_FILE}")
def load_upsert(spark, folder):
    store = _store(spark)
    store.load("orders", _target_text(spark, folder), ORDERS_MAPPING, "replace", "first")
    return _shown(store.load("orders", _file_text(spark, folder), ORDERS_MAPPING, "upsert", "second", key="o_orderkey"))


@registry.query(
    "load_delta_precomputed",
    f"""SELECT * FROM ({_TYPED_ORDERS}) t WHERE o_orderstatus <> 'F' UNION ALL SELECT f.* FROM ({_TYPED_FILE}) f WHERE f.o_orderkey < 0
 OR f.o_orderstatus = 'P'""",
)
def load_delta_precomputed(spark, folder):
    """The sender lists all hashes of one status as removed; of the file only rows the target lacks go in."""
    target, incoming = _stored_pair(spark, folder)
    new = incoming.where("o_orderkey < 0 or o_orderstatus = 'P'")
    removed = target.where("o_orderstatus = 'F'").select(hub.ROW_HASH)
    return _shown(load.delta_precomputed(target, new, removed))


@registry.query("load_file", f"SELECT * FROM ({frames.typed_sql('lineitem')}) l")
def load_file_query(spark, folder):
    """A delimited file, detected, profiled, converted and loaded."""
    path = fresh_path(spark, "file")
    frames.text_table(spark, folder, "lineitem").write.option("sep", ";").option("header", True).csv(path)
    return _shown(load_file(_store(spark), "lineitem", path, "replace", "first"))


@registry.query("load_same_file", f"SELECT 'first' AS loaded, * FROM ({_TYPED_ORDERS}) o")
def load_same_file(spark, folder):
    """A file loaded twice: the second load finds no change and writes no row."""
    store = _store(spark)
    store.load("orders", _target_text(spark, folder), ORDERS_MAPPING, "replace", "first")
    second = store.load("orders", _target_text(spark, folder), ORDERS_MAPPING, "replace", "second")
    folder_of = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return _shown(second.withColumn("loaded", folder_of))


_HASHED = frames.hash_sql([c for c, _ in frames.columns_of("orders")])


_CHANGES = f"""WITH t AS (SELECT {_HASHED} AS row_hash FROM ({frames.text_sql('orders')}) o), f AS (SELECT {_HASHED} AS row_hash FROM (
 {frames.text_sql('orders').replace('FROM orders', f'FROM {_FILE} x')}) o) SELECT row_hash, 'removed' AS change, 1 AS n FROM t WHERE
 row_hash NOT IN (SELECT row_hash FROM f) UNION ALL SELECT row_hash, 'added', 1 FROM f WHERE row_hash NOT IN (SELECT row_hash FROM t)"""


def _told(changes):
    """A change set in words."""
    return changes.select(
        hub.ROW_HASH,
        F.when(F.col("target_rows") > 0, "removed").otherwise("added").alias("change"),
        (F.col("target_rows") + F.col("file_rows")).cast("int").alias("n"),
    )


@registry.query("delta_changes", _CHANGES)
def delta_changes(spark, folder):
    return _told(load.delta_changes(*_pair(spark, folder)))


@registry.query("delta_reconciled", _CHANGES)
def delta_reconciled(spark, folder):
    """The same change set from trees of hash sums and the hashes of those leaves that differ."""
    target, incoming = _stored_pair(spark, folder)
    return _told(exchange.reconciled_changes(target, incoming, exchange.tree_depth(target.count())))


@registry.query("delta_prep", f"SELECT {_HASHED} AS row_hash FROM ({frames.text_sql('orders')}) o")
def delta_prep(spark, folder):
    return load.delta_prep(_hashed(_target_text(spark, folder)), ORDERS_MAPPING)


@registry.query(
    "load_counts",
    f"""SELECT 'upsert' AS mode, (SELECT count(*) FROM {_FILE} f) AS inserted, (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT
 o_orderkey FROM {_FILE} f)) AS updated UNION ALL SELECT 'delta', n, n FROM (SELECT count(*) AS n FROM orders WHERE o_orderpriority =
 '1-URGENT' OR o_orderstatus = 'P') c""",
)
def load_counts(spark, folder):
    target, incoming = _stored_pair(spark, folder)
    changes = load.delta_changes(target, incoming)
    upserted = load.upsert_counts(target, incoming, "o_orderkey").withColumn("mode", F.lit("upsert"))
    delta = load.delta_counts(target, changes).withColumn("mode", F.lit("delta"))
    return upserted.unionByName(delta)


_CHANGED = "(SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'P')"


@registry.query(
    "load_log",
    f"""SELECT 'orders' AS table_name, 1::BIGINT AS version, 'replace' AS mode, count(*) AS row_count, count(*) AS inserted, 0::BIGINT AS
 updated FROM orders UNION ALL SELECT 'orders', 2, 'delta-replace', count(*), {_CHANGED}, {_CHANGED} FROM orders UNION ALL SELECT
 'orders', 3, 'append', 2 * count(*), count(*), 0 FROM orders UNION ALL SELECT 'orders', 4, 'upsert', 2 * count(*) - count(*) FILTER
 (WHERE o_orderpriority <> '1-URGENT'), count(*), count(*) + count(*) FILTER (WHERE o_orderpriority <> '1-URGENT') FROM orders""",
)
def load_log(spark, folder):
    """The versions a table went through, with the counts of each load."""
    store = _store(spark)
    for load_id, raw, mode in (
        ("first", _target_text(spark, folder), "replace"),
        ("second", _file_text(spark, folder), "replace"),
        ("third", _target_text(spark, folder), "append"),
        ("fourth", _target_text(spark, folder), "upsert"),
    ):
        store.load("orders", raw, ORDERS_MAPPING, mode, load_id, key="o_orderkey")
    return store.versions().select("table_name", "version", "mode", "row_count", "inserted", "updated")


@registry.query(
    "schema_compat",
    """SELECT 'lineitem' AS table_name, count(*) AS row_count, false AS fits FROM lineitem UNION ALL SELECT 'orders', count(*), true FROM
 orders""",
)
def schema_compat(spark, folder):
    """Each table against the mapping of orders."""
    out = None
    for name in ("lineitem", "orders"):
        raw = frames.text_table(spark, folder, name)
        typed = apply_mapping(raw, profile.infer_mapping(raw), with_hash=True)
        fits = not load.schema_mismatches(typed, ORDERS_MAPPING)
        row = typed.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", F.lit(fits).alias("fits")
        )
        out = row if out is None else out.unionByName(row)
    return out


@registry.query(
    "file_dedupe",
    """SELECT min(doc_id) AS doc_id, octet_length(encode(text)) AS size_bytes, md5(text) AS md5 FROM documents WHERE doc_id NOT IN (SELECT
 doc_id FROM documents WHERE text IN (SELECT text FROM documents SEMI JOIN labels USING (doc_id))) GROUP BY text""",
)
def file_dedupe(spark, folder):
    """Documents as uploads; those that have a label were loaded before."""
    documents = frames.table(spark, folder, "documents").select("doc_id", F.col("text").alias("content"))
    loaded = documents.join(frames.table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi")
    none = documents.where(F.lit(False)).select(
        F.octet_length("content").cast("bigint").alias("size_bytes"), F.col("content").alias("md5")
    )
    return load.dedupe_payloads(documents, load.dedupe_payloads(loaded, none, "doc_id"), "doc_id")


# --- external sources -----------------------------------------------------------------------------------------


def _orders_source(spark, folder, reader=frames.table, **options) -> Source:
    read = (lambda: frames.orders_file(spark, folder)) if reader is frames.orders_file else (
        lambda: frames.table(spark, folder, "orders")
    )
    return Source("orders", read, **options)


_CANONICAL_FILE = _TYPED_FILE.replace("CAST(CAST(o_orderdate AS DATE) AS VARCHAR)", "o_orderdate")
_CANONICAL_ORDERS = _TYPED_ORDERS.replace("CAST(CAST(o_orderdate AS DATE) AS VARCHAR)", "o_orderdate")
MARK = "1998-06-01"


@registry.query(
    "source_refresh",
    f"""SELECT * FROM ({_CANONICAL_ORDERS}) t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_FILE} f) UNION ALL {_CANONICAL_FILE}""",
)
def source_refresh(spark, folder):
    """A keyed source pulled twice in full; rows it no longer has stay."""
    store = _store(spark)
    refresh.refresh(store, _orders_source(spark, folder, key="o_orderkey"), "first")
    second = _orders_source(spark, folder, frames.orders_file, key="o_orderkey")
    return _shown(refresh.refresh(store, second, "second").rows)


@registry.query(
    "incremental_extract",
    f"""WITH pulled AS (SELECT * FROM ({_CANONICAL_FILE}) f WHERE o_orderdate > TIMESTAMP '{MARK}') SELECT * FROM ({_CANONICAL_ORDERS}) t
 WHERE o_orderkey NOT IN (SELECT o_orderkey FROM pulled) UNION ALL SELECT * FROM pulled""",
)
def incremental_extract(spark, folder):
    """Only rows beyond the stored mark, which was set back to a day, are pulled and upserted."""
    store = _store(spark)
    options = {"key": "o_orderkey", "delta_column": "o_orderdate"}
    refresh.refresh(store, _orders_source(spark, folder, **options), "first")
    second = _orders_source(spark, folder, frames.orders_file, **options)
    store.log_refresh("orders", "set-back", "completed", MARK)
    return _shown(refresh.refresh(store, second, "second").rows)


@registry.query(
    "next_watermark",
    f"""SELECT 'pulled' AS pull, max(o_orderdate) AS watermark FROM orders WHERE o_orderdate > TIMESTAMP '{MARK}' UNION ALL
 SELECT 'nothing new', TIMESTAMP '2090-01-01'""",
)
def next_watermark(spark, folder):
    orders = frames.table(spark, folder, "orders")
    out = None
    for name, mark in (("pulled", MARK), ("nothing new", "2090-01-01")):
        pulled = external.newer_than(orders, "o_orderdate", mark)
        row = external.next_watermark(pulled, "o_orderdate", mark).select(F.lit(name).alias("pull"), "watermark")
        out = row if out is None else out.unionByName(row)
    return out


@registry.query(
    "extract_group",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, md5('customer|part|supplier') AS group_id FROM {t}"
        for t in ("customer", "part", "supplier")
    ),
)
def extract_group(spark, folder):
    members = [
        Source(t, lambda t=t: frames.table(spark, folder, t)) for t in ("customer", "part", "supplier")
    ]
    return refresh.extract_group(_store(spark), members, "load")


@registry.query(
    "copy_dataset",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS copied_rows FROM {t}" for t in frames.ALL_TABLES),
)
def copy_dataset(spark, folder):
    tables = {t: frames.table(spark, folder, t) for t in frames.ALL_TABLES}
    return refresh.copy_tables(_store(spark), tables, "copy")


# --- derived tables ---------------------------------------------------------------------------------------------

_DERIVED = """SELECT o_custkey, count(*) AS orders, min(o_orderdate) AS first_order, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS
 DOUBLE) AS total FROM orders GROUP BY o_custkey"""


@registry.query("derived_refresh", _DERIVED)
def derived_refresh(spark, folder):
    scope = {"sales": {"orders": frames.table(spark, folder, "orders")}}
    stored, _ = derived.refresh_derived(_store(spark), "per_customer", _DERIVED, scope, "first")
    return stored


@registry.query(
    "allocation_derived",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN coalesce(gross, 0) = 0 THEN 0.0 ELSE coalesce(net, 0) * l_extendedprice / gross
 END AS net_allocated, CASE WHEN coalesce(gross, 0) = 0 THEN 0.0 ELSE coalesce(l_discount, 0) * l_extendedprice / gross END AS
 discount_allocated, CASE WHEN coalesce(gross, 0) = 0 THEN 0.0 ELSE l_extendedprice / gross END AS allocation_rate FROM (SELECT *, CASE
 WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity END AS gross, CASE WHEN l_linestatus = 'F' THEN l_tax END
 AS net FROM lineitem) l""",
)
def allocation_derived(spark, folder):
    lines = frames.table(spark, folder, "lineitem").withColumns(
        {
            "gross": F.when(F.col("l_returnflag") == "R", F.lit(0.0)).when(F.col("l_returnflag") == "A", F.col("l_quantity")),
            "net": F.when(F.col("l_linestatus") == "F", F.col("l_tax")),
        }
    )
    shared = derived.allocate(lines, "gross", "net", "l_discount", "l_extendedprice")
    return shared.select(
        "l_orderkey", "l_linenumber", "l_partkey", "net_allocated", "discount_allocated", "allocation_rate"
    )


# --- exports ----------------------------------------------------------------------------------------------------


def _quoted_sql(c: str, sep: str) -> str:
    return f"""CASE WHEN {c} IS NULL THEN '' WHEN contains({c}, '{sep}') OR contains({c}, '"') OR contains({c}, chr(10)) THEN '"' ||
 replace({c}, '"', '""') || '"' ELSE {c} END"""


@registry.query(
    "export_csv_lines",
    "SELECT " + " || ';' || ".join(_quoted_sql(c, ";") for c in ("CAST(doc_id AS VARCHAR)", "text", "lang", "source"))
    + " AS line FROM documents",
)
def export_csv_lines(spark, folder):
    return export.export_csv(frames.table(spark, folder, "documents").select("doc_id", "text", "lang", "source"))


@registry.query(
    "export_query_lines",
    "SELECT "
    + " || ',' || ".join(
        f"""'"' || replace(coalesce({c}, ''), '"', '""') || '"'""" for c in ("CAST(conv_id AS VARCHAR)", "role", "text")
    )
    + " AS line FROM conversations",
)
def export_query_lines(spark, folder):
    return export.export_query(frames.table(spark, folder, "conversations").select("conv_id", "role", "text"))


@registry.query(
    "export_ndjson",
    """SELECT '{"c_custkey":"' || c_custkey || '","c_name":"' || c_name || '","c_nationkey":"' || c_nationkey || '","segment":' || CASE WHEN
 c_mktsegment = 'MACHINERY' THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}' AS line FROM customer""",
)
def export_ndjson(spark, folder):
    customers = frames.table(spark, folder, "customer").select(
        "c_custkey",
        "c_name",
        "c_nationkey",
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("segment"),
    )
    return export.export_ndjson(customers)


@registry.query(
    "column_dictionary",
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"({i}::BIGINT, '{c};{c};{t};Sim')"
        for i, (c, t) in enumerate(
            [(c, {"int": "BIGINT", "str": "NVARCHAR(MAX)", "dec": "DECIMAL(18,4)", "day": "DATE"}[k]) for c, k in frames.columns_of("lineitem")],
            start=1,
        )
    )
    + ") d(ordinal, line)",
)
def column_dictionary(spark, folder):
    """The dictionary of a table as its content was profiled."""
    return export.column_dictionary(profile.infer_mapping(frames.text_table(spark, folder, "lineitem")), spark)


@registry.query(
    "folder_load",
    "SELECT t.name AS table_name, c_nationkey, t.n * count(*) AS n_rows, sum(t.n * c_custkey)::BIGINT AS sum_keys FROM customer, "
    "(VALUES ('one', 2), ('two', 1)) AS t(name, n) GROUP BY t.name, t.n, c_nationkey",
)
def folder_load(spark, folder):
    """Customers as a file, an equal copy and one in another order, loaded into two tables by content and tried twice."""
    store, base = _store(spark), fresh_path(spark, "files")
    rows = frames.table(spark, folder, "customer").select("c_custkey", "c_nationkey").coalesce(1)
    for name, order in (("a", F.asc("c_custkey")), ("b", F.asc("c_custkey")), ("c", F.desc("c_custkey"))):
        rows.sortWithinPartitions(order).write.option("sep", ";").option("header", True).csv(f"{base}/{name}")
    known = {"separator": ";", "encoding": "UTF-8", "multiline": False}
    for table, files in (("one", f"{base}/*"), ("two", f"{base}/[ab]"), ("one", f"{base}/*"), ("two", f"{base}/a")):
        load_new_files(store, table, files, "run", **known)
    held = [store.read(table).withColumn("table_name", F.lit(table)) for table in ("one", "two")]
    return held[0].unionByName(held[1]).groupBy("table_name", "c_nationkey").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("c_custkey").alias("sum_keys")
    )
