"""Column statistics, inferred types, listings and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.checks import Registry, frames
from tabloom.checks.conversions import date_sql
from tabloom.functions.convert import convert_source
from tabloom.naming import normalize_headers
from tabloom.operators import mapping as mapped
from tabloom.operators import profile
from tabloom.operators.reconcile import table_counts
from tabloom.session import fresh_path, materialize

registry = Registry()

FILE_ROWS = 500_000  # of a file that arrives, so that what a task holds does not grow with the table

_DECIMAL = r"-?\d{1,3}(?:[.,]\d{3})*,\d+|-?\d+[.,]\d+"
_INT = r"regexp_full_match(t, '-?\d+')"
_ZERO = r"regexp_full_match(t, '0\d+')"


def _column_sql(table: str, position: int, column: str) -> str:
    """Statistics of one text column, rule by rule."""
    text = dict(frames.columns_of(table))
    v = frames._TEXT_SQL[text[column]].format(column)
    decimal = f"(regexp_full_match(t, '{_DECIMAL}') OR ({_INT} AND NOT {_ZERO}))"
    timed = r"regexp_matches(t, '[T ]\d{2}:\d{2}')"
    return f"""SELECT {position} AS ordinal, '{column}' AS column_name, count(t) AS sample_count, count(t) < count(*) AS has_null,
 coalesce(max(CASE WHEN t IS NOT NULL THEN length(v) END), 0) AS max_len, coalesce(bool_and({_INT} AND NOT {_ZERO}), true) AS all_int,
 coalesce(bool_and({decimal}), true) AS all_decimal, coalesce(bool_and(d IS NOT NULL), true) AS all_date,
 coalesce(bool_or(d IS NOT NULL AND {timed}), false) AS has_time,
 coalesce(bool_and(regexp_full_match(t, '\\d{{1,2}}:\\d{{2}}(:\\d{{2}})?')), true) AS all_time,
 coalesce(bool_or({_ZERO}), false) AS looks_identifier, count(*) AS row_count, coalesce(sum(strlen(v)), 0) AS text_bytes
 FROM (SELECT v, t, {date_sql('t')} AS d FROM (SELECT v, nullif(trim(v, ' ' || chr(9) || chr(10) || chr(13)), '') AS t FROM (
 SELECT {v} AS v FROM {table}) a) b) c"""


def _stats_sql(table: str) -> str:
    return " UNION ALL ".join(
        _column_sql(table, i, c) for i, (c, _) in enumerate(frames.columns_of(table), start=1)
    )


_TYPE_SQL = """CASE WHEN sample_count = 0 OR looks_identifier OR regexp_matches(column_name,
 '(^|[_\\s-])(cpf|cnpj|cep|telefone|phone|celular|whats|codigo|cod|sku|id|documento|doc)([_\\s-]|$)', 'i') THEN 'NVARCHAR(MAX)'
 WHEN all_int THEN 'BIGINT' WHEN all_decimal THEN 'DECIMAL(18,4)' WHEN all_date AND has_time THEN 'DATETIME2'
 WHEN all_date THEN 'DATE' WHEN all_time THEN 'TIME' ELSE 'NVARCHAR(MAX)' END"""


@registry.query(
    "minimum_slice",
    """SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS total, count(*) AS n FROM lineitem
 GROUP BY l_returnflag""",
)
def minimum_slice(spark, folder):
    """From text to a typed aggregate: profile, infer, convert, group."""
    raw = frames.text_table(spark, folder, "lineitem")
    typed = mapped.apply_mapping(raw, profile.infer_mapping(raw))
    return typed.groupBy("l_returnflag").agg(
        F.sum("l_extendedprice").cast("double").alias("total"), F.count(F.lit(1)).alias("n")
    )


@registry.query(
    "column_stats",
    f"SELECT * EXCLUDE (row_count, text_bytes) FROM ({_stats_sql('lineitem')} UNION ALL {_stats_sql('events')}) s",
)
def column_stats(spark, folder):
    lines, events = (frames.text_table(spark, folder, t) for t in ("lineitem", "events"))
    return profile.column_stats(lines).unionByName(profile.column_stats(events))


@registry.query("profiles_merged", f"SELECT * EXCLUDE (row_count, text_bytes) FROM ({_stats_sql('lineitem')} UNION ALL {_stats_sql('events')}) s")
def profiles_merged(spark, folder):
    """Each file of a folder is profiled when it arrives; the stored profiles answer for all rows."""

    def of_table(name):
        table = frames.text_table(spark, folder, name)
        files = max(8, -(-table.count() // FILE_ROWS))  # counted from the file's footer
        rows = materialize(table.repartition(files), "arrived")
        stored, file = fresh_path(spark, "profiles"), F.col("_metadata.file_name")
        for batch in (0, 1):
            arrived = rows.where(F.crc32(file.cast("binary")) % 2 == batch)
            profile.part_profiles(arrived, file).write.mode("append").parquet(stored)
        return profile.merged_stats(spark.read.parquet(stored), rows.columns)

    return of_table("lineitem").unionByName(of_table("events"))


def _inferred_sql(table: str) -> str:
    return f"""SELECT '{table}' AS table_name, ordinal, column_name AS original_name, column_name AS sql_name, {_TYPE_SQL} AS sql_type
 FROM ({_stats_sql(table)}) s"""


@registry.query("infer_schema", " UNION ALL ".join(_inferred_sql(t) for t in frames.TABLES))
def infer_schema(spark, folder):
    parts = [
        profile.infer_schema(frames.text_table(spark, folder, t)).withColumn("table_name", F.lit(t)) for t in frames.TABLES
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@registry.query(
    "profile_tables",
    " UNION ALL ".join(
        f"""SELECT table_name, CAST(max(rows) AS BIGINT) AS row_count, CAST(sum(n) AS BIGINT) AS column_count, CAST(sum(bytes) AS
 BIGINT) AS text_bytes, string_agg(sql_type || ' x' || n, ', ' ORDER BY sql_type || ' x' || n) AS column_types FROM (SELECT
 '{t}' AS table_name, {_TYPE_SQL} AS sql_type, count(*) AS n, max(row_count) AS rows, sum(text_bytes) AS bytes FROM
 ({_stats_sql(t)}) s GROUP BY 2) h GROUP BY table_name"""
        for t in frames.TABLES
    ),
)
def profile_tables(spark, folder):
    return profile.profile_tables({t: frames.text_table(spark, folder, t) for t in frames.TABLES})


@registry.query(
    "profile_largest",
    "SELECT table_name, row_count, round(row_count / sum(row_count) OVER (), 4) AS share FROM ("
    + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in frames.ALL_TABLES)
    + ") c ORDER BY row_count DESC, table_name LIMIT 5",
)
def profile_largest(spark, folder):
    counts = table_counts({t: frames.table(spark, folder, t) for t in frames.ALL_TABLES}, "row_count")
    return profile.largest(counts, "row_count")


@registry.query(
    "range_check", "SELECT count(*) AS row_count, min(ts) AS min_value, max(ts) AS max_value FROM events"
)
def range_check(spark, folder):
    return profile.range_check(frames.table(spark, folder, "events"), "ts")


_CANONICAL = {"int": "BIGINT", "str": "NVARCHAR(MAX)", "dec": "DECIMAL(18,4)", "day": "DATETIME2", "moment": "DATETIME2"}


@registry.query(
    "list_columns",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, {i} AS ordinal, '{c}' AS column_name, '{_CANONICAL[kind]}' AS sql_type, (SELECT count(*) FROM "
        f"{t}) AS row_count"
        for t in frames.TABLES
        for i, (c, kind) in enumerate(frames.columns_of(t), start=1)
    ),
)
def list_columns(spark, folder):
    tables = {t: frames.table(spark, folder, t) for t in frames.TABLES}
    return profile.list_columns(tables).join(table_counts(tables, "row_count"), "table_name")


@registry.query(
    "describe_source",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{_CANONICAL[kind]}' AS sql_type, count({c}) AS filled FROM orders"
        for c, kind in frames.columns_of("orders")
    ),
)
def describe_source(spark, folder):
    """Types from analysis alone, next to how many rows have a value."""
    orders = frames.table(spark, folder, "orders")
    columns = [
        F.struct(
            F.lit(c.sql_name).alias("column_name"), F.lit(c.sql_type).alias("sql_type"), F.col(c.sql_name).alias("filled")
        )
        for c in mapped.describe_source(orders)
    ]
    return orders.agg(*[F.count(c).alias(c) for c in orders.columns]).select(F.inline(F.array(*columns)))


@registry.query(
    "canonicalize_types",
    f"""SELECT event_id, ts, user_id, event_type, value, props, CAST(NULL AS VARCHAR) AS list FROM ({frames.typed_sql('events')}) e
 UNION ALL SELECT vec_id, NULL, CAST(label AS BIGINT), NULL, NULL, NULL, CAST(len(embedding) AS VARCHAR) FROM embeddings""",
)
def canonicalize_types(spark, folder):
    events = frames.shown(mapped.canonicalize(frames.table(spark, folder, "events")))
    vectors = mapped.canonicalize(frames.table(spark, folder, "embeddings"))
    # A vector becomes JSON text; its length is compared, for engines print floats differently.
    length = F.size(F.from_json("embedding", "array<float>")).cast("string")
    return events.withColumn("list", F.lit(None).cast("string")).unionByName(
        vectors.select(
            F.col("vec_id").alias("event_id"), F.col("label").alias("user_id"), length.alias("list")
        ),
        allowMissingColumns=True,
    )


_HEADERS = ["Pedido Nº", "Pedido Nº", "", "1ª Linha", "Quantidade", "Preço (R$)", "Desconto %", "Taxa", "Retorno", "Situação", "Data"]


@registry.query(
    "normalize_headers",
    "SELECT CAST(sum(l_orderkey) AS BIGINT) AS pedido_n, CAST(sum(l_partkey) AS BIGINT) AS pedido_n_2, CAST(sum(l_suppkey) AS BIGINT) "
    "AS col_3, CAST(sum(l_linenumber) AS BIGINT) AS col_1_linha, count(l_shipdate) AS data, count(*) AS preco_r FROM lineitem",
)
def normalize_headers_query(spark, folder):
    lines = frames.table(spark, folder, "lineitem").toDF(*normalize_headers(_HEADERS))
    return lines.agg(
        F.sum("pedido_n").alias("pedido_n"),
        F.sum("pedido_n_2").alias("pedido_n_2"),
        F.sum("col_3").alias("col_3"),
        F.sum("col_1_linha").alias("col_1_linha"),
        F.count("data").alias("data"),
        F.count("preco_r").alias("preco_r"),
    )


@registry.query(
    "convert_source_values",
    """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN floor(l_extendedprice) * 2e9 < 1e14 THEN CAST(floor(l_extendedprice) * 2e9 AS DECIMAL(18,4))
 END AS DOUBLE) AS scaled, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber, l_extendedprice""",
)
def convert_source_values(spark, folder):
    lines = frames.table(spark, folder, "lineitem").withColumn("big", F.floor("l_extendedprice").cast("double") * 2e9)
    scaled = convert_source(F.col("big"), lines.schema["big"].dataType).cast("double")
    return lines.groupBy("l_orderkey", "l_linenumber", scaled.alias("scaled"), "l_extendedprice").agg(
        F.count(F.lit(1)).alias("n")
    ).drop("l_extendedprice")
