"""The driver's tables in the roles the operators need: text files, catalog tables, logs.

Each role is given twice, as a DataFrame and as the SQL that selects the same rows, always over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = {
    "region": "r_regionkey:int r_name:str",
    "nation": "n_nationkey:int n_name:str n_regionkey:int",
    "customer": "c_custkey:int c_name:str c_nationkey:int c_acctbal:dec c_mktsegment:str",
    "supplier": "s_suppkey:int s_name:str s_nationkey:int s_acctbal:dec",
    "part": "p_partkey:int p_name:str p_brand:str p_type:str p_size:int p_retailprice:dec",
    "orders": "o_orderkey:int o_custkey:int o_orderstatus:str o_totalprice:dec o_orderdate:day o_orderpriority:str",
    "lineitem": (
        "l_orderkey:int l_partkey:int l_suppkey:int l_linenumber:int l_quantity:dec l_extendedprice:dec "
        "l_discount:dec l_tax:dec l_returnflag:str l_linestatus:str l_shipdate:day"
    ),
    "events": "event_id:int ts:moment user_id:int event_type:str value:dec props:str",
}
ALL_TABLES = (*TABLES, "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SEGMENT_SCOPES = {"GLOBAL": ("MACHINERY",), "PROJECT": ("HOUSEHOLD", "BUILDING")}
NOW = "2024-01-07 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def columns_of(name: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in TABLES[name].split()]


def text_columns(df: DataFrame) -> list[Column]:
    """Columns as a Brazilian spreadsheet writes them: 1.234,5600 and 31/12/2024."""
    out = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType):
            column = F.translate(F.format_number(column, 4), ",.", ".,")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            pattern = "yyyy-MM-dd HH:mm:ss.SSSSSS" if field.name == "ts" else "dd/MM/yyyy"
            column = F.date_format(column, pattern)
        else:
            column = column.cast("string")
        out.append(column.alias(field.name))
    return out


def text_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = table(spark, folder, name)
    return df.select(*text_columns(df))


_TEXT_SQL = {
    "int": "CAST({0} AS VARCHAR)",
    "str": "{0}",
    "dec": "translate(format('{{:,.4f}}', {0}), ',.', '.,')",
    "day": "strftime({0}, '%d/%m/%Y')",
    "moment": "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')",
}


def text_sql(name: str) -> str:
    """SELECT of a table with every column as text."""
    parts = [f"{_TEXT_SQL[kind].format(c)} AS {c}" for c, kind in columns_of(name)]
    return f"SELECT {', '.join(parts)} FROM {name}"


_TYPED_SQL = {
    "int": "CAST({0} AS BIGINT)",
    "str": "{0}",
    "dec": "CAST(CAST({0} AS DECIMAL(18,4)) AS DOUBLE)",
    "day": "CAST(CAST({0} AS DATE) AS VARCHAR)",
    "moment": "date_trunc('millisecond', {0})",
}


def typed_sql(name: str, source: str | None = None) -> str:
    """SELECT of a table as a load types it, as ``shown``."""
    parts = [f"{_TYPED_SQL[kind].format(c)} AS {c}" for c, kind in columns_of(name)]
    return f"SELECT {', '.join(parts)} FROM {source or name}"


SHOWN_AS = {T.DecimalType: "double", T.DateType: "string"}


def shown(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text, so that results compare across engines."""
    return df.select(
        *[
            F.col(f.name).cast(SHOWN_AS[type(f.dataType)]).alias(f.name) if type(f.dataType) in SHOWN_AS else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    """Whole numbers that may be NULL as text: engines hand them to Python in different types."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def blank_sql(expr: str) -> str:
    return f"trim({expr}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(65279)) = ''"


def hash_sql(columns: list[str]) -> str:
    """Row hash of text columns."""
    fields = [
        f"""CASE WHEN {c} IS NULL OR {blank_sql(c)} THEN '""' ELSE '"' || replace(regexp_replace(regexp_replace({c},
        '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '[\\n\\r\\t|]', ' ', 'g'), '"', '""') || '"' END"""
        for c in columns
    ]
    return f"md5(concat_ws('|', {', '.join(fields)}))"


# --- a target table and a file that changes it -------------------------------------------------------------------
# The file re-issues urgent orders under new numbers and raises the price of pending ones; all else stays.


def orders_file(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.withColumns(
        {
            "o_orderkey": F.when(F.col("o_orderpriority") == "1-URGENT", -F.col("o_orderkey") - 1).otherwise(
                F.col("o_orderkey")
            ),
            "o_totalprice": F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(
                F.col("o_totalprice")
            ),
        }
    ).select(*orders.columns)


ORDERS_FILE_SQL = """SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN -o_orderkey - 1 ELSE o_orderkey END AS o_orderkey,
 o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
 o_orderdate, o_orderpriority FROM orders"""


# --- catalog and log tables ---------------------------------------------------------------------------------------


def _pick(column: Column, limits: list[tuple[float, str]], last: str) -> Column:
    out = None
    for limit, label in limits:
        out = F.when(column < limit, label) if out is None else out.when(column < limit, label)
    return out.otherwise(last)


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    value, key = F.col("value"), F.get_json_object("props", "$.k").cast("bigint")
    done = F.timestamp_add("SECOND", F.floor(value), F.col("ts"))
    return events.select(
        F.col("event_id").alias("job_id"),
        F.col("event_type").alias("type"),
        _pick(value, [(10, "QUEUED"), (30, "RUNNING"), (100, "COMPLETED")], "FAILED").alias("status"),
        F.col("ts").alias("created_at"),
        F.when(value >= 20, F.col("ts")).alias("locked_at"),
        done.alias("updated_at"),
        done.alias("heartbeat_at"),
        (key % 5).alias("attempts"),
        F.lit(3).cast("bigint").alias("max_attempts"),
        F.col("props").alias("payload"),
    )


JOBS_SQL = """jobs AS (SELECT event_id AS job_id, event_type AS type, CASE WHEN value < 10 THEN 'QUEUED' WHEN value < 30
 THEN 'RUNNING' WHEN value < 100 THEN 'COMPLETED' ELSE 'FAILED' END AS status, ts AS created_at, CASE WHEN value >= 20 THEN
 ts END AS locked_at, ts + to_seconds(CAST(floor(value) AS BIGINT)) AS updated_at, ts + to_seconds(CAST(floor(value) AS
 BIGINT)) AS heartbeat_at, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS attempts, CAST(3 AS BIGINT) AS
 max_attempts, props AS payload FROM events)"""


def last_moment(spark: SparkSession, folder: str) -> Column:
    """The log's own present: its newest entry, never the wall clock."""
    return table(spark, folder, "events").agg(F.max("ts")).scalar()


LAST_MOMENT_SQL = "(SELECT max(ts) FROM events)"


def _minutes_on(balance: Column) -> Column:
    return F.timestamp_add("MINUTE", F.floor(balance), F.lit("2024-01-01").cast("timestamp_ntz"))


def sources(spark: SparkSession, folder: str) -> DataFrame:
    balance = F.col("s_acctbal")
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        key.alias("source_id"),
        F.col("s_name").alias("source_name"),
        F.col("s_nationkey").cast("bigint").alias("dataset_id"),
        (F.col("s_nationkey") % 3).cast("bigint").alias("connection_id"),
        F.when(balance > 1000, F.concat(F.lit("s"), (F.col("s_nationkey") % 2).cast("string"))).alias("source_schema"),
        F.when(balance < 7000, "table").otherwise("query").alias("source_kind"),
        F.when(balance > 9000, "kept").alias("group_id"),
        (balance >= 0).alias("active"),
        F.when(balance < 5000, "extract").otherwise("live").alias("mode"),
        F.when(balance > 500, "0 4 * * *").alias("refresh_cron"),
        _minutes_on(balance).alias("next_refresh_at"),
        F.when(balance < 6000, "running").otherwise("completed").alias("last_status"),
        F.when(balance < 8000, key).alias("target_table_id"),
    )


SOURCES_SQL = """sources AS (SELECT s_suppkey AS source_id, s_name AS source_name, CAST(s_nationkey AS BIGINT) AS
 dataset_id, CAST(s_nationkey % 3 AS BIGINT) AS connection_id, CASE WHEN s_acctbal > 1000 THEN 's' || (s_nationkey % 2) END
 AS source_schema, CASE WHEN s_acctbal < 7000 THEN 'table' ELSE 'query' END AS source_kind, CASE WHEN s_acctbal > 9000 THEN
 'kept' END AS group_id, s_acctbal >= 0 AS active, CASE WHEN s_acctbal < 5000 THEN 'extract' ELSE 'live' END AS mode,
 CASE WHEN s_acctbal > 500 THEN '0 4 * * *' END AS refresh_cron, TIMESTAMP '2024-01-01' + to_minutes(CAST(floor(s_acctbal)
 AS BIGINT)) AS next_refresh_at, CASE WHEN s_acctbal < 6000 THEN 'running' ELSE 'completed' END AS last_status,
 CASE WHEN s_acctbal < 8000 THEN s_suppkey END AS target_table_id FROM supplier)"""


def catalog_tables(spark: SparkSession, folder: str) -> DataFrame:
    balance = F.col("s_acctbal")
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("table_id"),
        F.concat(F.lit("t"), (F.col("s_suppkey") % 40).cast("string")).alias("table_name"),
        F.col("s_nationkey").cast("bigint").alias("dataset_id"),
        F.when(balance >= 0, _minutes_on(balance)).alias("last_data_at"),
    )


CATALOG_TABLES_SQL = """tables AS (SELECT s_suppkey AS table_id, 't' || (s_suppkey % 40) AS table_name, CAST(s_nationkey AS
 BIGINT) AS dataset_id, CASE WHEN s_acctbal >= 0 THEN TIMESTAMP '2024-01-01' + to_minutes(CAST(floor(s_acctbal) AS BIGINT))
 END AS last_data_at FROM supplier)"""


def datasets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("dataset_id"),
        F.col("n_regionkey").cast("bigint").alias("project_id"),
        F.col("n_name").alias("dataset_name"),
    )


DATASETS_SQL = """datasets AS (SELECT CAST(n_nationkey AS BIGINT) AS dataset_id, CAST(n_regionkey AS BIGINT) AS project_id,
 n_name AS dataset_name FROM nation)"""


def projects(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "region").select(
        F.col("r_regionkey").cast("bigint").alias("project_id"), F.col("r_name").alias("project_name")
    )


PROJECTS_SQL = "projects AS (SELECT CAST(r_regionkey AS BIGINT) AS project_id, r_name AS project_name FROM region)"


def grants(spark: SparkSession, folder: str) -> DataFrame:
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey").cast("bigint")
    scope = (
        F.when(segment.isin(*SEGMENT_SCOPES["GLOBAL"]), "GLOBAL")
        .when(segment.isin(*SEGMENT_SCOPES["PROJECT"]), "PROJECT")
        .otherwise("DATASET")
    )
    return table(spark, folder, "customer").select(
        F.floor(F.col("c_custkey") / 3).alias("principal"),
        scope.alias("scope_type"),
        F.when(scope == "PROJECT", nation % 5).when(scope == "DATASET", nation).alias("scope_id"),
        _pick(F.col("c_acctbal"), [(0, "ADMIN"), (5000, "READ")], "WRITE").alias("permission"),
    )


GRANTS_SQL = """grants AS (SELECT c_custkey // 3 AS principal, scope_type, CASE scope_type WHEN 'PROJECT' THEN CAST(
 c_nationkey % 5 AS BIGINT) WHEN 'DATASET' THEN CAST(c_nationkey AS BIGINT) END AS scope_id, CASE WHEN c_acctbal < 0 THEN
 'ADMIN' WHEN c_acctbal < 5000 THEN 'READ' ELSE 'WRITE' END AS permission FROM (SELECT *, CASE WHEN c_mktsegment =
 'MACHINERY' THEN 'GLOBAL' WHEN c_mktsegment IN ('HOUSEHOLD', 'BUILDING') THEN 'PROJECT' ELSE 'DATASET' END AS scope_type
 FROM customer))"""


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    priority = F.substring("o_orderpriority", 1, 1)
    open_status = (
        F.when(priority == "1", "PENDING_UPLOAD").when(priority == "2", "IMPORTING").otherwise("QUEUED_IMPORT")
    )
    status = F.col("o_orderstatus")
    return orders.select(
        F.col("o_orderkey").alias("upload_id"),
        F.when(status == "O", open_status).when(status == "F", "COMPLETED").otherwise("FAILED").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.when(status == "F", 0).otherwise(F.floor("o_totalprice")).cast("bigint").alias("row_count"),
        F.when(priority != "5", F.concat(F.lit('{"rowCount":'), F.col("o_custkey").cast("string"), F.lit("}"))).alias(
            "preview"
        ),
    )


UPLOADS_SQL = """uploads AS (SELECT o_orderkey AS upload_id, CASE WHEN o_orderstatus = 'O' THEN CASE o_orderpriority[1:1]
 WHEN '1' THEN 'PENDING_UPLOAD' WHEN '2' THEN 'IMPORTING' ELSE 'QUEUED_IMPORT' END WHEN o_orderstatus = 'F' THEN 'COMPLETED'
 ELSE 'FAILED' END AS status, o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE CAST(floor(o_totalprice)
 AS BIGINT) END AS row_count, CASE WHEN o_orderpriority[1:1] <> '5' THEN '{"rowCount":' || o_custkey || '}' END AS preview
 FROM orders)"""


def versions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("table_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderkey").alias("version_id"),
    )


VERSIONS_SQL = "versions AS (SELECT o_custkey AS table_id, o_orderdate AS created_at, o_orderkey AS version_id FROM orders)"
