"""Grants, retention, freshness, jobs and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.checks import Registry, frames
from tabloom.operators import governance as g
from tabloom.operators.reconcile import orphan_staging as staging
from tabloom.plans.scoped_sql import resolve_tables as resolve

registry = Registry()
NOW = f"TIMESTAMP '{frames.NOW}'"
LAST = frames.LAST_MOMENT_SQL


def _now():
    return F.lit(frames.NOW).cast("timestamp_ntz")


def _with(*tables: str) -> str:
    return "WITH " + ", ".join(tables) + " "


def _requests(spark, folder):
    return frames.table(spark, folder, "events").select(
        F.col("user_id").alias("principal"), F.get_json_object("props", "$.k").cast("bigint").alias("dataset_id")
    )


@registry.query(
    "effective_grants",
    _with(frames.GRANTS_SQL, frames.DATASETS_SQL)
    + """, ranked AS (SELECT *, CASE permission WHEN 'READ' THEN 1 WHEN 'WRITE' THEN 2 ELSE 3 END AS rank FROM grants),
 asked AS (SELECT user_id AS principal, CAST(json_extract_string(props, '$.k') AS BIGINT) AS dataset_id, count(*) AS requests FROM
 events GROUP BY ALL)
 SELECT principal, dataset_id, requests, CASE best WHEN 1 THEN 'READ' WHEN 2 THEN 'WRITE' WHEN 3 THEN 'ADMIN' END AS permission
 FROM (SELECT a.principal, a.dataset_id, a.requests, max(r.rank) AS best FROM asked a LEFT JOIN datasets d USING (dataset_id)
 LEFT JOIN ranked r ON r.principal = a.principal AND (r.scope_type = 'GLOBAL' OR (r.scope_type = 'PROJECT' AND r.scope_id =
 d.project_id) OR (r.scope_type = 'DATASET' AND r.scope_id = a.dataset_id)) GROUP BY ALL) b""",
)
def effective_grants(spark, folder):
    return g.check_access(_requests(spark, folder), frames.grants(spark, folder), frames.datasets(spark, folder))


@registry.query(
    "visible_datasets",
    _with(frames.GRANTS_SQL, frames.DATASETS_SQL)
    + """, everything AS (SELECT DISTINCT principal FROM grants WHERE scope_type = 'GLOBAL')
 SELECT principal, CAST(dataset_id AS VARCHAR) AS dataset_id FROM (
 SELECT principal, CAST(NULL AS BIGINT) AS dataset_id FROM everything UNION ALL (SELECT principal, scope_id FROM grants WHERE
 scope_type = 'DATASET' AND principal NOT IN (SELECT principal FROM everything) UNION SELECT principal, dataset_id FROM grants JOIN
 datasets ON scope_type = 'PROJECT' AND scope_id = project_id WHERE principal NOT IN (SELECT principal FROM everything))) v""",
)
def visible_datasets(spark, folder):
    seen = g.visible_datasets(frames.grants(spark, folder), frames.datasets(spark, folder))
    return frames.as_text(seen, "dataset_id")


@registry.query(
    "retention_purge",
    f"""{_with(frames.JOBS_SQL)} SELECT job_id, status, created_at FROM jobs WHERE NOT (status IN ('COMPLETED', 'FAILED') AND
 created_at < {LAST} - INTERVAL 7 DAY)""",
)
def retention_purge(spark, folder):
    kept = g.retained(
        frames.jobs(spark, folder), "created_at", frames.last_moment(spark, folder), days=7, states=g.FINISHED
    )
    return kept.select("job_id", "status", "created_at")


@registry.query(
    "retention_counts",
    f"""{_with(frames.JOBS_SQL, frames.UPLOADS_SQL, frames.VERSIONS_SQL)} SELECT 'jobs' AS kind, count(*) AS deleted FROM jobs WHERE status IN ('COMPLETED',
 'FAILED') AND created_at < TIMESTAMP '2024-02-10' - INTERVAL 30 DAY UNION ALL SELECT 'audit_events', count(*) FROM jobs WHERE
 created_at < TIMESTAMP '2024-02-10' - INTERVAL 30 DAY UNION ALL SELECT 'uploads', count(*) FROM uploads WHERE status IN ('COMPLETED',
 'FAILED', 'CANCELLED') AND created_at < TIMESTAMP '2024-02-10' - INTERVAL 30 DAY UNION ALL SELECT 'versions', count(*) FROM (SELECT row_number() OVER (
 PARTITION BY table_id ORDER BY created_at DESC, version_id DESC) AS rn FROM versions) r WHERE rn > 10""",
)
def retention_counts(spark, folder):
    jobs = frames.jobs(spark, folder)
    now = F.lit("2024-02-10").cast("timestamp_ntz")
    return g.retention_counts(jobs, jobs, frames.uploads(spark, folder), frames.versions(spark, folder), now)


@registry.query(
    "versions_keep_n",
    f"""{_with(frames.VERSIONS_SQL)} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY created_at DESC,
 version_id DESC) AS rn FROM versions) r WHERE rn <= 10""",
)
def versions_keep_n(spark, folder):
    return g.versions_kept(frames.versions(spark, folder))


@registry.query(
    "stale_tables",
    f"""{_with(frames.PROJECTS_SQL, frames.DATASETS_SQL, frames.CATALOG_TABLES_SQL)} SELECT project_id, project_name, count(DISTINCT
 dataset_id) AS dataset_count, count(table_id) AS table_count, count(*) FILTER (WHERE table_id IS NOT NULL AND (last_data_at IS NULL
 OR last_data_at < {NOW} - INTERVAL 24 HOUR)) AS stale_count FROM projects LEFT JOIN datasets USING (project_id) LEFT JOIN tables
 USING (dataset_id) GROUP BY project_id, project_name""",
)
def stale_tables(spark, folder):
    return g.stale_tables(
        frames.projects(spark, folder), frames.datasets(spark, folder), frames.catalog_tables(spark, folder), _now()
    )


@registry.query(
    "due_refreshes",
    f"""{_with(frames.SOURCES_SQL)} SELECT source_id, next_refresh_at FROM sources WHERE active AND mode = 'extract' AND refresh_cron IS
 NOT NULL AND next_refresh_at <= {NOW} ORDER BY next_refresh_at, source_id LIMIT 20""",
)
def due_refreshes(spark, folder):
    return g.due_refreshes(frames.sources(spark, folder), _now()).select("source_id", "next_refresh_at")


@registry.query(
    "stale_runs",
    f"""{_with(frames.JOBS_SQL)} SELECT job_id, type, attempts, CASE WHEN attempts >= max_attempts THEN 'FAILED' ELSE 'QUEUED' END AS
 next_status, CASE WHEN attempts < max_attempts THEN CAST(least(attempts * 30, 120) AS VARCHAR) END AS retry_delay FROM jobs WHERE status = 'RUNNING'
 AND heartbeat_at < CASE type WHEN 'purchase' THEN {LAST} - INTERVAL 90 MINUTE ELSE {LAST} - INTERVAL 120 SECOND END""",
)
def stale_runs(spark, folder):
    runs = g.stale_runs(frames.jobs(spark, folder), frames.last_moment(spark, folder), import_type="purchase")
    return frames.as_text(runs, "retry_delay")


@registry.query(
    "orphan_jobs",
    f"""{_with(frames.JOBS_SQL)} SELECT c_custkey AS derived_id, c_name AS derived_name FROM customer WHERE c_acctbal < 5000 AND NOT EXISTS
 (SELECT 1 FROM jobs j WHERE j.type = 'purchase' AND j.status IN ('QUEUED', 'RUNNING') AND json_extract_string(j.payload, '$.k') = CAST(c_custkey AS VARCHAR))""",
)
def orphan_jobs(spark, folder):
    derived = frames.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("derived_id"),
        F.col("c_name").alias("derived_name"),
        F.when(F.col("c_acctbal") < 5000, "running").otherwise("completed").alias("last_status"),
    )
    orphans = g.without_active_job(derived, frames.jobs(spark, folder), "derived_id", "k", "purchase")
    return orphans.select("derived_id", "derived_name")


@registry.query(
    "stuck_imports",
    f"""{_with(frames.JOBS_SQL, frames.UPLOADS_SQL)} SELECT upload_id FROM uploads u WHERE status = 'IMPORTING' AND NOT EXISTS (SELECT 1 FROM
 jobs j WHERE j.status IN ('QUEUED', 'RUNNING', 'COMPLETED') AND j.job_id = u.upload_id)""",
)
def stuck_imports(spark, folder):
    jobs = frames.jobs(spark, folder).withColumnRenamed("job_id", "upload_id")
    return g.stuck_imports(frames.uploads(spark, folder), jobs).select("upload_id")


@registry.query(
    "orphan_sources",
    f"""{_with(frames.SOURCES_SQL)} SELECT source_id, target_table_id FROM sources WHERE NOT active AND target_table_id IS NOT NULL""",
)
def orphan_sources(spark, folder):
    return g.inactive_with_table(frames.sources(spark, folder)).select("source_id", "target_table_id")


@registry.query(
    "orphan_staging",
    f"{_with(frames.CATALOG_TABLES_SQL)} SELECT table_id, table_name FROM tables WHERE table_name LIKE 't1%'",
)
def orphan_staging(spark, folder):
    return staging(frames.catalog_tables(spark, folder), "t1").select("table_id", "table_name")


@registry.query(
    "json_key_join",
    f"""{_with(frames.JOBS_SQL, frames.SOURCES_SQL)} SELECT s.source_name, j.status, count(*) AS n FROM jobs j JOIN sources s ON
 json_extract_string(j.payload, '$.k') = CAST(s.source_id AS VARCHAR) GROUP BY s.source_name, j.status""",
)
def json_key_join(spark, folder):
    """Jobs are counted by key and status before they meet their source."""
    jobs = frames.jobs(spark, folder)
    counted = jobs.groupBy(g.json_key(F.col("payload"), "k").alias("ref"), "status").agg(F.count(F.lit(1)).alias("n"))
    named = frames.sources(spark, folder).select(F.col("source_id").cast("string").alias("ref"), "source_name")
    return counted.join(named, "ref").select("source_name", "status", "n")


@registry.query(
    "enrich_jobs",
    f"""{_with(frames.JOBS_SQL, frames.SOURCES_SQL)} SELECT job_id, json_extract_string(payload, '$.k') AS source_ref, source_name FROM
 jobs LEFT JOIN sources ON json_extract_string(payload, '$.k') = CAST(source_id AS VARCHAR)""",
)
def enrich_jobs(spark, folder):
    return g.enrich_jobs(frames.jobs(spark, folder), frames.sources(spark, folder), "k").select(
        "job_id", "source_ref", "source_name"
    )


@registry.query(
    "job_kpis",
    f"""{_with(frames.JOBS_SQL)} SELECT type, count(*) AS total, count(*) FILTER (WHERE status = 'RUNNING') AS running, count(*) FILTER
 (WHERE status = 'QUEUED') AS queued, count(*) FILTER (WHERE status = 'COMPLETED' AND created_at >= {LAST} - INTERVAL 1 DAY) AS
 completed_today, count(*) FILTER (WHERE status = 'FAILED' AND created_at >= {LAST} - INTERVAL 1 DAY) AS failed_today FROM jobs
 GROUP BY type""",
)
def job_kpis(spark, folder):
    return g.job_kpis(frames.jobs(spark, folder), frames.last_moment(spark, folder))


@registry.query(
    "avg_load_seconds",
    f"""{_with(frames.JOBS_SQL)} SELECT CAST(round(avg(epoch_us(updated_at) - epoch_us(locked_at)) / 1000000.0) AS BIGINT) AS avg_seconds
 FROM jobs WHERE status = 'COMPLETED' AND type = 'purchase' AND locked_at IS NOT NULL AND updated_at >= {LAST} - INTERVAL 7 DAY""",
)
def avg_load_seconds(spark, folder):
    return g.average_load_seconds(frames.jobs(spark, folder), frames.last_moment(spark, folder), "purchase")


@registry.query(
    "status_funnel",
    f"""{_with(frames.UPLOADS_SQL)} SELECT stage, n, greatest(20, CAST(floor(n * 100.0::DOUBLE / sum(n) OVER () + 0.5) AS BIGINT)) AS width
 FROM (SELECT CASE WHEN status IN ('PENDING_UPLOAD', 'QUEUED_PREVIEW', 'AWAITING_CONFIRMATION') THEN 'waiting' WHEN status IN
 ('PREVIEWING', 'QUEUED_IMPORT', 'IMPORTING', 'RETRYING') THEN 'active' WHEN status = 'COMPLETED' THEN 'completed' ELSE 'failed' END AS
 stage, count(*) AS n FROM uploads GROUP BY 1) s""",
)
def status_funnel(spark, folder):
    return g.status_funnel(frames.uploads(spark, folder))


@registry.query(
    "refresh_spread",
    f"""{_with(frames.SOURCES_SQL)} SELECT source_id, slot, (slot % 60) || ' ' || (4 + slot // 60) || ' * * *' AS refresh_cron FROM (SELECT
 source_id, CAST(('0x' || md5(CAST(source_id AS VARCHAR))[1:8]) AS BIGINT) % 180 AS slot FROM sources) s""",
)
def refresh_spread(spark, folder):
    return g.refresh_spread(frames.sources(spark, folder))


@registry.query(
    "assign_groups",
    f"""{_with(frames.SOURCES_SQL)} SELECT source_id, CASE WHEN group_id IS NULL AND source_kind = 'table' THEN md5(dataset_id || '|' ||
 connection_id || '|' || coalesce(source_schema, '')) ELSE group_id END AS group_id FROM sources""",
)
def assign_groups(spark, folder):
    return g.assign_groups(frames.sources(spark, folder)).select("source_id", "group_id")


@registry.query(
    "unconnected_tables",
    """SELECT p_brand AS source_schema, p_name || ' ' || p_partkey AS source_table FROM part WHERE lower(p_name) LIKE '%widget%' AND
 p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 AND l_tax > 0.07)""",
)
def unconnected_tables(spark, folder):
    part = frames.table(spark, folder, "part")
    name = F.concat_ws(" ", "p_name", "p_partkey").alias("source_table")
    listing = part.select(F.col("p_brand").alias("source_schema"), name)
    sold = frames.table(spark, folder, "lineitem").where("l_quantity > 49 and l_tax > 0.07").select(F.col("l_partkey").alias("p_partkey"))
    connected = part.join(sold.distinct(), "p_partkey").select(F.col("p_brand").alias("source_schema"), name)
    return g.unconnected_tables(listing, connected, "WIDGET")


@registry.query(
    "table_origin",
    f"""{_with(frames.CATALOG_TABLES_SQL, frames.SOURCES_SQL)} SELECT table_id, table_name, CASE WHEN table_id IN (SELECT target_table_id
 FROM sources WHERE target_table_id IS NOT NULL) THEN 'source' WHEN table_id IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 45)
 THEN 'derived' ELSE 'upload' END AS origin FROM tables""",
)
def table_origin(spark, folder):
    derived = frames.table(spark, folder, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("table_id"))
    from_source = frames.sources(spark, folder).select(F.col("target_table_id").alias("table_id"))
    out = g.table_origin(frames.catalog_tables(spark, folder), from_source, derived)
    return out.select("table_id", "table_name", "origin")


@registry.query(
    "repair_counts",
    f"""{_with(frames.UPLOADS_SQL)} SELECT upload_id, CASE WHEN row_count = 0 AND CAST(json_extract_string(preview, '$.rowCount') AS
 BIGINT) > 0 THEN CAST(json_extract_string(preview, '$.rowCount') AS BIGINT) ELSE row_count END AS row_count FROM uploads""",
)
def repair_counts(spark, folder):
    return g.repair_counts(frames.uploads(spark, folder)).select("upload_id", "row_count")


_PERF_SQL = """perf AS (SELECT o_orderkey AS upload_id, o_custkey * 100 AS rows, o_custkey * 10.0::DOUBLE AS total_ms, CASE WHEN
 o_orderstatus <> 'P' THEN o_custkey * 3.0::DOUBLE END AS convert_ms, CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey *
 5.0::DOUBLE END AS insert_ms FROM orders)"""


@registry.query(
    "load_perf",
    f"""WITH {_PERF_SQL} SELECT upload_id, rows, total_ms / 1000 AS total_seconds, coalesce(convert_ms, 0) / 1000 AS convert_seconds,
 coalesce(insert_ms, 0) / 1000 AS insert_seconds, greatest(total_ms - coalesce(convert_ms, 0) - coalesce(insert_ms, 0), 0) / 1000 AS
 rest_seconds, CASE WHEN insert_ms > 0 THEN round(rows / (insert_ms / 1000), 0) END AS rows_per_second FROM perf""",
)
def load_perf(spark, folder):
    size = F.col("o_custkey")
    detail = F.to_json(
        F.struct(
            (size * 100).alias("rows"),
            (size * 10).alias("totalMs"),
            F.when(F.col("o_orderstatus") != "P", size * 3).alias("convertMs"),
            F.when(F.col("o_orderpriority") != "5-LOW", size * 5).alias("insertMs"),
        )
    )
    events = frames.table(spark, folder, "orders").select(F.col("o_orderkey").alias("upload_id"), detail.alias("detail"))
    return g.load_perf(events)


@registry.query(
    "resolve_tables",
    f"""{_with(frames.CATALOG_TABLES_SQL)} SELECT table_name, count(DISTINCT dataset_id) AS datasets, min(dataset_id) AS first_dataset,
 count(DISTINCT dataset_id) > 1 AS ambiguous FROM tables GROUP BY table_name""",
)
def resolve_tables(spark, folder):
    return resolve(frames.catalog_tables(spark, folder))


@registry.query(
    "cascade_drop",
    f"""{_with(frames.CATALOG_TABLES_SQL, frames.DATASETS_SQL)} SELECT table_id, table_name, dataset_id FROM tables WHERE dataset_id NOT IN
 (SELECT dataset_id FROM datasets WHERE project_id <= 1)""",
)
def cascade_drop(spark, folder):
    """Dropping two projects drops their datasets and with them their tables."""
    dropped = frames.datasets(spark, folder).where("project_id <= 1")
    return g.cascade_drop(frames.catalog_tables(spark, folder), dropped, "dataset_id").select(
        "table_id", "table_name", "dataset_id"
    )
