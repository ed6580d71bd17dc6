"""Grants, retention, freshness, job and source states over the hub's own tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.moments import unix_micros
from tabloom.operators.ranking import keep_newest
from tabloom.operators.skew import keep_by_key, look_up

# States, permission order, ages and batch sizes.
PERMISSION_RANK = {"READ": 1, "WRITE": 2, "ADMIN": 3}
FINISHED = ("COMPLETED", "FAILED")
FINISHED_UPLOADS = ("COMPLETED", "FAILED", "CANCELLED")
WAITING_UPLOADS = ("PENDING_UPLOAD", "QUEUED_PREVIEW", "AWAITING_CONFIRMATION")
ACTIVE_UPLOADS = ("PREVIEWING", "QUEUED_IMPORT", "IMPORTING", "RETRYING")
ACTIVE_JOBS = ("QUEUED", "RUNNING")
RETENTION_DAYS = 30
STALE_HOURS = 24
IMPORT_HEARTBEAT_SECONDS = 90 * 60
HEARTBEAT_SECONDS = 120
RETRY_STEP_SECONDS = 30
RETRY_CAP_SECONDS = 120
DUE_BATCH = 20
FUNNEL_FLOOR = 20
REFRESH_SLOTS = 180  # minutes from 04:00 to 06:59
FIRST_REFRESH_HOUR = 4


def seconds_between(start: Column, end: Column) -> Column:
    return F.floor((unix_micros(end) - unix_micros(start)) / 1_000_000)


def older_than(moment: Column, now: Column, seconds: int) -> Column:
    """Compared as the column stands, so that the filter can reach the scan."""
    return moment < F.timestamp_add("SECOND", F.lit(-seconds), now)


def within(moment: Column, now: Column, seconds: int) -> Column:
    return moment >= F.timestamp_add("SECOND", F.lit(-seconds), now)


def _rank(permission: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in PERMISSION_RANK.items() for x in pair])
    return F.try_element_at(ranks, permission)


def check_access(requests: DataFrame, grants: DataFrame, datasets: DataFrame) -> DataFrame:
    """The strongest permission each principal has on each dataset it asked for, NULL when none.

    ``requests``: principal, dataset_id.  ``grants``: principal, scope_type, scope_id, permission.  ``datasets``:
    dataset_id, project_id.  Repeats are collapsed on both sides first; a request is then looked up under its three
    scopes by key, so no grant is multiplied by the datasets it covers.
    """
    asked = requests.groupBy("principal", "dataset_id").agg(F.count(F.lit(1)).alias("requests"))
    held = grants.groupBy("principal", "scope_type", F.coalesce("scope_id", F.lit(-1)).alias("scope_id")).agg(
        F.max(_rank(F.col("permission"))).alias("rank")
    )
    located = asked.join(datasets.select("dataset_id", "project_id"), "dataset_id", "left")
    scopes = located.withColumn(
        "scope",
        F.explode(
            F.array(
                F.struct(F.lit("GLOBAL").alias("scope_type"), F.lit(-1).cast("bigint").alias("scope_id")),
                F.struct(F.lit("PROJECT").alias("scope_type"), F.col("project_id").cast("bigint").alias("scope_id")),
                F.struct(F.lit("DATASET").alias("scope_type"), F.col("dataset_id").cast("bigint").alias("scope_id")),
            )
        ),
    ).select("principal", "dataset_id", "requests", "scope.*")
    names = F.create_map(*[F.lit(x) for name, rank in PERMISSION_RANK.items() for x in (rank, name)])
    return (
        scopes.join(held, ["principal", "scope_type", "scope_id"], "left")
        .groupBy("principal", "dataset_id", "requests")
        .agg(F.max("rank").alias("rank"))
        .select("principal", "dataset_id", "requests", F.try_element_at(names, F.col("rank")).alias("permission"))
    )


def visible_datasets(grants: DataFrame, datasets: DataFrame) -> DataFrame:
    """Datasets each principal can see.  A principal that sees all of them has one row, with NULL as dataset."""
    scoped = grants.select("principal", "scope_type", "scope_id").distinct()
    everything = scoped.where("scope_type = 'GLOBAL'").select("principal").distinct()
    limited = keep_by_key(scoped, everything, ["principal"], present=False, unique=True)
    direct = limited.where("scope_type = 'DATASET'").select("principal", F.col("scope_id").alias("dataset_id"))
    by_project = (
        limited.where("scope_type = 'PROJECT'")
        .join(datasets.select("dataset_id", F.col("project_id").alias("scope_id")), "scope_id")
        .select("principal", "dataset_id")
    )
    nothing = F.lit(None).cast("bigint").alias("dataset_id")
    return direct.unionByName(by_project).distinct().unionByName(everything.select("principal", nothing))


def expired(moment: Column, now: Column, days: int = RETENTION_DAYS) -> Column:
    return older_than(moment, now, days * 86_400)


def retained(
    df: DataFrame, moment: str, now: Column, days: int = RETENTION_DAYS, states: tuple[str, ...] | None = None
) -> DataFrame:
    """Rows that survive the retention purge: young ones, and those that are not in a finished state."""
    stays = within(F.col(moment), now, days * 86_400) | F.col(moment).isNull()
    if states is not None:
        stays = stays | ~F.col("status").isin(*states) | F.col("status").isNull()
    return df.where(stays)


def retention_counts(
    jobs: DataFrame, audit: DataFrame, uploads: DataFrame, versions: DataFrame, now: Column, keep: int = 10
) -> DataFrame:
    """How many rows a purge removes from the job, audit, upload and version tables."""
    gone = expired(F.col("created_at"), now)
    deleted = F.count(F.lit(1)).alias("deleted")
    old_jobs = jobs.where(gone & F.col("status").isin(*FINISHED)).agg(deleted)
    old_audit = audit.where(gone).agg(deleted)
    old_uploads = uploads.where(gone & F.col("status").isin(*FINISHED_UPLOADS)).agg(deleted)
    per_table = versions.groupBy("table_id").agg(F.count(F.lit(1)).alias("n"))
    old_versions = per_table.agg(F.coalesce(F.sum(F.greatest(F.col("n") - keep, F.lit(0))), F.lit(0)).alias("deleted"))
    return (
        old_jobs.withColumn("kind", F.lit("jobs"))
        .unionByName(old_audit.withColumn("kind", F.lit("audit_events")))
        .unionByName(old_uploads.withColumn("kind", F.lit("uploads")))
        .unionByName(old_versions.withColumn("kind", F.lit("versions")))
        .select("kind", "deleted")
    )


def versions_kept(versions: DataFrame, keep: int = 10) -> DataFrame:
    """The newest versions of each table."""
    return keep_newest(versions, "table_id", ["created_at", "version_id"], keep)


def is_stale(last_data_at: Column, now: Column) -> Column:
    """Never loaded, or not within a day."""
    return last_data_at.isNull() | older_than(last_data_at, now, STALE_HOURS * 3600)


def stale_tables(projects: DataFrame, datasets: DataFrame, tables: DataFrame, now: Column) -> DataFrame:
    """Per project: its datasets, its tables, and how many tables are stale.

    Tables are counted per dataset before anything is joined.
    """
    per_dataset = tables.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("tables"), F.count_if(is_stale(F.col("last_data_at"), now)).alias("stale")
    )
    per_project = (
        datasets.join(per_dataset, "dataset_id", "left")
        .groupBy("project_id")
        .agg(
            F.count(F.lit(1)).alias("dataset_count"),
            F.sum(F.coalesce("tables", F.lit(0))).alias("table_count"),
            F.sum(F.coalesce("stale", F.lit(0))).alias("stale_count"),
        )
    )
    return projects.join(per_project, "project_id", "left").select(
        "project_id",
        "project_name",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("dataset_count", "table_count", "stale_count")],
    )


def due_refreshes(sources: DataFrame, now: Column, batch: int = DUE_BATCH) -> DataFrame:
    """The next sources to refresh: active extracts with a schedule whose time has come, longest due first."""
    due = sources.where(
        F.col("active") & (F.col("mode") == "extract") & F.col("refresh_cron").isNotNull()
        & (F.col("next_refresh_at") <= now)
    )
    return due.orderBy("next_refresh_at", "source_id").limit(batch)


def retry_delay(attempts: Column) -> Column:
    """Seconds until a failed job is tried again."""
    return F.least(attempts * RETRY_STEP_SECONDS, F.lit(RETRY_CAP_SECONDS))


def stale_runs(jobs: DataFrame, now: Column, import_type: str = "IMPORT_UPLOAD") -> DataFrame:
    """Running jobs whose heartbeat stopped, and whether they fail or are queued again."""
    silent = F.when(
        F.col("type") == import_type, older_than(F.col("heartbeat_at"), now, IMPORT_HEARTBEAT_SECONDS)
    ).otherwise(older_than(F.col("heartbeat_at"), now, HEARTBEAT_SECONDS))
    spent = F.col("attempts") >= F.col("max_attempts")
    return jobs.where((F.col("status") == "RUNNING") & silent).select(
        "job_id",
        "type",
        "attempts",
        F.when(spent, "FAILED").otherwise("QUEUED").alias("next_status"),
        F.when(~spent, retry_delay(F.col("attempts"))).cast("bigint").alias("retry_delay"),
    )


def json_key(payload: Column, key: str) -> Column:
    return F.get_json_object(payload, f"$.{key}")


def without_active_job(
    parents: DataFrame, jobs: DataFrame, parent_key: str, payload_key: str, job_type: str
) -> DataFrame:
    """Parents marked as running that no queued or running job of their type refers to in its payload.

    Payloads of other types may hold an equal key that means something else.
    """
    active = jobs.where(F.col("status").isin(*ACTIVE_JOBS) & (F.col("type") == job_type)).select(
        json_key(F.col("payload"), payload_key).alias("parent_text")
    )
    running = parents.where("last_status = 'running'").withColumn("parent_text", F.col(parent_key).cast("string"))
    return keep_by_key(running, active, ["parent_text"], present=False).drop("parent_text")


def stuck_imports(uploads: DataFrame, jobs: DataFrame) -> DataFrame:
    """Uploads marked as importing whose jobs have all failed, or that have none."""
    alive = jobs.where(F.col("status").isin(*ACTIVE_JOBS, "COMPLETED")).select("upload_id")
    return keep_by_key(uploads.where("status = 'IMPORTING'"), alive, ["upload_id"], present=False)


def inactive_with_table(sources: DataFrame) -> DataFrame:
    """Inactive sources that still own a table."""
    return sources.where(~F.col("active") & F.col("target_table_id").isNotNull())


def job_kpis(jobs: DataFrame, now: Column) -> DataFrame:
    """Per job type: how many run, wait, and finished or failed within a day."""
    status, recent = F.col("status"), within(F.col("created_at"), now, 86_400)
    return jobs.groupBy("type").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "RUNNING").alias("running"),
        F.count_if(status == "QUEUED").alias("queued"),
        F.count_if((status == "COMPLETED") & recent).alias("completed_today"),
        F.count_if((status == "FAILED") & recent).alias("failed_today"),
    )


def average_load_seconds(jobs: DataFrame, now: Column, job_type: str, days: int = 7) -> DataFrame:
    """Mean duration, in whole seconds, of the completed jobs of a type in the last days."""
    recent = jobs.where(
        (F.col("status") == "COMPLETED") & (F.col("type") == job_type) & F.col("locked_at").isNotNull()
        & within(F.col("updated_at"), now, days * 86_400)
    )
    micros = unix_micros(F.col("updated_at")) - unix_micros(F.col("locked_at"))
    return recent.agg(F.round(F.avg(micros) / 1_000_000).cast("bigint").alias("avg_seconds"))


def enrich_jobs(jobs: DataFrame, sources: DataFrame, payload_key: str) -> DataFrame:
    """Jobs with the name of the source their payload refers to; many jobs may refer to one source, or to none."""
    named = sources.select(F.col("source_id").cast("string").alias("source_ref"), "source_name")
    return look_up(jobs.withColumn("source_ref", json_key(F.col("payload"), payload_key)), named, ["source_ref"])


def status_funnel(uploads: DataFrame) -> DataFrame:
    """Uploads by stage, with the width each stage is drawn at: its share in percent, never below the floor."""
    status = F.col("status")
    stage = (
        F.when(status.isin(*WAITING_UPLOADS), "waiting")
        .when(status.isin(*ACTIVE_UPLOADS), "active")
        .when(status == "COMPLETED", "completed")
        .otherwise("failed")
    )
    stages = uploads.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # four rows
    share = F.floor(F.col("n") * 100.0 / total + 0.5)
    return stages.select("stage", "n", F.greatest(share, F.lit(FUNNEL_FLOOR)).cast("bigint").alias("width"))


def refresh_spread(sources: DataFrame) -> DataFrame:
    """A stable daily refresh time for each source, spread over the early morning by a hash of its id."""
    digest = F.conv(F.substring(F.md5(F.col("source_id").cast("string")), 1, 8), 16, 10).cast("bigint")
    slot = digest % REFRESH_SLOTS
    hour = F.floor(slot / 60) + FIRST_REFRESH_HOUR
    cron = F.concat_ws(" ", (slot % 60).cast("string"), hour.cast("string"), F.lit("* * *"))
    return sources.select("source_id", slot.alias("slot"), cron.alias("refresh_cron"))


def assign_groups(sources: DataFrame) -> DataFrame:
    """One group id for all ungrouped table sources that share dataset, connection and schema."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("dataset_id", "connection_id", "source_schema")]
    ungrouped = F.col("group_id").isNull() & (F.col("source_kind") == "table")
    return sources.withColumn(
        "group_id", F.when(ungrouped, F.md5(F.concat_ws("|", *parts))).otherwise(F.col("group_id"))
    )


def unconnected_tables(listing: DataFrame, sources: DataFrame, search: str | None = None) -> DataFrame:
    """Tables of a source that no connection reads yet, optionally those whose name contains a text."""
    left = keep_by_key(listing, sources, ["source_schema", "source_table"], present=False)
    return left if not search else left.where(F.lower("source_table").contains(search.lower()))


def table_origin(tables: DataFrame, sources: DataFrame, derived: DataFrame) -> DataFrame:
    """Where each table comes from: a source, a derived query, or an upload."""
    from_source = sources.select("table_id").dropna().distinct().withColumn("has_source", F.lit(True))
    from_query = derived.select("table_id").dropna().distinct().withColumn("has_query", F.lit(True))
    return (
        tables.join(from_source, "table_id", "left")
        .join(from_query, "table_id", "left")
        .withColumn(
            "origin", F.when(F.col("has_source"), "source").when(F.col("has_query"), "derived").otherwise("upload")
        )
        .drop("has_source", "has_query")
    )


def repair_counts(uploads: DataFrame) -> DataFrame:
    """Row counts recorded as zero, taken from the preview where it knows better."""
    from_preview = json_key(F.col("preview"), "rowCount").try_cast("bigint")
    known = F.when(from_preview > 0, from_preview)
    return uploads.withColumn(
        "row_count", F.when(F.col("row_count") == 0, F.coalesce(known, F.col("row_count"))).otherwise(F.col("row_count"))
    )


def load_perf(events: DataFrame) -> DataFrame:
    """Rows per second and the time split of each load, from the JSON detail of its performance event."""
    fields = "rows bigint, totalMs double, convertMs double, insertMs double"
    detail = events.withColumn("d", F.from_json("detail", fields))
    rows, total = F.col("d.rows"), F.col("d.totalMs")
    convert_ms, insert_ms = (F.coalesce(F.col(f"d.{c}"), F.lit(0.0)) for c in ("convertMs", "insertMs"))
    return detail.select(
        *[c for c in events.columns if c != "detail"],
        rows.alias("rows"),
        (total / 1000).alias("total_seconds"),
        (convert_ms / 1000).alias("convert_seconds"),
        (insert_ms / 1000).alias("insert_seconds"),
        (F.greatest(total - convert_ms - insert_ms, F.lit(0.0)) / 1000).alias("rest_seconds"),
        F.when(insert_ms > 0, F.round(rows / (insert_ms / 1000), 0)).alias("rows_per_second"),
    )


def cascade_drop(catalog: DataFrame, dropped: DataFrame, level: str) -> DataFrame:
    """Catalog rows that remain when projects, datasets or tables are dropped; ``level`` is their key column."""
    return keep_by_key(catalog, dropped, [level], present=False)
