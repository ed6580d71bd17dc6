"""Ranking, governance, reconciliation, export and streaming against brute force and by invariants."""

import datetime
import glob
import random
import re

import pytest
from pyspark.sql import functions as F

from tabloom.operators import export, governance, load, ranking, reconcile
from tabloom.streaming import ingest

START = datetime.datetime(2024, 1, 1)


def test_sliding_rate_against_brute_force(spark):
    """One principal makes a third of all requests, many within one minute, some in the same instant."""
    draw = random.Random(3)
    calls = [
        (draw.choice([0, 0, draw.randrange(1, 9)]), START + datetime.timedelta(milliseconds=draw.randrange(0, 400_000, 500)))
        for _ in range(600)
    ]
    out = ranking.sliding_rate(spark.createDataFrame(calls, "p int, at timestamp_ntz"), "p", "at", limit=10).collect()
    minute = datetime.timedelta(seconds=60)
    for row in out:
        used = sum(1 for p, at in calls if p == row.p and row.moment - minute < at <= row.moment)
        assert (row.used, row.over_limit, row.remaining) == (used, used > 10, max(0, 10 - used))
    assert len(out) == len(set(calls)) and sum(r.requests for r in out) == len(calls)


@pytest.mark.parametrize("limit, spread", [(3, 400_000), (10, 400_000), (5, 4_000_000), (1, 50_000)])
def test_admissions_against_a_limiter(spark, limit, spread):
    """A principal without a name makes a third of the requests; some stand in the same instant or exactly a minute apart."""
    draw = random.Random(limit)
    calls = [
        (draw.choice([None, None, draw.randrange(1, 9)]), START + datetime.timedelta(milliseconds=draw.randrange(0, spread, 500)))
        for _ in range(600)
    ]
    found = ranking.admissions(spark.createDataFrame([*calls, (1, None)], "p long, at timestamp_ntz"), "p", "at", limit).collect()
    passed, wanted = {}, {}
    for p, at in sorted(calls, key=lambda call: call[1]):
        before = [t for t in passed.get(p, []) if t > at - datetime.timedelta(seconds=60)]
        passes = len(before) < limit
        passed[p] = [*before, at] if passes else before
        n, admitted = wanted.get((p, at), (0, 0))
        wanted[p, at] = (n + 1, admitted + passes)
    assert {(r.p, r.moment): (r.requests, r.admitted) for r in found} == wanted
    assert len(found) == len(wanted) and all(r.refused == r.requests - r.admitted for r in found)


def test_rates_read_a_window_once(spark, capsys):
    """Frames that slide are summed up anew at each instant: their cost grows with the square of what a window holds."""
    calls = spark.createDataFrame([("a", START + datetime.timedelta(milliseconds=i)) for i in range(500)], "p string, at timestamp_ntz")
    for rows in (ranking.sliding_rate(calls, "p", "at"), ranking.admissions(calls, "p", "at")):
        rows.explain("simple")
        plan = capsys.readouterr().out
        assert "RangeFrame" in plan and not re.search(r"RangeFrame, (?!unboundedpreceding)|RangeFrame, \w+\$\(\), (?!currentrow)", plan)
    assert [r.used for r in ranking.sliding_rate(calls, "p", "at").orderBy("moment").collect()] == [*range(1, 501)]


def test_admissions_of_nothing_and_of_calm(spark):
    none = spark.createDataFrame([], "p string, at timestamp_ntz")
    assert ranking.admissions(none, "p", "at").collect() == []
    calm = spark.createDataFrame([("a", START), ("a", START + datetime.timedelta(seconds=30))], "p string, at timestamp_ntz")
    assert [(r.requests, r.admitted, r.refused) for r in ranking.admissions(calm, "p", "at", 2).collect()] == [(1, 1, 0)] * 2
    with pytest.raises(ValueError):
        ranking.admissions(calm, "p", "at", 0)


def test_keep_newest_limits_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 as g", "id as at")
    kept = ranking.keep_newest(df, "g", ["at"], 10)
    assert kept.count() == 30
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_pages(spark):
    df = spark.range(10)
    assert [r.id for r in ranking.page(df, 3, 4, ["id"]).collect()] == [4, 5, 6]
    with pytest.raises(ValueError):
        ranking.page(df, 3, 4)
    with pytest.raises(ValueError):
        ranking.page(df, 10_001)
    assert [r.truncated for r in ranking.page_with_flag(df, 4, ["id"]).collect()] == [True] * 4
    assert {r.truncated for r in ranking.page_with_flag(df, 10, ["id"]).collect()} == {False}
    with pytest.raises(ValueError):
        ranking.feed_page(df, ["id"], select=["none"])
    assert [r.id for r in ranking.iterate_rows(df)] == list(range(10))


@pytest.mark.parametrize("rows", [3000, 40])
def test_far_pages(spark, monkeypatch, rows):
    """Pages far into a result, with NULL and ties in the order, against a sorted list."""
    monkeypatch.setattr(ranking, "NEAR_ROWS", 20)
    monkeypatch.setattr(ranking, "RANGES", 6)
    df = spark.range(rows).selectExpr("if(id % 3 = 0, null, id % 17) as g", "id", "timestamp_ntz '2024-01-01' + make_interval(0,0,0,0,0,0,id % 5) as at")
    df = df.repartition(5)
    for order in (["g", "id"], ["at", "id"], ["g"]):
        every = sorted(df.collect(), key=lambda r: [(r[c] is not None, r[c]) for c in order])
        for offset in (0, 19, 21, rows // 2, rows - 4, rows + 5):
            found = ranking.page(df, 10, offset, order).collect()
            assert [[r[c] for c in order] for r in found] == [[r[c] for c in order] for r in every[offset : offset + 10]]
    flagged = ranking.page_with_flag(df, 10, ["g", "id"], rows - 10).collect()
    assert len(flagged) == 10 and not any(r.truncated for r in flagged)


def test_far_pages_leave_rows_before_them_alone(spark, monkeypatch):
    monkeypatch.setattr(ranking, "NEAR_ROWS", 1000)
    plan = ranking.page(spark.range(50_000), 10, 40_000, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert max(int(n) for n in re.findall(r"limit=(\d+)", plan)) <= 1010


def test_continued_pages(spark):
    df = spark.range(25).selectExpr("if(id < 4, null, id div 2) as g", "id").repartition(3)
    seen, after = [], None
    while True:
        rows = ranking.page_after(df, 5, ["g", "id"], after)
        seen += [r.id for r in rows.collect()]
        after = ranking.continuation(rows, 5, ["g", "id"])
        if after is None:
            break
    assert seen == list(range(25))
    feed = ranking.feed_page(df, ["g", "id"], 5, 5, after=(2, 4)).collect()
    assert [(r["id"], r["_row_number"]) for r in feed] == [("5", 6), ("6", 7), ("7", 8), ("8", 9), ("9", 10)]


def test_orphans_and_durations_by_type(spark):
    jobs = spark.createDataFrame(
        [("REFRESH", "RUNNING", '{"k": 1}', 0, 0), ("OTHER", "RUNNING", '{"k": 2}', 0, 0), ("REFRESH", "COMPLETED", "{}", 0, 3),
         ("REFRESH", "COMPLETED", "{}", 0, 4), ("OTHER", "COMPLETED", "{}", 0, 90)],
        "type string, status string, payload string, a int, b int",
    ).selectExpr("type", "status", "payload", *[f"timestamp_ntz '2024-01-01' + make_interval(0,0,0,0,0,0,{c}) as {n}"
                                                for c, n in (("a", "locked_at"), ("b", "updated_at"))])
    parents = spark.createDataFrame([(1, "running"), (2, "running"), (3, "completed")], "id int, last_status string")
    assert [r.id for r in governance.without_active_job(parents, jobs, "id", "k", "REFRESH").collect()] == [2]
    now = F.lit("2024-01-02").cast("timestamp_ntz")
    assert governance.average_load_seconds(jobs, now, "REFRESH").first().avg_seconds == 4


def test_access(spark):
    grants = spark.createDataFrame(
        [(1, "GLOBAL", None, "READ"), (1, "DATASET", 5, "ADMIN"), (2, "PROJECT", 1, "WRITE"), (3, "DATASET", 6, "READ")],
        "principal bigint, scope_type string, scope_id bigint, permission string",
    )
    datasets = spark.createDataFrame([(5, 1), (6, 2)], "dataset_id bigint, project_id bigint")
    asked = spark.createDataFrame(
        [(p, d) for p in (1, 2, 3, 4) for d in (5, 6, 9)] * 2, "principal bigint, dataset_id bigint"
    )
    out = {(r.principal, r.dataset_id): r.permission for r in governance.check_access(asked, grants, datasets).collect()}
    assert out == {
        (1, 5): "ADMIN", (1, 6): "READ", (1, 9): "READ", (2, 5): "WRITE", (2, 6): None, (2, 9): None,
        (3, 5): None, (3, 6): "READ", (3, 9): None, (4, 5): None, (4, 6): None, (4, 9): None,
    }
    seen = {tuple(r) for r in governance.visible_datasets(grants, datasets).collect()}
    assert seen == {(1, None), (2, 5), (3, 6)}


def test_retry_delay(spark):
    df = spark.range(7).select(governance.retry_delay(F.col("id")).alias("d"))
    assert [r.d for r in df.collect()] == [0, 30, 60, 90, 120, 120, 120]


@pytest.mark.parametrize("digits", [1, 2, 6])
def test_fingerprint_ignores_order_and_sees_changes(spark, table, digits):
    orders = table("orders")
    one = reconcile.table_fingerprint(orders, digits).first()
    assert one.row_count == orders.count()
    assert reconcile.table_fingerprint(orders.repartition(7, "o_custkey"), digits).first() == one
    changed = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 3, 0).otherwise(F.col("o_totalprice")))
    assert reconcile.table_fingerprint(changed, digits).first().fingerprint != one.fingerprint
    twice = reconcile.table_fingerprint(orders.unionByName(orders.where("o_orderkey = 3")), digits).first()
    assert twice.row_count == one.row_count + 1 and twice.fingerprint != one.fingerprint


def test_leaf_digits():
    assert [reconcile.leaf_digits(n) for n in (0, 65_536, 65_537, 2**20, 2**21, 10**12)] == [1, 1, 1, 1, 2, 6]


def test_compare_tells_bars_empty_texts_and_null_apart(spark):
    def of(*row):
        return spark.createDataFrame([row], "a string, b string")

    same = {"bar": (of("a|b", "c"), of("a", "b|c")), "empty": (of("", "c"), of(None, "c")), "null": (of(None, "c"), of(None, "c"))}
    assert {r.table_name: r.equal for r in reconcile.compare_tables(same).collect()} == {"bar": False, "empty": False, "null": True}
    nothing = of("a", "b").limit(0)
    assert reconcile.fingerprint_sums(nothing).first() == (0, "0", "0")


def test_compare_counts_repeats(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    b = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    out = {r.table_name: r.equal for r in reconcile.compare_tables({"same": (a, a), "other": (a, b)}).collect()}
    assert out == {"same": True, "other": False}


def test_export_file(spark, folder, text_rows):
    df = text_rows(["a", "b"], [("1", 'x;"y"'), ("2", None), ("3", "1970-01-01T08:30:00.000Z")])
    export.write_lines(export.export_csv(df), f"{folder}/out", header="a;b")
    whole = b"".join(open(p, "rb").read() for p in sorted(glob.glob(f"{folder}/out/part-*")))
    assert whole.decode("utf-8") == '﻿a;b\r\n1;"x;""y"""\r\n2;\r\n3;08:30:00\r\n'


def test_ndjson_file(spark, folder, text_rows):
    export.write_ndjson(text_rows(["a"], [("1",), ("2",)]), f"{folder}/out")
    lines = [line for p in sorted(glob.glob(f"{folder}/out/part-*")) for line in open(p).read().splitlines()]
    assert lines[0] == '{"columns":["a"]}' and lines[-1] == '{"rowCount":2}' and sorted(lines[1:-1]) == ['{"a":"1"}', '{"a":"2"}']


def test_stream_upsert_survives_a_rerun(spark, folder, table):
    """Two runs over arriving files, the second without a checkpoint of its own batch: the outcome is the batch result."""
    events = table("events")
    half = events.where("event_id < 500"), events.where("event_id >= 500")
    half[0].write.parquet(f"{folder}/in")
    rows = ingest.arriving(spark, f"{folder}/in", events.schema, files_per_batch=1)
    order = ["ts", "event_id"]

    def run():
        ingest.stream_upsert(rows, "user_id", order, f"{folder}/out", f"{folder}/check").awaitTermination()

    run()
    half[1].write.mode("append").parquet(f"{folder}/in")
    run()
    run()  # nothing new
    out = f"{folder}/out"

    def current():
        return sorted(ingest.upserted(spark, out, events.schema, "user_id", order).collect())

    whole = sorted(load.latest_per_key(events, "user_id", order).collect())
    assert current() == whole
    ingest.compact(spark, out, events.schema, "user_id", order)
    assert current() == whole
    later = events.where("event_id < 9").withColumn("ts", F.lit("2090-01-01").cast("timestamp_ntz"))
    later.write.mode("append").parquet(f"{folder}/in")
    run()
    whole = sorted(load.latest_per_key(events.unionByName(later), "user_id", order).collect())
    assert current() == whole
    ingest.compact(spark, out, events.schema, "user_id", order, drop=True)  # the second base reads the first
    assert current() == whole
    assert [int(p.split("=")[1]) for p in glob.glob(f"{out}/_bases/upto=*")] and len(glob.glob(f"{out}/batch_id=*")) == 1


def test_stream_append(spark, folder, table):
    events = table("events")
    events.write.parquet(f"{folder}/in")
    rows = ingest.arriving(spark, f"{folder}/in", events.schema)
    for _ in range(2):
        ingest.stream_append(rows, f"{folder}/out", f"{folder}/check").awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == events.count()


def test_many_newest_of_a_large_group(spark):
    df = spark.range(0, 9000, numPartitions=6).selectExpr("if(id % 3 = 0, 0, id) as g", "id as at")
    kept = ranking.keep_newest(df, "g", ["at"], 1500)
    counts = {r.g: r["count"] for r in kept.groupBy("g").count().where("g = 0 or g = 1").collect()}
    assert counts == {0: 1500, 1: 1}
    assert kept.where("g = 0").agg(F.min("at")).first()[0] == 3 * 1500


def test_filters_reach_the_scan(spark, table):
    """Retention, incremental pulls, ranges, cursors and live views filter in the file reader and read few columns."""
    from tabloom.plans.scoped_sql import run_query
    from tabloom.sources import external

    events, orders = table("events"), table("orders")
    now = F.lit("2024-01-20").cast("timestamp_ntz")
    cases = [
        (governance.retained(events, "ts", now, 7).select("event_id"), "GreaterThanOrEqual(ts,2024-01-13", 2),
        (external.newer_than(orders, "o_orderdate", "1998-06-01").select("o_orderkey"), "GreaterThan(o_orderdate", 2),
        (ranking.cursor_page(events, "ts", "event_id", ("2024-01-15", 5)).select("event_id"), "LessThan(ts", 2),
        (
            run_query(spark, "SELECT sum(o_totalprice) FROM orders WHERE o_custkey > 5", {"a": {"orders": orders}}),
            "GreaterThan(o_custkey,5)",
            2,
        ),
    ]
    for df, pushed, columns in cases:
        plan = df._jdf.queryExecution().executedPlan().toString()
        scan = next(line for line in plan.splitlines() if "FileScan" in line)
        assert pushed in scan.split("PushedFilters:")[1]
        assert scan.split("FileScan parquet [")[1].split("]")[0].count(",") == columns - 1


def test_plans_have_no_cross_join(spark):
    """Nor a nested loop, in any registered query that only builds a plan."""
    from conftest import SF
    from tabloom.checks import aggregates, governance as governed

    for module in (aggregates, governed):
        for name, build in module.registry.queries.items():
            plan = build(spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
