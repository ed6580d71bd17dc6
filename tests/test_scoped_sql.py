"""Scopes that do not leak: threads, the user's own views and functions."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from tabloom.plans.scoped_sql import ReadOnlyError, run_query


def test_threads_see_their_own_scope(spark):
    scopes = [{"d": {"t": spark.range(n, n + 1)}} for n in range(2)]

    def ask(i):
        return run_query(spark, "WITH x AS (SELECT id FROM t) SELECT id FROM x JOIN d__t USING (id)", scopes[i % 2]).first().id == i % 2

    with ThreadPoolExecutor(4) as pool:
        assert all(pool.map(ask, range(200)))


def test_views_and_settings_of_the_user_are_left_alone(spark):
    spark.range(5).createOrReplaceTempView("t2")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        found = run_query(spark, "SELECT count(*) AS n, current_timezone() AS z FROM t2", {"d": {"t2": spark.range(3)}})
        assert tuple(found.first()) == (3, "Asia/Tokyo") and spark.table("t2").count() == 5
        joined = found.join(spark.table("t2"), spark.table("t2")["id"] == found["n"])
        assert joined.count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.catalog.dropTempView("t2")


@pytest.mark.parametrize(
    "sql", ["SELECT peek(id) FROM t", "SELECT id FROM t WHERE id = (SELECT max(peek(id)) FROM t)", "SELECT default.peek(id) FROM t",
            "SELECT java_method('java.lang.System', 'exit', 1) FROM t", "SELECT * FROM peek_all(1)"]
)
def test_functions_of_the_user_are_refused(spark, sql):
    spark.udf.register("peek", lambda x: open("/etc/hostname").read())
    with pytest.raises(ReadOnlyError):
        run_query(spark, sql, {"d": {"t": spark.range(2)}})


def test_built_in_functions_run(spark):
    sql = "SELECT sum(x) AS s, max(upper('a')) AS u, count(*) FILTER (WHERE x > 1) AS n FROM t, LATERAL explode(sequence(1, id)) AS e(x)"
    scope = {"d": {"t": spark.range(1, 4)}}
    assert tuple(run_query(spark, sql, scope).first()) == (10, "A", 3)
    assert run_query(spark, "SELECT cast(id AS string) AS s, row_number() OVER (ORDER BY id) AS r FROM t WHERE id IN (1, 2)", scope).count() == 2
    assert run_query(spark, "SELECT * FROM range(4) r JOIN t ON r.id = t.id", scope).count() == 3
