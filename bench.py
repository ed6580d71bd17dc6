"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The text operators read delimited files, as they do in use: the line items are written as such files before the clock
starts.  Each query runs twice and its better time counts; ``rates`` are rows per second of those times.
"""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from tabloom.checks import frames, load_registry  # noqa: E402
from tabloom.checks.loads import ORDERS_MAPPING  # noqa: E402
from tabloom.functions.hashing import row_hash  # noqa: E402
from tabloom.operators import load, profile  # noqa: E402
from tabloom.operators.mapping import apply_mapping  # noqa: E402
from tabloom.session import RECOMMENDED_CONF, fresh_path, materialize  # noqa: E402
from tabloom.sources import delimited  # noqa: E402
from tabloom.sources.store import TableStore  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REGISTERED = (
    "agg_sum_total", "agg_by_category", "agg_range_filter", "agg_by_date", "agg_two_keys", "agg_count_distinct",
    "sql_join_inner", "sql_cte", "versions_keep_n", "latest_per_key", "sliding_rate", "effective_grants",
    "table_fingerprint", "table_fingerprint_scalable",
)


def session() -> SparkSession:
    builder = SparkSession.builder.master(f"local[{CPUS}]").appName("tabloom-bench")
    settings = {
        **RECOMMENDED_CONF,
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": CPUS,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    registry = load_registry()

    path = fresh_path(spark, "bench-file")
    text = frames.text_table(spark, FOLDER, "lineitem").repartition(2 * int(CPUS))
    text.write.option("sep", ";").option("header", True).csv(path)
    raw = delimited.read_delimited(spark, path, separator=";", encoding="UTF-8")
    mapping = profile.infer_mapping(raw)
    orders = frames.table(spark, FOLDER, "orders").repartition(int(CPUS))
    target_text = materialize(orders.select(*frames.text_columns(orders)), "bench-target")
    changed = frames.orders_file(spark, FOLDER).repartition(int(CPUS))
    file_text = materialize(changed.select(*frames.text_columns(changed)), "bench-file")
    target = materialize(apply_mapping(target_text, ORDERS_MAPPING, with_hash=True), "bench-target")
    incoming = materialize(apply_mapping(file_text, ORDERS_MAPPING, with_hash=True), "bench-incoming")
    rows = {"lineitem": raw.count(), "orders": target.count()}

    def loaded(mode: str) -> float:
        """A whole load from text: convert, hash, compare, write, verify, publish."""
        store = TableStore(spark, fresh_path(spark, "bench-store"))
        store.publish("orders", target, "replace", "first")
        began = time.time()
        store.load("orders", file_text, ORDERS_MAPPING, mode, "second", key="o_orderkey")
        return time.time() - began

    work = {
        "column_stats": (lambda: profile.column_stats(raw).collect(), "lineitem"),
        "apply_mapping": (lambda: drain(apply_mapping(raw, mapping)), "lineitem"),
        "row_hash": (lambda: drain(target_text.select(row_hash([target_text[c] for c in target_text.columns]))), "orders"),
        "delta_replace": (lambda: drain(load.delta_replace(target, incoming)), "orders"),
        "upsert": (lambda: drain(load.upsert(target, incoming, "o_orderkey")), "orders"),
        "load_delta_replace": (lambda: loaded("replace"), "orders"),
        "load_upsert": (lambda: loaded("upsert"), "orders"),
    }
    for name in REGISTERED:
        work[name] = (lambda build=registry.queries[name]: drain(build(spark, FOLDER)), None)

    seconds, rates = {}, {}
    for name, (run, table) in work.items():
        times = []
        for _ in range(2):
            began = time.time()
            own = run()
            times.append(own if isinstance(own, float) else time.time() - began)
        seconds[name] = round(min(times), 3)
        if table:
            rates[name] = round(rows[table] / min(times))
    print(
        json.dumps(
            {
                "metric": "total seconds of all queries, better of two runs each",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rates": rates,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
