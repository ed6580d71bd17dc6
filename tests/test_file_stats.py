import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from tabloom.operators.reconcile import fingerprint_sums
from tabloom.sources import file_stats
from tabloom.sources.store import TableStore
from tabloom.types import ROW_HASH


@pytest.fixture()
def store(spark, folder):
    return TableStore(spark, folder)


def rows(spark, ids):
    return spark.createDataFrame([(i, f"n{i}") for i in ids], "id bigint, name string")


def eight_files(spark, store):
    """Files of ids 0-9, 10-19, ..."""
    sorted_rows = spark.range(0, 80, numPartitions=8).select("id", F.concat(F.lit("n"), "id").alias("name"))
    return store.publish("t", sorted_rows, "replace", "first")


def test_an_upsert_opens_files_whose_extent_admits_a_key(spark, store, monkeypatch):
    first = eight_files(spark, store)
    opened = []
    read = TableStore._read
    monkeypatch.setattr(TableStore, "_read", lambda self, paths, schema: opened.append(paths) or read(self, paths, schema))
    store.upsert("t", rows(spark, [3, 75, 200]), "id", "second")
    assert len(opened[1]) == 8  # none is described yet
    third = store.upsert("t", rows(spark, [34, 36, 300]), "id", "third")
    assert sorted(r.id for r in third.collect()) == [*range(80), 200, 300]
    assert len(file_stats.admitting(store, "t", first, rows(spark, [34, 36, 300]), "id")) == 1
    opened.clear()
    assert file_stats.admitting(store, "t", first, rows(spark, [9, 10, 79, 80]), "id") and not opened  # all are described


def test_keys_that_no_file_admits_only_add_a_folder(spark, store):
    first = eight_files(spark, store)
    second = store.upsert("t", rows(spark, [-1, 1000, None]), "id", "second")
    assert set(first.inputFiles()) < set(second.inputFiles()) and second.count() == 83


@pytest.mark.parametrize("limit", [3, 1000])
def test_ranges_hold_all_keys(spark, limit):
    keys = [7, 7, 1, None, 30, 31, 32, 90]
    found = file_stats.key_ranges(spark.createDataFrame([(k,) for k in keys], "k int"), "k", limit)
    assert len(found) <= limit
    assert all(any(low <= k <= high for low, high in found) for k in keys if k is not None)
    assert file_stats.key_ranges(spark.createDataFrame([], "k int"), "k") == []


@pytest.mark.parametrize(
    "kind, values",
    [("string", ["a", "b", "é", ""]), ("date", [datetime.date(2020, 1, d) for d in (1, 2, 3, 9)]),
     ("decimal(18,4)", [decimal.Decimal(n) / 4 for n in (-1, 0, 3, 9)])],
)
def test_keys_of_any_type(spark, store, kind, values):
    make = lambda some, note: spark.createDataFrame([(v, note) for v in some], f"k {kind}, note string")
    store.publish("t", make(values, "old").repartitionByRange(2, "k"), "replace", "first")
    out = store.upsert("t", make(values[1:3], "new"), "k", "second")
    assert {(r.k, r.note) for r in out.collect()} == {(v, "new" if v in values[1:3] else "old") for v in values}


def test_fingerprint_of_a_version_is_that_of_its_rows(spark, store, monkeypatch):
    eight_files(spark, store)
    store.upsert("t", rows(spark, [3, 75, 200]), "id", "second")
    whole = fingerprint_sums(store.read("t").drop(ROW_HASH)).first()
    assert file_stats.stored_fingerprint(store, "t").first() == whole
    before = whole
    store.upsert("t", spark.createDataFrame([(3, "other")], "id bigint, name string"), "id", "third")
    opened = []
    read = TableStore._read
    monkeypatch.setattr(TableStore, "_read", lambda self, paths, schema: opened.append(paths) or read(self, paths, schema))
    now = file_stats.stored_fingerprint(store, "t").first()
    assert now != before and now == fingerprint_sums(store.read("t")).first()
    opened.clear()
    file_stats.stored_fingerprint(store, "t").collect()
    assert len(opened) == 1  # the version itself, for its list of files; no file is described again


def test_empty_tables_and_files(spark, store):
    store.publish("t", rows(spark, [1]).where("id > 1"), "replace", "first")
    assert tuple(file_stats.stored_fingerprint(store, "t").first()) == (0, "0", "0")
    assert sorted(r.id for r in store.upsert("t", rows(spark, [4, 5]), "id", "second").collect()) == [4, 5]
    assert store.upsert("t", rows(spark, []), "id", "third").count() == 2


def test_stored_tables_are_compared_by_their_sums(spark, store, folder):
    other = TableStore(spark, f"{folder}/other")
    eight_files(spark, store)
    other.publish("t", store.read("t").repartition(3), "copy", "first")
    assert tuple(file_stats.compare_stored(store, other, ["t"]).first()) == ("t", 80, 80, True)
    other.upsert("t", spark.createDataFrame([(3, "else")], "id bigint, name string"), "id", "second")
    assert tuple(file_stats.compare_stored(store, other, ["t"]).first()) == ("t", 80, 80, False)
