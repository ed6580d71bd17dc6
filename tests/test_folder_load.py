"""Folder loads that lose and double nothing, and versions that two writers cannot both own."""

import pathlib
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest

from tabloom.plans import file_load
from tabloom.plans.file_load import load_new_files
from tabloom.sources import delimited
from tabloom.sources.store import TableStore


def put(folder, name, text):
    path = pathlib.Path(folder, "in", name)
    path.parent.mkdir(exist_ok=True)
    path.write_text(text)


def held(store, table="t"):
    return sorted((r["n"], r["v"]) for r in store.read(table).select("n", "v").collect())


def test_a_run_that_died_is_repeated(spark, folder, monkeypatch):
    store = TableStore(spark, f"{folder}/store")
    put(folder, "b.csv", "n;v\n2;b\n")
    put(folder, "c.csv", "n;v\n3;c\n")
    load, seen = file_load.load_file, []

    def dies(store, table, path, *rest, **options):
        done = load(store, table, path, *rest, **options)
        seen.append(path)
        if len(seen) == 2:
            raise RuntimeError("the driver is gone")
        return done

    monkeypatch.setattr(file_load, "load_file", dies)
    with pytest.raises(RuntimeError):
        load_new_files(store, "t", f"{folder}/in", "L")
    monkeypatch.setattr(file_load, "load_file", load)
    put(folder, "a.csv", "n;v\n1;a\n")
    assert [f.rsplit("/", 1)[1] for f in load_new_files(store, "t", f"{folder}/in", "L")] == ["a.csv"]
    assert held(store) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(r["file"].rsplit("/", 1)[1] for r in store.files().collect()) == ["a.csv", "b.csv", "c.csv"]


def test_files_are_known_by_table_and_order(spark, folder):
    store = TableStore(spark, f"{folder}/store")
    put(folder, "a.csv", 'n;v\n1;"x\n2;y"\n')
    assert len(load_new_files(store, "t", f"{folder}/in", "one")) == 1
    assert len(load_new_files(store, "u", f"{folder}/in", "one")) == 1
    put(folder, "b.csv", 'n;v\n2;y"\n1;"x\n')  # the same lines in another order
    put(folder, "c.csv", 'n;v\n1;"x\n2;y"\n')
    assert [f.rsplit("/", 1)[1] for f in load_new_files(store, "t", f"{folder}/in", "two")] == ["b.csv"]
    store.drop(["t"], "gone")
    assert len(load_new_files(store, "t", f"{folder}/in", "three")) == 2


def test_digests_do_not_depend_on_splits(spark, folder):
    put(folder, "a.csv", "".join(f"{i};row\n" for i in range(300)))
    put(folder, "b.csv", "".join(f"{i};row\r\n" for i in range(300)))
    put(folder, "c.csv", "".join(f"{i};row\n" for i in range(300)).rstrip())
    whole = sorted(map(str, delimited.file_digests(spark, f"{folder}/in").collect()))
    assert len({w.split("size_bytes")[1] for w in whole}) == 3
    keys = {"spark.sql.files.maxPartitionBytes": "101", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        assert sorted(map(str, delimited.file_digests(spark, f"{folder}/in").collect())) == whole
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_writers_share_a_store_without_exclusive_creation(spark, folder):
    owners, lock = {}, threading.Lock()

    def owner(path, load_id):
        with lock:
            return owners.setdefault(path, load_id)

    store = TableStore(spark, f"{folder}/store", owner)
    key = delimited.read_delimited(spark, _one(folder, 0), ";", "UTF-8", multiline=False)
    store.publish("t", key.selectExpr("cast(n as bigint) as n", "v"), "replace", "first")

    def writes(i):
        rows = spark.createDataFrame([(i, f"by {i}")], "n long, v string")
        return store.upsert("t", rows, "n", f"load-{i}")

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(writes, range(1, 4)))
    assert held(store) == [(0, "a"), (1, "by 1"), (2, "by 2"), (3, "by 3")]
    assert len(owners) == 4 and not pathlib.Path(folder, "store", "_claims").exists()


def test_claims_are_whole_files(spark, folder):
    store = TableStore(spark, f"{folder}/store")
    assert [store._created(f"{folder}/store/_claims/t/1", x) for x in ("a", "b", "a")] == ["a", "a", "a"]
    assert store.upsert("new", spark.createDataFrame([(1, "x")], "n long, v string"), "n", "made").count() == 1


def _one(folder, i):
    put(folder, f"{i}.csv", f"n;v\n{i};a\n")
    return f"{folder}/in/{i}.csv"
