import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tabloom import types as hub
from tabloom.checks import loads
from tabloom.functions.text import BLANKS, has_text, left_trimmed
from tabloom.operators import load
from tabloom.operators.mapping import apply_mapping
from tabloom.operators.skew import keep_by_key, look_up
from tabloom.sources.store import IntegrityError, OvertakenError, TableStore
from tabloom.types import ColumnSpec

MAPPING = [
    ColumnSpec("id", "id", hub.BIGINT),
    ColumnSpec("nome", "nome", hub.TEXT),
    ColumnSpec("valor", "valor", hub.BIGINT),
]


@pytest.fixture()
def store(spark, folder):
    return TableStore(spark, folder)


@pytest.fixture()
def file_of(text_rows):
    def make(ids, valor=lambda i: 100 * i):
        return text_rows(["id", "nome", "valor"], [(str(i), f"n{i}", str(valor(i))) for i in ids])

    return make


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_replace_scenario(store, file_of):
    def replace(n, raw):
        return store.load("t", raw, MAPPING, "replace", f"load-{n}")

    assert ids(replace(1, file_of(range(1, 6)))) == [1, 2, 3, 4, 5]
    assert ids(replace(2, file_of(range(1, 9)))) == list(range(1, 9))
    assert ids(replace(3, file_of([1, 2, 3, 6, 7, 9]))) == [1, 2, 3, 6, 7, 9]
    edited = replace(4, file_of([1, 2, 3, 6, 7, 9], lambda i: 999 if i == 1 else 100 * i))
    assert ids(edited) == [1, 2, 3, 6, 7, 9]
    assert edited.where("id = 1").first().valor == 999
    same = replace(5, file_of([1, 2, 3, 6, 7, 9], lambda i: 999 if i == 1 else 100 * i))
    assert sorted(same.collect()) == sorted(edited.collect())
    newest = store.versions().orderBy(F.desc("version")).first()
    assert (newest.version, newest.mode, newest.inserted, newest.updated) == (5, "delta-replace", 0, 0)
    assert newest.paths == store.versions().where("version = 4").first().paths
    assert ids(replace(6, file_of([10, 11, 12]))) == [10, 11, 12]


def test_append_then_replace(store, file_of):
    store.load("t", file_of(range(500)), MAPPING, "replace", "a")
    assert store.load("t", file_of(range(500, 1000)), MAPPING, "append", "b").count() == 1000
    assert store.load("t", file_of(range(300)), MAPPING, "replace", "c").agg(F.sum("valor")).first()[0] == sum(
        100 * i for i in range(300)
    )


def test_upsert_counts_and_is_idempotent(store, file_of, broadcast_limit):
    store.load("t", file_of(range(1, 6)), MAPPING, "replace", "a")
    first = store.load("t", file_of([4, 5, 6], lambda i: i), MAPPING, "upsert", "b", key="id")
    assert ids(first) == [1, 2, 3, 4, 5, 6]
    newest = store.versions().orderBy(F.desc("version")).first()
    assert (newest.inserted, newest.updated) == (3, 2)
    again = store.load("t", file_of([4, 5, 6], lambda i: i), MAPPING, "upsert", "c", key="id")
    assert sorted(again.collect()) == sorted(first.collect())


def test_upsert_refuses_repeated_keys(store, file_of, text_rows):
    store.load("t", file_of(range(3)), MAPPING, "replace", "a")
    with pytest.raises(ValueError, match="repeated"):
        store.load("t", file_of([1, 1]), MAPPING, "upsert", "b", key="id")
    two_nulls = text_rows(["id", "nome", "valor"], [("", "a", "1"), ("", "b", "2")])
    with pytest.raises(ValueError, match="repeated"):
        store.load("t", two_nulls, MAPPING, "upsert", "c", key="id")
    with pytest.raises(ValueError, match="key"):
        store.load("t", file_of([1]), MAPPING, "upsert", "d", key="other")


def test_schema_has_to_fit(store, file_of):
    store.load("t", file_of(range(3)), MAPPING, "replace", "a")
    other = [MAPPING[1], MAPPING[0], MAPPING[2]]
    with pytest.raises(ValueError, match="incompatible"):
        store.load("t", file_of([9]), other, "append", "b")
    typed = [MAPPING[0], MAPPING[1], ColumnSpec("valor", "valor", hub.DECIMAL)]
    assert load.schema_mismatches(store.read("t"), typed) == ["valor: expected decimal(18,4), found bigint"]
    assert store.load("t", file_of([9]), typed, "replace", "c").count() == 1


def test_a_load_id_counts_once(store, file_of):
    store.load("t", file_of(range(3)), MAPPING, "replace", "a")
    store.load("t", file_of(range(3)), MAPPING, "append", "b")
    store.load("t", file_of(range(3)), MAPPING, "append", "b")
    assert store.read("t").count() == 6 and store.versions().count() == 2


def test_leftovers_of_a_failed_load_are_replaced(store, file_of, spark, folder):
    apply_mapping(file_of(range(99)), MAPPING, with_hash=True).write.parquet(f"{folder}/t/a")
    assert not store.exists("t")
    assert store.load("t", file_of(range(3)), MAPPING, "replace", "a").count() == 3


def test_guard_keeps_the_old_version(store, file_of, monkeypatch):
    store.load("t", file_of(range(3)), MAPPING, "replace", "a")

    class Miscount:
        get = {"n": 7}

    monkeypatch.setattr("tabloom.sources.store.Observation", Miscount)
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.observe", lambda self, *a: self)
    with pytest.raises(IntegrityError):
        store.publish("t", store.read("t"), "replace", "b")
    assert store.read("t").count() == 3


def test_of_two_writers_from_one_version_none_is_lost(store, file_of, monkeypatch):
    store.load("t", file_of(range(3)), MAPPING, "replace", "a")
    seen, rows = store._state("t"), store.read("t")
    store.load("t", file_of([10]), MAPPING, "append", "b")
    with pytest.raises(OvertakenError):
        store.publish("t", rows, "replace", "c", state=seen)
    assert ids(store.read("t")) == [0, 1, 2, 10]

    late, now = [seen], store._state
    monkeypatch.setattr(store, "_state", lambda *args: late.pop() if late else now(*args))
    assert ids(store.load("t", file_of([20]), MAPPING, "append", "d")) == [0, 1, 2, 10, 20]
    assert sorted(r.version for r in store.versions().collect()) == [1, 2, 3]


def test_a_claim_is_taken_up_by_the_retry(store, file_of):
    store.load("t", file_of(range(3)), MAPPING, "replace", "a")
    store._claim("t", 2, "b")
    assert ids(store.load("t", file_of([10]), MAPPING, "append", "b")) == [0, 1, 2, 10]


def test_loads_leave_no_copies(spark, store, file_of, monkeypatch, tmp_path):
    shared = tmp_path / "shared"
    shared.mkdir()
    monkeypatch.setattr("tabloom.session.shared_dir", lambda spark: str(shared))
    store.load("t", file_of(range(9)), MAPPING, "replace", "a")
    assert ids(store.load("t", file_of(range(4, 12)), MAPPING, "replace", "b")) == list(range(4, 12))
    assert ids(store.load("t", file_of([5, 40]), MAPPING, "upsert", "c", key="id")) == [*range(4, 12), 40]
    assert list(shared.iterdir()) == []


def test_delta_set_and_multiset(text_rows, broadcast_limit):
    def hashed(rows):
        return apply_mapping(text_rows(["id", "nome", "valor"], rows), MAPPING, with_hash=True)

    target = hashed([("1", "a", "1")] * 3 + [("2", "b", "2")])
    incoming = hashed([("1", "a", "1")] + [("3", "c", "3")] * 2)
    assert ids(load.delta_replace(target, incoming)) == [1, 1, 1, 3, 3]
    exact = load.delta_changes(target, incoming, multiset=True)
    assert ids(load.delta_replace(target, incoming, exact)) == [1, 3, 3]
    counts = load.delta_counts(target, load.delta_changes(target, incoming)).first()
    assert (counts.inserted, counts.updated) == (2, 1)


def test_rows_without_hash_are_dropped_by_a_delta(text_rows):
    raw = text_rows(["id", "nome", "valor"], [("1", "a", "1"), ("2", "b", "2")])
    target = apply_mapping(raw, MAPPING, with_hash=True).withColumn(
        "row_hash", F.when(F.col("id") == 1, F.col("row_hash"))
    )
    incoming = apply_mapping(raw, MAPPING, with_hash=True)
    assert ids(load.delta_replace(target, incoming)) == [1, 2]
    assert load.delta_counts(target, load.delta_changes(target, incoming)).first().updated == 1


def test_precomputed_delta(text_rows, broadcast_limit):
    raw = text_rows(["id", "nome", "valor"], [(str(i), "a", "1") for i in range(4)])
    rows = apply_mapping(raw, MAPPING, with_hash=True)
    out = load.delta_precomputed(rows.where("id < 3"), rows.where("id > 1"), rows.where("id = 0").select("row_hash"))
    assert ids(out) == [1, 2, 3]


def test_delta_prep_gates(store, file_of):
    store.load("t", file_of(range(3)), MAPPING, "replace", "a")
    assert load.delta_prep(store.read("t"), MAPPING).count() == 3
    with pytest.raises(ValueError, match="no-hash-col"):
        load.delta_prep(store.read("t").drop("row_hash"), MAPPING)
    with pytest.raises(ValueError, match="schema-mismatch"):
        load.delta_prep(store.read("t"), MAPPING[:2])


@pytest.fixture(params=["10MB", "-1"])
def broadcast_limit(spark, request):
    """With small key sides broadcast, and with none."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("present", [True, False])
def test_keep_by_key_against_brute_force(spark, present, broadcast_limit):
    """One key holds a third of the rows, another share has no key at all."""
    draw = random.Random(7)
    rows = [(draw.choice([0, None, i % 97]), i) for i in range(3000)]
    keys = [(draw.choice([0, None, i]),) for i in range(0, 97, 3)]
    held = {k for (k,) in keys if k is not None}
    left = spark.createDataFrame(rows, "k bigint, v bigint").repartition(7)
    right = spark.createDataFrame(keys, "k bigint")
    out = {r.v for r in keep_by_key(left, right, ["k"], present).collect()}
    assert out == {v for k, v in rows if (k in held) is present}


def test_keep_by_key_spreads_a_hot_key(spark):
    """Rows of a hot key reach several reducers; a cold key stays whole."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = spark.range(8000, numPartitions=8).selectExpr("if(id % 3 = 0, 0, id) as k", "id as v")
        kept = keep_by_key(
            left, spark.range(1).withColumnRenamed("id", "k"), ["k"], True
        )
        per_task = kept.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in per_task) == 2667
        assert len(per_task) > 1
        # nor does it matter that the rows come out of a shuffle by the key: another one before it spreads them
        crowd = spark.range(20_000).selectExpr("if(id % 10 = 0, id, -1) as k", "id as v").repartition(8, "k")
        for present in (True, False):
            kept = keep_by_key(crowd, spark.range(500).selectExpr("id - 1 as k"), ["k"], present)
            assert kept.count() == (18_050 if present else 1950)
            shuffles = [p for p in kept._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(k" in p]
            assert shuffles  # of the rows that are not hot
        facts = spark.range(2).selectExpr("id - 1 as k", "'x' as name")
        named = look_up(crowd.unionByName(spark.createDataFrame([(None, 1)], "k bigint, v bigint")), facts, ["k"])
        assert (named.count(), named.where("name = 'x'").count()) == (20_001, 18_001)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_latest_per_key(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (1, 2, "z")], "k int, at int, v string")
    out = load.latest_per_key(df, "k", ["at", "v"]).collect()
    assert sorted(tuple(r) for r in out) == [(1, 2, "z"), (2, 1, "c")]


def test_payload_dedupe(spark):
    uploads = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z")], "id int, content string")
    seen = load.dedupe_payloads(uploads.where("id = 3"), uploads.where("id = 0").selectExpr("1 size_bytes", "'' md5"), "id")
    out = load.dedupe_payloads(uploads, seen, "id")
    assert sorted(r.id for r in out.collect()) == [1, 4]


def test_untouched_files_stay(spark, store, file_of, broadcast_limit):
    """Of four files one holds a changed key; a delta and an upsert rewrite that one only."""
    four = file_of(range(40)).withColumn("n", F.col("id").cast("int")).repartitionByRange(4, "n").drop("n")
    first = store.load("t", four, MAPPING, "replace", "a")
    names = {f.rsplit("/", 1)[1] for f in first.inputFiles()}
    assert len(names) == 4

    second = store.load("t", file_of([3, 50], lambda i: -i), MAPPING, "upsert", "b", key="id")
    kept = {f.rsplit("/", 1)[1] for f in second.inputFiles()} & names
    assert len(kept) == 3
    assert ids(second) == [*range(40), 50] and second.where("id = 3").first().valor == -3
    newest = store.versions().orderBy(F.desc("version")).first()
    assert (newest.row_count, newest.inserted, newest.updated) == (41, 2, 1)

    file = file_of([i for i in range(40) if i != 25], lambda i: -i if i == 3 else 100 * i)
    third = store.load("t", file, MAPPING, "replace", "c")
    assert len({f.rsplit("/", 1)[1] for f in third.inputFiles()} & names) == 2
    assert sorted((r.id, r.valor) for r in third.collect()) == sorted(
        (i, -i if i == 3 else 100 * i) for i in range(40) if i != 25
    )
    newest = store.versions().orderBy(F.desc("version")).first()
    assert (newest.row_count, newest.inserted, newest.updated) == (39, 0, 2)


def test_random_loads_against_a_model(spark, store, file_of):
    """Appends, upserts and replaces in random order; the store always holds what a dictionary of rows says."""
    draw = random.Random(11)
    model = []
    for step in range(9):
        mode = draw.choice(["replace", "append", "upsert"]) if step else "replace"
        keys = draw.sample(range(12), draw.randrange(1, 9))
        new = [(k, 100 * k + step % 3) for k in keys]
        raw = file_of(keys, lambda k, step=step: 100 * k + step % 3)
        if mode == "replace":
            # Set semantics: copies of a row that the file still has all stay.
            old = [r for r in model if r in new]
            model = old + [r for r in new if r not in model]
        elif mode == "append":
            model = model + new
        else:
            model = [r for r in model if r[0] not in keys] + new
        out = store.load("t", raw, MAPPING, mode, f"load-{step}", key="id")
        assert sorted((r.id, r.valor) for r in out.collect()) == sorted(model), (step, mode)
        assert store.versions().orderBy(F.desc("version")).first().row_count == len(model)


@pytest.mark.parametrize("name", ["load_delta_precomputed", "load_counts", "delta_reconciled"])
def test_rows_are_hashed_once(spark, name, capsys):
    """A side that is read more than once is stored first: no plan converts and hashes its text again."""
    loads.registry.queries[name](spark, "/root/testdata/sf0.001").explain("extended")
    assert "md5(" not in capsys.readouterr().out


def test_new_rows_meet_target_and_list_in_one_join(spark, monkeypatch):
    """Neither what the target has nor what is listed goes in; one join for the new rows, one for the target's."""
    joins = []
    monkeypatch.setattr(load, "keep_by_key", lambda *a, **b: joins.append(a) or keep_by_key(*a, **b))
    rows = spark.createDataFrame([(h, n) for n, h in enumerate("abcde")], "row_hash string, n long")
    removed = spark.createDataFrame([("d",), ("x",)], "row_hash string")
    out = load.delta_precomputed(rows.where("n < 2"), rows.where("n > 0"), removed)
    assert sorted(r.row_hash for r in out.collect()) == ["a", "b", "c", "e"] and len(joins) == 2


def test_rows_are_converted_by_short_methods(spark, store, file_of, monkeypatch):
    """A method beyond 8000 bytecodes is interpreted, which doubles the time of a load; the session is left as it is."""
    key, seen, write = "spark.sql.codegen.hugeMethodLimit", {}, DataFrameWriter.parquet

    def parquet(writer, path, *a, **b):
        seen[path.rsplit("/", 1)[1].split("-")[0]] = spark.conf.get(key)
        return write(writer, path, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    before = spark.conf.get(key)
    store.load("t", file_of(range(3)), MAPPING, "replace", "first")
    store.load("t", file_of(range(4)), MAPPING, "replace", "second")
    assert [seen[name] for name in ("first", "second", "incoming", "changes")] == ["8000"] * 4
    assert spark.conf.get(key) == before != "8000"


def test_blanks_at_the_start(spark):
    values = [None, "", " ", "\t x", "\u00a0", "\u00a0é", "\ufeff1", "!", "~ ", "\x7f", "\x1f", "é", " \u3000", "a\u00a0", "\x0b\x0c"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    found = rows.select("v", left_trimmed(F.col("v")).alias("left"), has_text(F.col("v")).alias("text")).collect()
    assert [r.left for r in found] == [None if v is None else v.lstrip(BLANKS) for v in values]
    assert [r.text for r in found] == [None if v is None else v.strip(BLANKS) != "" for v in values]
