"""Delimited files, the SQL scope, external options."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tabloom import types as hub
from tabloom.operators import export, governance, profile
from tabloom.plans import derived, refresh
from tabloom.plans.file_load import load_file, load_new_files, with_serial_dates
from tabloom.plans.refresh import Source
from tabloom.plans.scoped_sql import ReadOnlyError, ScopeError, check_read_only, run_query
from tabloom.sources import delimited, external
from tabloom.sources.series import benchmark_rows
from tabloom.sources.store import TableStore
from tabloom.types import ColumnSpec


def write(folder, name, data):
    path = f"{folder}/{name}"
    with open(path, "wb") as out:
        out.write(data if isinstance(data, bytes) else data.encode("utf-8"))
    return path


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_short_rows_and_blank_lines(spark, folder):
    path = write(folder, "a.csv", "id,nome,valor\n1,Nome\n\n2,Outro,3\n")
    assert rows(delimited.read_delimited(spark, path)) == [("1", "Nome", None), ("2", "Outro", "3")]


def test_stray_quotes_stay(spark, folder):
    path = write(folder, "a.csv", 'id;nome\n1;PAPEL A4 2"\n2;"com ""aspas"" e ;"\n')
    assert rows(delimited.read_delimited(spark, path)) == [("1", 'PAPEL A4 2"'), ("2", 'com "aspas" e ;')]


def test_windows_1252_is_detected(spark, folder):
    text = "id;nome\n" + "1;plain\n" * 50 + "2;João\n3;Françoise\n4;Müller\n"
    path = write(folder, "a.csv", text.encode("cp1252"))
    assert delimited.detect_hints(spark, path) == ("windows-1252", ";")
    assert rows(delimited.read_delimited(spark, path))[-3:] == [("2", "João"), ("3", "Françoise"), ("4", "Müller")]


def test_utf8_with_mark(spark, folder):
    path = write(folder, "a.csv", b"\xef\xbb\xbf" + "id\tnome\n1\tJoão\n".encode())
    df = delimited.read_delimited(spark, path)
    assert df.columns == ["id", "nome"] and rows(df) == [("1", "João")]
    assert df.schema["id"].metadata["original_name"] == "id"


def test_repeated_headers(spark, folder):
    path = write(folder, "a.csv", "id,nome,nome,\n1,a,b,c\n")
    df = delimited.read_delimited(spark, path)
    assert df.columns == ["id", "nome", "nome_2", "col_4"] and rows(df) == [("1", "a", "b", "c")]


def test_line_breaks_in_values(spark, folder):
    path = write(folder, "a.csv", 'id,nome\n1,"two\nlines"\n2,x\n')
    assert rows(delimited.read_delimited(spark, path, multiline=True)) == [("1", "two\nlines"), ("2", "x")]


def test_long_values(spark, folder):
    path = write(folder, "a.csv", "id,nome\n1," + "x" * 10_000 + "\n")
    assert len(rows(delimited.read_delimited(spark, path))[0][1]) == 10_000


@pytest.mark.parametrize(("text", "mark"), [("a;b;c\n", ";"), ("a,b;c,d\n", ","), ("a\tb\n", "\t"), ("ab\n", ";"), ("a;b,c\n", ";")])
def test_separator(spark, folder, text, mark):
    path = write(folder, "a.csv", text)
    assert delimited.detect_hints(spark, path)[1] == mark
    df = spark.createDataFrame([(text,)], "t string").select(delimited.separator_of(F.col("t")).alias("s"))
    assert df.first().s == mark


def test_header_binding():
    headers = ["id", "nome", "nome", "x"]
    assert delimited.bind_header(headers, [("nome", "a"), ("nome", "b"), ("gone", "c"), ("id", "d")]) == [1, 2, 2, 0]


GOOD = [
    "SELECT 1",
    "select a from t where b in (select c from u);",
    "WITH x AS (SELECT 1 AS a) SELECT a FROM x",
    "SELECT 'DROP TABLE x; DELETE' AS s -- drop table y",
    "/* update t */ SELECT a, count(*) FROM t GROUP BY a HAVING count(*) > 1 ORDER BY 1 LIMIT 5",
    "SELECT * FROM a CROSS JOIN b",
    "(SELECT 1) UNION (SELECT 2) EXCEPT SELECT 3",
]
BAD = [
    "", "   ", "DROP TABLE x", "SELECT 1; DROP TABLE x", "UPDATE t SET a = 1", "INSERT INTO t SELECT 1",
    "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "EXECUTE IMMEDIATE 'DROP TABLE x'", "SHOW TABLES", "SET a=1",
    "CREATE TABLE t AS SELECT 1", "MERGE INTO t USING s ON t.a = s.a WHEN MATCHED THEN DELETE", "USE db", "SELEC 1",
    "BEGIN SELECT 1; END", "SELECT " + "1" * 50_001, "EXPLAIN SELECT 1", "TABLE t", "TRUNCATE TABLE t",
    "SELECT * FROM IDENTIFIER('t')", "DESCRIBE t", "GRANT SELECT ON t TO u",
]


@pytest.mark.parametrize("sql", GOOD)
def test_reads_are_allowed(spark, sql):
    assert check_read_only(spark, sql) == sql.strip()


@pytest.mark.parametrize("sql", BAD)
def test_all_else_is_refused(spark, sql):
    with pytest.raises(ReadOnlyError):
        check_read_only(spark, sql)


def test_scope(spark, table):
    scope = {"a": {"nation": table("nation"), "region": table("region")}, "b": {"nation": table("nation").limit(3)}}
    assert run_query(spark, "SELECT count(*) AS n FROM region", scope).first().n == 5
    assert run_query(spark, "SELECT count(*) AS n FROM b__nation", scope).first().n == 3
    assert run_query(spark, "WITH nation AS (SELECT 1) SELECT * FROM nation", scope).count() == 1
    assert run_query(spark, "SELECT * FROM region CROSS JOIN b__nation", scope).count() == 15
    assert run_query(spark, "SELECT * FROM region", scope, 2, 1, ["r_regionkey"]).count() == 2
    with pytest.raises(ScopeError, match="ambiguous"):
        run_query(spark, "SELECT * FROM nation", scope)
    with pytest.raises(ScopeError, match="not in the scope"):
        run_query(spark, "SELECT * FROM region WHERE r_regionkey IN (SELECT x FROM secret)", scope)
    with pytest.raises(ScopeError, match="not in the scope"):
        run_query(spark, "SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`", scope)


def test_derived_refresh_is_guarded(spark, folder, table):
    store = TableStore(spark, folder)
    scope = {"a": {"orders": table("orders")}}
    stored, columns = derived.refresh_derived(
        store, "d", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey", scope, "one"
    )
    assert [(c.sql_name, c.sql_type) for c in columns] == [("o_custkey", hub.BIGINT), ("n", hub.BIGINT)]
    assert stored.agg(F.sum("n")).first()[0] == table("orders").count()
    with pytest.raises(ReadOnlyError):
        derived.refresh_derived(store, "d", "DROP TABLE orders", scope, "two")


def test_incremental_refresh(spark, folder):
    store = TableStore(spark, folder)
    data = {"rows": [(1, 10), (2, 20)]}
    source = Source(
        "t", lambda: spark.createDataFrame(data["rows"], "id bigint, at bigint"), key="id", delta_column="at"
    )
    first = refresh.refresh(store, source, "one")
    assert first.watermark == 20
    data["rows"] = [(1, 10), (2, 25), (3, 30)]
    second = refresh.refresh(store, source, "two", first.watermark)
    assert (sorted(rows(second.rows)), second.watermark) == ([(1, 10), (2, 25), (3, 30)], 30)
    third = refresh.refresh(store, source, "three", second.watermark)
    assert (sorted(rows(third.rows)), third.watermark) == ([(1, 10), (2, 25), (3, 30)], 30)


def test_source_without_key_is_replaced(spark, folder):
    store = TableStore(spark, folder)
    data = {"rows": [(1,), (2,)]}
    source = Source("t", lambda: spark.createDataFrame(data["rows"], "id bigint"))
    refresh.refresh(store, source, "one")
    data["rows"] = [(3,)]
    assert rows(refresh.refresh(store, source, "two").rows) == [(3,)]


def test_jdbc_query_must_read(spark):
    with pytest.raises(ReadOnlyError):
        external.jdbc_query(spark, external.Connection("jdbc:none"), "DELETE FROM t")


@pytest.mark.parametrize(
    ("name", "canonical"),
    [("int4", hub.BIGINT), ("numeric(10,2)", hub.DECIMAL), ("MONEY", hub.DECIMAL), ("timestamptz", hub.DATETIME),
     ("datetimeoffset", hub.DATETIME), ("time", hub.TIME), ("uuid", hub.TEXT), ("boolean", hub.TEXT)],
)
def test_type_names(name, canonical):
    assert hub.canonical_from_name(name) == canonical


def test_file_load_by_mapping(spark, folder):
    """Headers in another order and a repeated one; the table keeps the mapping's order."""
    store = TableStore(spark, f"{folder}/store")
    first = write(folder, "a.csv", "Código;Valor;Valor\n007;1,5;2\n")
    assert rows(load_file(store, "t", first, "replace", "one").drop("row_hash")) == [("007", Decimal("1.5"), 2)]
    mapping = [
        ColumnSpec("Valor", "valor", hub.DECIMAL), ColumnSpec("Valor", "valor_2", hub.BIGINT),
        ColumnSpec("Código", "codigo", hub.TEXT), ColumnSpec("Outro", "outro", hub.TEXT),
    ]
    out = load_file(store, "u", first, "replace", "two", mapping=mapping).drop("row_hash")
    assert out.columns == ["valor", "valor_2", "codigo", "outro"]
    assert rows(out) == [(Decimal("1.5"), 2, "007", None)]


def test_delta_without_removals_keeps_files(spark, folder):
    store = TableStore(spark, f"{folder}/store")
    load_file(store, "t", write(folder, "a.csv", "n;v\n1;a\n2;b\n"), "replace", "one")
    load_file(store, "t", write(folder, "b.csv", "n;v\n1;a\n2;b\n3;c\n"), "replace", "two")
    newest = store.versions().orderBy(F.desc("version")).first()
    assert [p.rsplit("/", 1)[1] for p in newest.paths] == ["one", "two"]
    assert (newest.row_count, newest.inserted, newest.updated) == (3, 1, 0)
    assert sorted(rows(store.read("t").select("n", "v"))) == [(1, "a"), (2, "b"), (3, "c")]


def test_serial_dates(text_rows):
    raw = text_rows(["dia", "n"], [("45000", "45000"), ("2024-01-02", "1")])
    mapping = [ColumnSpec("dia", "dia", hub.DATE), ColumnSpec("n", "n", hub.BIGINT)]
    assert rows(with_serial_dates(raw, mapping)) == [("2023-03-15", "45000"), ("2024-01-02", "1")]


def test_series(spark):
    df = benchmark_rows(spark, 1000)
    assert df.agg(F.count_distinct("categoria"), F.count_distinct("data_ref")).first()[:] == (5, 730)
    assert df.where("id = 1").first().valor == Decimal("79.19")


def test_quoted_line_breaks_are_found(spark, folder):
    def read(name, text):
        path = f"{folder}/{name}.csv"
        with open(path, "w", encoding="utf-8") as file:
            file.write(text)
        return path, [tuple(r) for r in delimited.read_delimited(spark, path).collect()]

    path, rows = read("breaks", 'id,nota\n1,"uma\nlinha, ""dita"""\n2,b\n')
    assert rows == [("1", 'uma\nlinha, "dita"'), ("2", "b")] and delimited.has_quoted_breaks(spark, path, ",")
    path, rows = read("stray", 'id,nota\n1,PAPEL 2"\n2,"a, ""b"""\n3,"x"\n')
    assert [r[0] for r in rows] == ["1", "2", "3"] and not delimited.has_quoted_breaks(spark, path, ",")


def test_a_scope_cannot_be_left(spark):
    own, secret = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(7,)], "a int")
    assert run_query(spark, "SELECT a FROM hidden_rows", {"x": {"hidden_rows": secret}}).count() == 1
    with pytest.raises(Exception, match="hidden_rows"):
        run_query(spark, "WITH hidden_rows AS (SELECT * FROM hidden_rows) SELECT * FROM hidden_rows", {"x": {"t": own}}).collect()
    nested = "SELECT * FROM hidden_rows WHERE a IN (WITH hidden_rows AS (SELECT 1 AS a) SELECT a FROM hidden_rows)"
    with pytest.raises(Exception, match="hidden_rows"):
        run_query(spark, nested, {"x": {"t": own}}).collect()
    same = run_query(spark, "WITH t AS (SELECT a + 1 AS a FROM t) SELECT a FROM t", {"x": {"t": own}})
    assert [r["a"] for r in same.collect()] == [2] and not spark.catalog.tableExists("t")
    with pytest.raises(ReadOnlyError, match="reflect"):
        check_read_only(spark, "SELECT reflect('java.lang.System', 'getProperty', 'user.dir') AS d FROM t")
    assert check_read_only(spark, "SELECT 'reflect(x)' AS d FROM t")


def test_upserts_need_the_columns_of_the_table(spark, folder):
    store = TableStore(spark, folder)
    store.publish("t", spark.createDataFrame([(1, "a", "b")], "id int, a string, b string"), "replace", "first")
    for rows, schema in (([(2, "a")], "id int, a string"), ([(2, "a", 3)], "id int, a string, b int")):
        with pytest.raises(ValueError, match="columns differ"):
            store.upsert("t", spark.createDataFrame(rows, schema), "id", "second")
    assert store.read("t").count() == 1


def test_files_of_a_folder_may_differ(spark, folder):
    import os

    os.mkdir(f"{folder}/in")
    write(folder, "in/a.csv", "id;nome\n1;João\n")
    write(folder, "in/b.csv", "nome;id\nFrançoise;2\n".encode("cp1252"))
    write(folder, "in/c.csv", 'id,nome,nota\n3,"a;b","uma\nlinha"\n')
    df = delimited.read_delimited(spark, f"{folder}/in")
    assert df.columns == ["id", "nome", "nota"]
    assert sorted(rows(df)) == [("1", "João", None), ("2", "Françoise", None), ("3", "a;b", "uma\nlinha")]
    mapping = [ColumnSpec("nome", "quem", hub.TEXT), ColumnSpec("id", "id", hub.BIGINT)]
    bound = delimited.read_for_mapping(spark, f"{folder}/in", mapping)
    assert sorted(rows(bound)) == [("Françoise", "2"), ("João", "1"), ("a;b", "3")]
    hints = {r.file.rsplit("/", 1)[1]: (r.encoding, r.separator, r.breaks) for r in delimited.file_hints(spark, f"{folder}/in").collect()}
    assert hints == {"a.csv": ("UTF-8", ";", False), "b.csv": ("windows-1252", ";", False), "c.csv": ("UTF-8", ",", True)}


def test_headers_survive_a_load(spark, folder):
    """The table keeps the headers as they stood in the file, and they decide what is an identifier."""
    store = TableStore(spark, f"{folder}/store")
    path = write(folder, "a.csv", "Valor Total,Descrição,Nº do CPF,Valor Total\n1,x,123,2\n")
    out = load_file(store, "t", path, "replace", "one")
    raw = delimited.read_delimited(spark, path)
    mapping = profile.infer_mapping(raw)
    lines = [r.line for r in export.column_dictionary(mapping, spark).orderBy("ordinal").collect()]
    assert lines == [
        "valor_total;Valor Total;BIGINT;Sim", "descricao;Descrição;NVARCHAR(MAX);Sim", "n_do_cpf;Nº do CPF;NVARCHAR(MAX);Sim",
        "valor_total_2;Valor Total;BIGINT;Sim",
    ]
    assert rows(out.drop("row_hash")) == [(1, "x", "123", 2)]
    assert [hub.header_of(f) for f in store.read("t").drop("row_hash").schema.fields] == [c.original_name for c in mapping]
    events = governance.load_perf(store.events()).collect()
    assert [(e.table_name, e.rows) for e in events] == [("t", 1)] and events[0].total_seconds >= events[0].insert_seconds > 0


def test_refresh_keeps_state(spark, folder):
    store = TableStore(spark, folder)
    data = {"rows": [(1, 10), (2, 20)], "names": "Id bigint, `Alterado Em` bigint"}
    source = Source("t", lambda: spark.createDataFrame(data["rows"], data["names"]), key="Id", delta_column="Alterado Em")
    assert refresh.refresh(store, source, "one").watermark == 20 and store.watermark("t") == "20"
    data["rows"] = [(1, 15), (3, 30)]  # the first is older than the stored mark
    assert sorted(rows(refresh.refresh(store, source, "two").rows)) == [(1, 10), (2, 20), (3, 30)]
    data.update(rows=[(1,)], names="Id bigint")
    with pytest.raises(Exception, match="Alterado Em"):
        refresh.refresh(store, source, "three")
    log = [(r.load_id, r.status, r.watermark, r.row_count) for r in store.sources().orderBy("logged_at").collect()]
    assert log == [("one", "completed", "20", 2), ("two", "completed", "30", 3), ("three", "failed", None, None)]
    assert store.watermark("t") == "30" and store.read("t").columns == ["id", "alterado_em"]


def test_known_files_are_not_loaded_again(spark, folder):
    import os

    store = TableStore(spark, f"{folder}/store")
    os.mkdir(f"{folder}/in")
    write(folder, "in/a.csv", "n;v\n1;a\n")
    write(folder, "in/b.csv", "n;v\n1;a\n")
    write(folder, "in/c.csv", "n;v\n2;b\n")
    assert [f.rsplit("/", 1)[1] for f in load_new_files(store, "t", f"{folder}/in", "one")] == ["a.csv", "c.csv"]
    write(folder, "in/d.csv", "n;v\n3;c\n")
    assert [f.rsplit("/", 1)[1] for f in load_new_files(store, "t", f"{folder}/in", "two")] == ["d.csv"]
    assert load_new_files(store, "t", f"{folder}/in", "three") == []
    assert sorted(rows(store.read("t").select("n", "v"))) == [(1, "a"), (2, "b"), (3, "c")]


def test_compaction_vacuum_and_drop(spark, folder):
    import os

    store = TableStore(spark, f"{folder}/t")  # a root that is named like the table
    for i in range(3):
        load_file(store, "t", write(folder, f"{i}.csv", f"n;v\n{i};a\n"), "append" if i else "replace", f"load-{i}")
    assert store.vacuum("t") == []
    assert store.compact("t", "whole").count() == 3
    newest = store.versions().orderBy(F.desc("version")).first()
    assert (newest.row_count, newest.inserted, newest.updated, len(newest.paths)) == (3, 0, 0, 1)
    os.makedirs(f"{folder}/t/t/at-work")
    assert len(store.vacuum("t")) == 3 and sorted(os.listdir(f"{folder}/t/t")) == ["at-work", "whole"]
    assert sorted(rows(store.read("t").select("n"))) == [(0,), (1,), (2,)]
    store.drop(["t"], "gone")
    assert not store.exists("t")
    with pytest.raises(KeyError):
        store.read("t")
    assert [f.rsplit("/", 1)[1] for f in store.vacuum("t")] == ["whole"]
    load_file(store, "t", write(folder, "b.csv", "n;v\n7;z\n"), "replace", "again")
    assert rows(store.read("t").select("n", "v")) == [(7, "z")]
    assert store.versions().agg(F.max("version")).first()[0] == 6
