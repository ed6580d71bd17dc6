"""Quoted line breaks across splits: equal to Spark's reading of whole files and to Python's csv."""

import csv
import io
import pathlib
import random

import pytest

from tabloom.sources import delimited, quoted


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def made(seed, ends):
    """Rows whose values hold breaks, separators and quotes, some longer than many splits."""
    dice = random.Random(seed)
    bits = ["a", "é", ",", '"', "\n", "\n\n", ", \"", "\",\"", "x\n\"y\"\n", " ", "word " * 9, "\n" * 30]
    rows = [["id", "te\nxt", "z"]] + [
        [str(i), "".join(dice.choice(bits) for _ in range(dice.randrange(7))), dice.choice(["", "q", "long\n" * 60, "w"])] for i in range(60)
    ]
    out = io.StringIO()
    csv.writer(out, quoting=dice.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]), lineterminator=ends).writerows(rows)
    return rows, out.getvalue()


@pytest.mark.parametrize("seed, ends, encoding", [(1, "\n", "utf-8"), (2, "\r\n", "utf-8"), (3, "\n", "cp1252"), (4, "\n", "utf-8"), (5, "\n", "utf-8")])
def test_equal_to_whole_files(spark, folder, small_splits, seed, ends, encoding):
    rows, text = made(seed, ends)
    pathlib.Path(folder, "a.csv").write_bytes(text.encode(encoding))
    name = {"utf-8": "UTF-8", "cp1252": "windows-1252"}[encoding]
    found = delimited.read_delimited(spark, f"{folder}/a.csv", ",", name, multiline=True)
    assert found.schema["te_xt"].metadata["original_name"] == "te\nxt"
    got = sorted(tuple(v or "" for v in r) for r in found.collect())
    assert got == sorted(tuple(r) for r in rows[1:])
    assert spark.read.option("lineSep", "\n").text(f"{folder}/a.csv").rdd.getNumPartitions() >= 8
    if encoding == "utf-8":
        whole = spark.read.option("multiLine", True).option("escape", '"').option("header", True).csv(f"{folder}/a.csv")
        assert sorted(map(str, whole.collect())) == sorted(map(str, found.toDF(*whole.columns).collect()))


def test_stray_quotes_blank_lines_and_folders(spark, folder, small_splits):
    pathlib.Path(folder, "a.csv").write_text('id,v\n\n1,it"s\n\n2,"two\n\nlines"\n3,5" pipe\n4,"x ""y"" z"\n')
    pathlib.Path(folder, "b.csv").write_text('\nid,v\n5,"' + "no end\n" * 40 + '"\n6,"open to the end\nof file')
    pathlib.Path(folder, "c.csv").write_text("id,v\n")
    found = delimited.read_delimited(spark, folder, ",", "UTF-8", ["id", "v"], True)
    assert sorted((r[0], r[1].strip("\n")) for r in found.collect()) == [
        ("1", 'it"s'), ("2", "two\n\nlines"), ("3", '5" pipe'), ("4", 'x "y" z'), ("5", ("no end\n" * 40).strip()), ("6", "open to the end\nof file"),
    ]


def test_no_line_is_read_by_one_task_alone(spark, folder):
    pathlib.Path(folder, "a.csv").write_text("id,v\n" + '1,"a\nb"\n' * 50)
    plan = quoted.records(spark, [f"{folder}/a.csv"], ",")._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "multiLine" not in plan


def test_the_session_keeps_its_settings(spark, folder):
    pathlib.Path(folder, "a.csv").write_bytes("id;preço €\n1;João “x”\n".encode("cp1252"))
    found = delimited.read_delimited(spark, f"{folder}/a.csv")
    assert found.columns == ["id", "preco"] and [tuple(r) for r in found.collect()] == [("1", "João “x”")]
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"
