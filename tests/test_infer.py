"""What type a column of text gets."""

import pytest
from pyspark.sql import functions as F

from tabloom import types as hub
from tabloom.checks import profiles
from tabloom.operators.profile import column_stats, infer_mapping, merged_stats, native_mapping, part_profiles, preview
from tabloom.session import materialize

CASES = [
    ("inteiro", ["10"], hub.BIGINT),
    ("decimal_br", ["1.234,56"], hub.DECIMAL),
    ("decimal_us", ["123.45"], hub.DECIMAL),
    ("data", ["2026-05-04"], hub.DATE),
    ("valor", ["1234,56", "99,90", "0,50"], hub.DECIMAL),
    ("valor", ["1", "1,5", "3"], hub.DECIMAL),
    ("valor", ["10,50", "abc", "20,00"], hub.TEXT),
    ("valor", ["1,234.56"], hub.TEXT),
    ("ts", ["2026-01-15", "2026-01-16T08:30:00"], hub.DATETIME),
    ("dt", ["2026-01-15", "2026-06-20"], hub.DATE),
    ("dt", ["2026-01-15", "sem data"], hub.TEXT),
    ("dt", ["12/31/2024", "01/15/2025"], hub.DATE),
    ("dt", ["31/31/2024"], hub.TEXT),
    ("dt", ["2024-02-30"], hub.TEXT),
    ("status", ["2026-04-10 17:20:56.3870 - USER - Aprovado"], hub.TEXT),
    ("hora", ["08:30", "14:45:00", "23:59"], hub.TIME),
    ("cnpj", ["12.345.678/0001-90"], hub.TEXT),
    ("cep", ["01310-000"], hub.TEXT),
    ("numero", ["00123"], hub.TEXT),
    ("codigo", ["123"], hub.TEXT),
    ("vazio", ["", " ", None], hub.TEXT),
    ("inteiro", ["1", "", " 2 ", None], hub.BIGINT),
    ("inteiro", ["-5", "0", "7"], hub.BIGINT),
]


@pytest.mark.parametrize(("header", "values", "expected"), CASES)
def test_inferred_type(text_rows, header, values, expected):
    assert infer_mapping(text_rows([header], [(v,) for v in values]))[0].sql_type == expected


def test_all_rows_count(spark):
    """One decimal after fifty thousand whole numbers, five texts after five thousand."""
    late = spark.range(50_004, numPartitions=4).selectExpr("case when id = 50002 then '850,5' else '0' end as quantidade")
    assert infer_mapping(late)[0].sql_type == hub.DECIMAL
    mixed = spark.range(5_005, numPartitions=4).selectExpr("case when id >= 5000 then 'x' else '1' end as quantidade")
    assert infer_mapping(mixed)[0].sql_type == hub.TEXT


def test_stats_of_one_column(text_rows):
    row = column_stats(text_rows(["v"], [("  12 ",), ("",), (None,), ("123456",)])).first().asDict()
    assert row == {
        "ordinal": 1, "column_name": "v", "sample_count": 2, "has_null": True, "max_len": 6, "all_int": True,
        "all_decimal": True, "all_date": False, "has_time": False, "all_time": False, "looks_identifier": False,
    }


def test_names_come_from_headers(text_rows):
    mapping = infer_mapping(text_rows(["Valor Total", "Descrição"], [("1", "a")]))
    assert [c.sql_name for c in mapping] == ["valor_total", "descricao"]


def test_native_types(table):
    kinds = {c.sql_name: c.sql_type for c in native_mapping(table("orders"))}
    assert kinds["o_orderkey"] == hub.BIGINT
    assert kinds["o_totalprice"] == hub.DECIMAL
    assert kinds["o_orderdate"] == hub.DATETIME


def test_preview_is_the_first_rows(table):
    keys = [r.o_orderkey for r in preview(table("orders"), ["o_orderkey"], 5).collect()]
    assert keys == sorted(keys) and len(keys) == 5


def test_profiles_of_parts_merge_into_the_profile_of_all(text_rows):
    rows = [("a", "12", None, "2024-01-01"), ("a", "x", None, ""), ("b", "7", "1,5", "2024-01-01 10:00:00"), ("c", None, None, "10:30"),
            ("c", None, "", None), (None, "100", "3", "2024-02-30")]
    df = text_rows(["part", "n", "d", "at"], rows)
    body = df.select("n", "d", "at")
    profiles = part_profiles(df, F.col("part")).where("column_name <> 'part'")
    assert profiles.count() == 4 * 3
    by_ordinal = lambda stats: [tuple(r) for r in stats.orderBy("ordinal").collect()]
    assert by_ordinal(merged_stats(profiles, body.columns)) == by_ordinal(column_stats(body))
    assert by_ordinal(merged_stats(profiles.where("false"), body.columns)) == by_ordinal(column_stats(body.where("false")))
    old = part_profiles(df.where("part = 'a'").select("part", "n"), F.col("part"))  # this file lacks two columns
    new = part_profiles(df.where("part <> 'a'"), F.col("part"))
    lacking = text_rows(["n", "d", "at"], [(r[1], None, None) if r[0] == "a" else r[1:] for r in rows if r[0]])
    assert by_ordinal(merged_stats(old.unionByName(new), body.columns)) == by_ordinal(column_stats(lacking))


def test_files_that_arrive_grow_in_number_not_in_size(spark, monkeypatch):
    sizes = []

    def files_of(rows, label):
        sizes.append([r["count"] for r in rows.groupBy(F.spark_partition_id().alias("file")).count().collect()])
        return materialize(rows, label)

    monkeypatch.setattr(profiles, "materialize", files_of)
    monkeypatch.setattr(profiles, "FILE_ROWS", 300)
    profiles.profiles_merged(spark, "/root/testdata/sf0.001")
    lines, events = sizes
    assert len(lines) == -(-sum(lines) // 300) > 8 and max(lines) <= 600 and len(events) == 8
