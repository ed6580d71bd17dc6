import datetime
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom import types as hub
from tabloom.functions import dates, dialect, display, hashing, moments, text
from tabloom.functions.convert import convert, convert_source
from tabloom.operators.mapping import apply_mapping, conversion_rejects, reject_counts
from tabloom.types import ColumnSpec

D, TS = datetime.date, datetime.datetime

CASES = [
    (hub.DECIMAL, "123.45", Decimal("123.4500")),
    (hub.DECIMAL, "1.234,56", Decimal("1234.5600")),
    (hub.DECIMAL, "123,45", Decimal("123.4500")),
    (hub.DECIMAL, "1,234.56", Decimal("1234.5600")),
    (hub.DECIMAL, "999,90", Decimal("999.9000")),
    (hub.DECIMAL, "12abc", None),
    (hub.DECIMAL, "100000000000000", None),
    (hub.DECIMAL, "99999999999999,9999", Decimal("99999999999999.9999")),
    (hub.DECIMAL, " ", None),
    (hub.BIGINT, " -12 ", -12),
    (hub.BIGINT, "9223372036854775808", None),
    (hub.BIGINT, "1.5", None),
    (hub.BIGINT, "", None),
    (hub.DATE, "04/05/2026", D(2026, 5, 4)),
    (hub.DATE, "12/31/2024", D(2024, 12, 31)),
    (hub.DATE, "31/31/2024", None),
    (hub.DATE, "2024-02-30", None),
    (hub.DATE, "2024-02-29T10:00:00Z", D(2024, 2, 29)),
    (hub.DATETIME, "12/02/2024 12:30:01", TS(2024, 2, 12, 12, 30, 1)),
    (hub.DATETIME, "15/01/2026 08:30", TS(2026, 1, 15, 8, 30)),
    (hub.DATETIME, "2026-01-16T08:30:00.1239+03:00", TS(2026, 1, 16, 8, 30, 0, 123000)),
    (hub.DATETIME, "2026-01-16", TS(2026, 1, 16)),
    (hub.DATETIME, "2026-01-16 25:00:00", None),
    (hub.TIME, "8:30", "08:30:00"),
    (hub.TIME, "24:30", None),
    (hub.TIME, "23:59:10", "23:59:10"),
    (hub.TEXT, "a\r\nb\x00c\x07\td", "a  bc d"),
    (hub.TEXT, "  ", None),
    (hub.TEXT, " a ", " a "),
    (hub.TEXT, "x" * 10_000, "x" * 10_000),
]


@pytest.mark.parametrize(("sql_type", "value", "expected"), CASES)
def test_conversion(text_rows, sql_type, value, expected):
    row = text_rows(["v"], [(value,)]).select(convert(F.col("v"), sql_type).alias("c")).first()
    assert row.c == expected


def test_hash_fields(text_rows):
    def field(value):
        return text_rows(["v"], [(value,)]).select(hashing.hash_field(F.col("v")).alias("c")).first().c

    assert field("01234") == '"01234"'
    assert field(None) == field("") == field("   ") == '""'
    assert field("a|b|c") == '"a b c"'
    assert field("a\nb\tc") == '"a b c"'
    assert field('2"') == '"2"""'


def test_row_hash_depends_on_order(text_rows):
    df = text_rows(["a", "b"], [("1", "2")])
    one, two = df.select(hashing.row_hash([F.col("a"), F.col("b")]), hashing.row_hash([F.col("b"), F.col("a")])).first()
    assert one != two and len(one) == 32 and one == one.lower()


def test_excel_serials(text_rows):
    df = text_rows(["v"], [("45000",), ("45000.5",), ("100001",), ("x",), ("0",)])
    out = [r.c for r in df.select(dates.excel_serial(F.col("v"), hub.DATETIME).alias("c")).collect()]
    assert out == ["2023-03-15T00:00:00.000Z", "2023-03-15T12:00:00.000Z", "100001", "x", "0"]
    assert df.select(dates.excel_serial(F.col("v"), hub.DATE).alias("c")).first().c == "2023-03-15"


def test_mapping_renames_and_orders(text_rows):
    df = text_rows(["A b", "C"], [("1", "2,5")])
    out = apply_mapping(df, [ColumnSpec("C", "c", hub.DECIMAL), ColumnSpec("A b", "a_b", hub.BIGINT)], with_hash=True)
    assert out.columns == ["c", "a_b", "row_hash"]
    assert out.first().c == Decimal("2.5") and out.schema["c"].metadata["original_name"] == "C"
    with pytest.raises(ValueError):
        apply_mapping(df, [])


def test_rejects_are_listed(text_rows):
    df = text_rows(["line", "v"], [("1", "10"), ("2", "x"), ("3", " "), ("4", "y")])
    rejects = conversion_rejects(df, [ColumnSpec("v", "v", hub.BIGINT)], "line")
    assert sorted(r.line for r in rejects.collect()) == ["2", "4"]
    assert reject_counts(rejects).first().rejects == 2


def test_source_values(spark):
    df = spark.createDataFrame([(1e15, float("nan"), [1, 2])], "big double, odd double, list array<int>")
    row = df.select(*[convert_source(df[f.name], f.dataType).alias(f.name) for f in df.schema.fields]).first()
    assert (row.big, row.odd, row.list) == (None, None, "[1,2]")


def test_display(spark):
    def shown(expression):
        return spark.range(1).select(expression.alias("c")).first().c

    assert [shown(display.size_text(F.lit(n))) for n in (0, 12, 1536, 5 * 1024**3)] == [
        "0 B", "12 B", "1.5 KB", "5.0 GB",
    ]
    assert [shown(display.duration_text(F.lit(n))) for n in (250, 12_500, 184_000, 7_500_000)] == [
        "250ms", "12s", "3m 4s", "2h 5m",
    ]
    assert shown(display.time_cell(F.lit("1970-01-01T08:30:00.000Z"))) == "08:30:00"
    assert shown(display.time_cell(F.lit("1971-01-01T08:30:00.000Z"))) == "1971-01-01T08:30:00.000Z"
    assert shown(display.feed_value(F.lit(math.inf), T.DoubleType())) == "INF"
    moment = F.lit("2024-01-31 10:00:00").cast("timestamp_ntz")
    assert shown(display.age_text(moment, F.lit("2024-01-31 10:05:00").cast("timestamp_ntz"))) == "há 5 min"
    assert shown(dialect.date_add("qq", F.lit(1), moment)) == TS(2024, 4, 30, 10)
    assert shown(dialect.date_diff("month", moment, F.lit("2024-03-31").cast("timestamp_ntz"))) == 1
    assert shown(dialect.char_index("b", F.lit("abcb"), 3)) == 4
    assert shown(dialect.choose(F.lit(3), F.lit("a"), F.lit("b"))) is None


def test_slugs_of_values(text_rows):
    df = text_rows(["v"], [("Recursos Humanos & Gestão",), ("***",), ("ab" * 80,)])
    out = [r.c for r in df.select(text.slug(F.col("v")).alias("c")).collect()]
    assert out[:2] == ["recursos-humanos-gestao", None]
    assert len(out[2]) == 100


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo", "Asia/Kolkata"])
def test_moments_ignore_the_session_zone(spark, zone):
    """A quarter of an hour that summer time skips in one of the zones."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([("2018-11-04 00:15:00.5",)], "s string").select(
            F.col("s").cast("timestamp_ntz").alias("t")
        )
        row = df.select(
            moments.unix_micros(F.col("t")).alias("micros"),
            moments.iso_millis(F.col("t")).alias("iso"),
            moments.from_micros(moments.unix_micros(F.col("t"))).cast("string").alias("back"),
            dates.excel_serial(F.lit("43408.25"), hub.DATETIME).alias("serial"),
        ).first()
        assert tuple(row) == (
            1541290500500000, "2018-11-04T00:15:00.500Z", "2018-11-04 00:15:00.5", "2018-11-04T06:00:00.000Z",
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
