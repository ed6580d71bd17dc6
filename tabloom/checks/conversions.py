"""Text to canonical types and back to display text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom import types as hub
from tabloom.checks import Registry, frames
from tabloom.functions import convert, dates, dialect, display, hashing, text
from tabloom.operators import mapping as mapped
from tabloom.operators import profile
from tabloom.types import ColumnSpec

registry = Registry()


def _mixed(spark, folder):
    """Values of many kinds, one per row, from whole columns of several tables."""
    orders = frames.table(spark, folder, "orders")
    number = F.format_number("o_totalprice", 2)
    styles = {
        "plain": F.col("o_orderkey").cast("string"),
        "padded": F.concat(F.lit(" \t"), F.col("o_custkey").cast("string"), F.lit("  ")),
        "negative": F.concat(F.lit("-"), F.col("o_orderkey").cast("string")),
        "huge": F.concat(F.lit("92233720368547"), F.lpad(F.col("o_orderkey").cast("string"), 6, "7")),
        "br": F.translate(number, ",.", ".,"),
        "us": number,
        "word": F.col("o_orderpriority"),
        "tail": F.concat(F.col("o_orderkey").cast("string"), F.lit("abc")),
        "blank": F.lit("   "),
        "iso": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "day_first": F.date_format("o_orderdate", "d/M/yyyy"),
        "month_first": F.date_format("o_orderdate", "MM/dd/yyyy HH:mm"),
        "zoned": F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T08:30:15.1239+03:00")),
        "no_day": F.concat(F.lit("31/"), F.date_format("o_orderdate", "MM/yyyy")),
        "clock": F.concat(F.col("o_custkey") % 30, F.lit(":"), F.lpad((F.col("o_orderkey") % 70).cast("string"), 2, "0")),
        "clock_seconds": F.concat(F.lpad((F.col("o_custkey") % 24).cast("string"), 2, "0"), F.lit(":05:59")),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("style"), v.cast("string").alias("raw")) for k, v in styles.items()])
    return orders.select("o_orderkey", F.inline(pairs))


_NUMBER = "format('{:,.2f}', o_totalprice)"
_STYLES_SQL = {
    "plain": "CAST(o_orderkey AS VARCHAR)",
    "padded": "' ' || chr(9) || o_custkey || '  '",
    "negative": "'-' || o_orderkey",
    "huge": "'92233720368547' || lpad(CAST(o_orderkey AS VARCHAR), 6, '7')",
    "br": f"translate({_NUMBER}, ',.', '.,')",
    "us": _NUMBER,
    "word": "o_orderpriority",
    "tail": "o_orderkey || 'abc'",
    "blank": "'   '",
    "iso": "strftime(o_orderdate, '%Y-%m-%d')",
    "day_first": "strftime(o_orderdate, '%-d/%-m/%Y')",
    "month_first": "strftime(o_orderdate, '%m/%d/%Y %H:%M')",
    "zoned": "strftime(o_orderdate, '%Y-%m-%d') || 'T08:30:15.1239+03:00'",
    "no_day": "'31/' || strftime(o_orderdate, '%m/%Y')",
    "clock": "(o_custkey % 30) || ':' || lpad(CAST(o_orderkey % 70 AS VARCHAR), 2, '0')",
    "clock_seconds": "lpad(CAST(o_custkey % 24 AS VARCHAR), 2, '0') || ':05:59'",
}
_MIXED_SQL = "mixed AS (SELECT o_orderkey, style, raw, trim(raw, ' ' || chr(9)) AS t FROM (" + " UNION ALL ".join(
    f"SELECT o_orderkey, '{k}' AS style, {v} AS raw FROM orders" for k, v in _STYLES_SQL.items()
) + ") s)"

_TAIL = r"(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?"


def date_sql(t: str) -> str:
    """Date of a trimmed text: the month comes first only if the first number can be one and the second cannot."""
    a, b = f"CAST(split_part({t}, '/', 1) AS INT)", f"CAST(split_part({t}, '/', 2) AS INT)"
    y = f"split_part({t}, '/', 3)[1:4]"
    return f"""CASE WHEN regexp_full_match({t}, '\\d{{4}}-\\d{{2}}-\\d{{2}}{_TAIL}') AND {t}[1:2] <> '00'
 THEN TRY_CAST({t}[1:10] AS DATE) WHEN regexp_full_match({t}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}{_TAIL}') AND {y}[1:2] <> '00'
 THEN CASE WHEN {a} <= 12 AND {b} > 12 THEN TRY_CAST({y} || '-' || {a} || '-' || {b} AS DATE)
 ELSE TRY_CAST({y} || '-' || {b} || '-' || {a} AS DATE) END END"""


def _convert_query(name: str, sql_type: str, sql: str) -> None:
    @registry.query(name, f"WITH {_MIXED_SQL} SELECT o_orderkey, style, {sql} AS converted FROM mixed")
    def build(spark, folder):
        mixed = _mixed(spark, folder)
        converted = convert.convert(F.col("raw"), sql_type)
        out = frames.shown(mixed.select("o_orderkey", "style", converted.alias("converted")))
        return frames.as_text(out, "converted") if sql_type == hub.BIGINT else out


_convert_query(
    "convert_bigint", hub.BIGINT, "CAST(CASE WHEN regexp_full_match(t, '-?\\d+') THEN TRY_CAST(t AS BIGINT) END AS VARCHAR)"
)
_convert_query(
    "convert_decimal",
    hub.DECIMAL,
    """CAST(TRY_CAST(CASE WHEN instr(reverse(t), ',') > 0 AND (instr(reverse(t), '.') = 0 OR instr(reverse(t), ',') <
 instr(reverse(t), '.')) THEN replace(replace(t, '.', ''), ',', '.') ELSE replace(t, ',', '') END AS DECIMAL(18,4)) AS DOUBLE)""",
)
_convert_query("convert_date", hub.DATE, f"CAST(({date_sql('t')}) AS VARCHAR)")
_convert_query(
    "convert_datetime",
    hub.DATETIME,
    f"""TRY_CAST(({date_sql('t')}) || ' ' || CASE WHEN regexp_extract(t, '[T ](\\d{{2}}:\\d{{2}})', 1) = '' THEN '00:00:00'
 WHEN regexp_extract(t, '[T ](\\d{{2}}:\\d{{2}}:\\d{{2}}(?:\\.\\d{{1,3}})?)', 1) = '' THEN
 regexp_extract(t, '[T ](\\d{{2}}:\\d{{2}})', 1) || ':00'
 ELSE regexp_extract(t, '[T ](\\d{{2}}:\\d{{2}}:\\d{{2}}(?:\\.\\d{{1,3}})?)', 1) END AS TIMESTAMP)""",
)
_convert_query(
    "convert_time",
    hub.TIME,
    """CASE WHEN regexp_full_match(t, '\\d{1,2}:\\d{2}(:\\d{2})?') THEN CASE WHEN CAST(split_part(t, ':', 1) AS INT) <= 23 AND
 CAST(split_part(t, ':', 2) AS INT) <= 59 AND (split_part(t, ':', 3) = '' OR split_part(t, ':', 3) <= '59') THEN
 lpad(split_part(t, ':', 1), 2, '0') || ':' || split_part(t, ':', 2) || ':' || CASE split_part(t, ':', 3) WHEN '' THEN '00'
 ELSE split_part(t, ':', 3) END END END""",
)


@registry.query(
    "convert_text",
    f"""SELECT doc_id, CASE WHEN text IS NULL OR {frames.blank_sql('text')} THEN NULL ELSE regexp_replace(regexp_replace(text,
 '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '[\\n\\r\\t]', ' ', 'g') END AS converted FROM documents""",
)
def convert_text(spark, folder):
    return frames.table(spark, folder, "documents").select("doc_id", convert.to_text(F.col("text")).alias("converted"))


@registry.query(
    "normalize_date",
    f"""WITH {_MIXED_SQL} SELECT o_orderkey, style, CAST(({date_sql('t')}) AS VARCHAR) || regexp_extract(t, '{_TAIL}$') AS
 normalized FROM mixed""",
)
def normalize_date(spark, folder):
    return _mixed(spark, folder).select(
        "o_orderkey", "style", dates.normalize_date(F.col("raw")).alias("normalized")
    )


@registry.query(
    "excel_serial_date",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d') || 'T06:00:00.000Z' AS
 moment, o_orderpriority AS other FROM orders""",
)
def excel_serial_date(spark, folder):
    orders = frames.table(spark, folder, "orders")
    serial = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")).cast("string")
    return orders.select(
        "o_orderkey",
        dates.excel_serial(serial, hub.DATE).alias("day"),
        dates.excel_serial(F.concat(serial, F.lit(".25")), hub.DATETIME).alias("moment"),
        dates.excel_serial(F.col("o_orderpriority"), hub.DATE).alias("other"),
    )


@registry.query("apply_mapping", frames.typed_sql("lineitem"))
def apply_mapping(spark, folder):
    raw = frames.text_table(spark, folder, "lineitem")
    return frames.shown(mapped.apply_mapping(raw, profile.infer_mapping(raw)))


_REJECT_COLUMNS = {"raw": hub.DATE, "style": hub.BIGINT}


@registry.query(
    "conversion_rejects",
    f"""WITH {_MIXED_SQL} SELECT column_name, sql_type, count(*) AS rejects, min(value) AS first_value FROM (
 SELECT 'raw' AS column_name, 'DATE' AS sql_type, raw[1:180] AS value FROM mixed WHERE t <> '' AND ({date_sql('t')}) IS NULL
 UNION ALL SELECT 'style', 'BIGINT', style FROM mixed) r GROUP BY column_name, sql_type""",
)
def conversion_rejects(spark, folder):
    specs = [ColumnSpec(c, c, t) for c, t in _REJECT_COLUMNS.items()]
    rejects = mapped.conversion_rejects(_mixed(spark, folder), specs, "o_orderkey")
    return rejects.groupBy("column_name", "sql_type").agg(
        F.count(F.lit(1)).alias("rejects"), F.min("value").alias("first_value")
    )


@registry.query(
    "format_time_cells",
    """SELECT event_id, strftime(ts, '%H:%M:%S') AS clock, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS other FROM events""",
)
def format_time_cells(spark, folder):
    events = frames.table(spark, folder, "events")
    clock = F.concat(F.lit("1970-01-01T"), F.date_format("ts", "HH:mm:ss"), F.lit(".000Z"))
    full = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z"))
    return events.select("event_id", display.time_cell(clock).alias("clock"), display.time_cell(full).alias("other"))


@registry.query(
    "format_sizes",
    """SELECT doc_id, CASE WHEN n = 0 THEN '0 B' WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 1024.0::DOUBLE * 10 + 0.5) / 10)
 ELSE printf('%.1f MB', floor(n / 1048576.0::DOUBLE * 10 + 0.5) / 10) END AS size, CASE WHEN n < 1000 THEN n || 'ms' WHEN n < 60000 THEN (n // 1000) || 's'
 WHEN n < 3600000 THEN (n // 60000) || 'm ' || (n // 1000 % 60) || 's' ELSE (n // 3600000) || 'h ' || (n // 60000 % 60) || 'm' END
 AS duration FROM (SELECT doc_id, n_chars * 37 AS n FROM documents) d""",
)
def format_sizes(spark, folder):
    size = F.col("n_chars") * 37
    return frames.table(spark, folder, "documents").select(
        "doc_id", display.size_text(size).alias("size"), display.duration_text(size).alias("duration")
    )


@registry.query(
    "format_ages",
    f"""SELECT event_id, CASE WHEN m < 1 THEN 'agora' WHEN m < 60 THEN 'há ' || m || ' min' WHEN m < 1440 THEN 'há ' || (m // 60) ||
 'h' ELSE 'há ' || (m // 1440) || 'd' END AS age FROM (SELECT event_id, (epoch_us({frames.LAST_MOMENT_SQL}) - epoch_us(ts)) //
 60000000 AS m FROM events) e""",
)
def format_ages(spark, folder):
    events = frames.table(spark, folder, "events")
    return events.select("event_id", display.age_text(F.col("ts"), frames.last_moment(spark, folder)).alias("age"))


@registry.query(
    "row_hash",
    "SELECT 'documents' AS table_name, doc_id AS id, " + frames.hash_sql(["text", "lang", "source"]) + """ AS row_hash FROM documents
 UNION ALL SELECT 'orders' AS table_name, CAST(replace(o_orderkey, '.', '') AS BIGINT) AS id, """
    + frames.hash_sql([c for c, _ in frames.columns_of("orders")]) + f" AS row_hash FROM ({frames.text_sql('orders')}) o",
)
def row_hash(spark, folder):
    documents = frames.table(spark, folder, "documents").select(
        F.lit("documents").alias("table_name"),
        F.col("doc_id").alias("id"),
        hashing.row_hash([F.col(c) for c in ("text", "lang", "source")]).alias("row_hash"),
    )
    orders = frames.text_table(spark, folder, "orders")
    return documents.unionByName(
        orders.select(
            F.lit("orders").alias("table_name"),
            F.col("o_orderkey").cast("bigint").alias("id"),
            hashing.row_hash([F.col(c) for c in orders.columns]).alias("row_hash"),
        )
    )


@registry.query(
    "slugify_values",
    """SELECT doc_id, nullif(CASE WHEN length(s) > 100 THEN s[1:89] || '_' || sha256(s)[1:10] ELSE s END, '') AS slug FROM (SELECT
 doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM documents) d""",
)
def slugify_values(spark, folder):
    return frames.table(spark, folder, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


# --- functions users know from their databases ------------------------------------------------------------------


@registry.query(
    "fn_null",
    """SELECT s_suppkey, coalesce(CASE WHEN s_acctbal > 1000 THEN s_name END, 'none') AS name FROM supplier""",
)
def fn_null(spark, folder):
    named = F.when(F.col("s_acctbal") > 1000, F.col("s_name"))
    return frames.table(spark, folder, "supplier").select(
        "s_suppkey", dialect.is_null(named, F.lit("none")).alias("name")
    )


@registry.query(
    "fn_string",
    """SELECT p_partkey, length(p_name || '  ') AS len, instr(p_name, 'e') AS first_e, CASE WHEN instr(p_name[4:], 'e') = 0 THEN 0
 ELSE instr(p_name[4:], 'e') + 3 END AS later_e, CAST(p_size AS VARCHAR) AS size, CASE p_size % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b'
 WHEN 2 THEN 'c' END AS choice FROM part""",
)
def fn_string(spark, folder):
    name = F.col("p_name")
    return frames.table(spark, folder, "part").select(
        "p_partkey",
        dialect.text_length(F.concat(name, F.lit("  "))).cast("bigint").alias("len"),
        dialect.char_index("e", name).cast("bigint").alias("first_e"),
        dialect.char_index("e", name, 4).cast("bigint").alias("later_e"),
        dialect.to_str(F.col("p_size")).alias("size"),
        dialect.choose(F.col("p_size") % 5 + 1, F.lit("a"), F.lit("b"), F.lit("c")).alias("choice"),
    )


@registry.query(
    "fn_cast",
    """SELECT o_orderkey, TRY_CAST(o_totalprice AS DECIMAL(8,2))::DOUBLE AS narrow, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
 CASE WHEN regexp_full_match(o_orderpriority[1:1], '\\d') THEN CAST(o_orderpriority[1:1] AS INT) END AS rank,
 CAST(TRY_CAST(o_orderpriority AS INT) AS VARCHAR) AS nothing FROM orders""",
)
def fn_cast(spark, folder):
    orders = frames.table(spark, folder, "orders")
    converted = frames.shown(
        orders.select(
            "o_orderkey",
            dialect.try_convert("decimal(8,2)", F.col("o_totalprice")).alias("narrow"),
            dialect.try_convert("date", F.col("o_orderdate")).alias("day"),
            dialect.try_convert("int", F.substring("o_orderpriority", 1, 1)).alias("rank"),
            dialect.try_convert("int", F.col("o_orderpriority")).alias("nothing"),
        )
    )
    return frames.as_text(converted, "nothing")


_PARTS = ("year", "qq", "mm", "ww", "dy", "hh", "mi", "ss", "ms")


@registry.query(
    "fn_datediff",
    "SELECT event_id, "
    + ", ".join(
        f"CAST(floor((epoch_us(TIMESTAMP '2025-03-01 12:30:00') - epoch_us(ts)) / {dialect.PART_MICROS[dialect.date_part_name(p)]}.0) "
        f"AS BIGINT) AS {p}" for p in _PARTS
    )
    + " FROM events",
)
def fn_datediff(spark, folder):
    end = F.lit("2025-03-01 12:30:00").cast("timestamp_ntz")
    return frames.table(spark, folder, "events").select(
        "event_id", *[dialect.date_diff(p, F.col("ts"), end).alias(p) for p in _PARTS]
    )


@registry.query(
    "fn_dateadd",
    """SELECT event_id, ts + to_years(CAST(user_id AS INT) % 5) AS yy, ts + to_months(CAST(user_id AS INT) * 3) AS quarter,
 ts + to_months(CAST(user_id AS INT)) AS m, ts + to_days(CAST(user_id AS INT) * 7) AS week, ts + to_days(CAST(user_id AS INT)) AS dd,
 ts + to_hours(user_id) AS hh, ts + to_minutes(-user_id) AS n, ts + to_seconds(user_id) AS s, ts + to_milliseconds(user_id) AS ms
 FROM events""",
)
def fn_dateadd(spark, folder):
    user, moment = F.col("user_id"), F.col("ts")
    parts = {"yy": user % 5, "quarter": user, "m": user, "week": user, "dd": user, "hh": user, "n": -user, "s": user, "ms": user}
    return frames.table(spark, folder, "events").select(
        "event_id", *[dialect.date_add(p, n, moment).alias(p) for p, n in parts.items()]
    )
