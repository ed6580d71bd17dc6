"""Reading delimited files and live sources.  The files are written from the tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.checks import Registry, frames
from tabloom.session import fresh_path
from tabloom.sources import delimited, external

registry = Registry()


@registry.query("read_delimited", frames.text_sql("lineitem"))
def read_delimited(spark, folder):
    """Line items as a semicolon file with a header, hints detected, every column text."""
    raw = frames.text_table(spark, folder, "lineitem")
    path = fresh_path(spark, "file")
    raw.write.option("sep", ";").option("header", True).option("emptyValue", "").csv(path)
    return delimited.read_delimited(spark, path)


@registry.query(
    "read_delimited_quoted", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents"
)
def read_delimited_quoted(spark, folder):
    """Texts with line breaks, separators and quotes in their values."""
    documents = frames.table(spark, folder, "documents").select(F.col("doc_id").cast("string"), "text", "lang")
    path = fresh_path(spark, "file")
    documents.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return delimited.read_delimited(
        spark, path, separator=",", encoding="UTF-8", headers=["doc_id", "text", "lang"], multiline=True, split=True
    )


@registry.query(
    "read_delimited_detected", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, text FROM documents"
)
def read_delimited_detected(spark, folder):
    """The same texts with nothing said about the files: separator, encoding and line breaks are found out."""
    documents = frames.table(spark, folder, "documents").select(F.col("doc_id").cast("string"), "lang", "source", "text")
    path = fresh_path(spark, "file")
    documents.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return delimited.read_delimited(spark, path)


@registry.query(
    "detect_separator",
    """SELECT doc_id, CASE WHEN a >= b AND a >= c THEN ';' WHEN b >= c THEN ',' ELSE chr(9) END AS separator FROM (SELECT doc_id, length(head)
 - length(replace(head, ';', '')) AS a, length(head) - length(replace(head, ',', '')) AS b, length(head) - length(replace(head, chr(9),
 '')) AS c FROM (SELECT doc_id, array_to_string(list_slice(regexp_split_to_array(text, '\\r?\\n'), 1, 10), chr(10)) AS head FROM documents)
 h) n""",
)
def detect_separator(spark, folder):
    return frames.table(spark, folder, "documents").select(
        "doc_id", delimited.separator_of(F.col("text")).alias("separator")
    )


@registry.query(
    "live_view",
    """SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_quantity > 45""",
)
def live_view(spark, folder):
    """A live source: each query reads it anew, with the query's own filters and columns pushed to the scan."""
    external.live_view(frames.table(spark, folder, "lineitem"), "live_lineitem")
    return spark.sql(
        """SELECT l_orderkey, l_linenumber, l_shipdate FROM live_lineitem
        WHERE l_shipdate >= TIMESTAMP_NTZ '2000-01-01' AND l_quantity > 45"""
    )


@registry.query(
    "profile_files",
    """SELECT lang, count(*) AS line_count, CAST(sum(CAST(('0x' || md5(line)[1:15]) AS BIGINT)) AS VARCHAR) AS sum_high,
 CAST(sum(CAST(('0x' || md5(line)[17:31]) AS BIGINT)) AS VARCHAR) AS sum_low FROM (SELECT lang, unnest(string_split(regexp_replace(text,
 '\\r\\n?', chr(10), 'g'), chr(10))) AS line FROM documents) d GROUP BY lang""",
)
def profile_files(spark, folder):
    """Texts written as files by language; the files of a language add up to its lines."""
    documents = frames.table(spark, folder, "documents")
    path = fresh_path(spark, "files")
    documents.select("lang", "text").write.partitionBy("lang").text(path)
    files = delimited.profile_files(spark, path)
    lang = F.regexp_extract("file", "lang=([^/]+)/", 1)
    return files.groupBy(lang.alias("lang")).agg(
        F.sum("line_count").alias("line_count"),
        *[F.sum(F.col(c).cast("decimal(38,0)")).cast("string").alias(c) for c in ("sum_high", "sum_low")],
    )


_TYPE_OF = {
    "view": "int4", "click": "NUMERIC(10,2)", "purchase": "timestamp with time zone", "signup": "date", "error": "uuid",
}
_CANONICAL = {"view": "BIGINT", "click": "DECIMAL(18,4)", "purchase": "DATETIME2", "signup": "DATE", "error": "NVARCHAR(MAX)"}


@registry.query(
    "canonical_listing",
    "SELECT event_id, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CANONICAL.items())
    + " END AS sql_type FROM events",
)
def canonical_listing(spark, folder):
    """Type names of a database listing, one per event, as canonical types."""
    names = F.create_map(*[F.lit(x) for pair in _TYPE_OF.items() for x in pair])
    return frames.table(spark, folder, "events").select(
        "event_id", external.canonical_type(names[F.col("event_type")]).alias("sql_type")
    )
