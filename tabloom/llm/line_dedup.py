"""Boilerplate lines of web sites by their frequency relative to the site.

A line that stands on a large share of a host's pages is navigation, a banner or a notice: pages that contain it, divided by
the host's pages, is compared with a ratio.  Lines count once a page.  Of a host at most (mean lines a page / ratio) lines
can pass the ratio, so the list of boilerplate lines of a host is short however many pages it has.  Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import Scratch, bounded

RATIO = 0.3
LEAST_PAGES = 5
HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
UNSEEN = "(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
BLOCK = (
    "(?i)\\n|</?(?:p|br|div|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|td|th|table|nav|article|section|header|footer|title|head|body|html)"
    "(?:[^a-z0-9>][^>]*)?>"
)
TAG_OR_BLANKS = "<[^>]*>|[ \\t\\x0B\\f\\r]+"


def host(url: Column) -> Column:
    """Host of an address in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def lines(html: Column) -> Column:
    """Text of each block of a page, blanks folded, in order; lines without text left out."""
    parts = F.split(F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, " "), BLOCK)
    clean = F.transform(parts, lambda x: F.btrim(F.regexp_replace(x, TAG_OR_BLANKS, " "), F.lit(" ")))
    return F.array_remove(clean, "")


def boilerplate(rows: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(of_host, marks): hashes of the lines on more than ``ratio`` of the pages of hosts with ``least_pages`` pages.

    Counts are added up below the shuffle: a host or a line on a third of all pages costs one row per task.
    """
    seen = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("mark"))
    seen = seen.groupBy("host", "mark").agg(F.count(F.lit(1)).alias("pages"))
    total = rows.groupBy(F.col("host").alias("of_host")).agg(F.count(F.lit(1)).alias("all_pages")).where(
        F.col("all_pages") >= least_pages
    )
    often = seen.where(F.col("pages") > ratio * least_pages).join(total, F.col("host") == F.col("of_host"))
    often = often.where(F.col("pages") > ratio * F.col("all_pages"))
    return often.groupBy("of_host").agg(F.sort_array(F.collect_list("mark")).alias("marks"))


def without_boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row per page: page_id, host, lines (array), kept (the lines that stay).

    Pages without an address share the empty host; NULL and empty pages have no lines and count as pages of their host.
    Repeated pages count as often as they occur.  Hosts with few pages keep all.
    """
    spark = pages.sparkSession
    with Scratch(spark, "lines") as scratch:
        rows = scratch.write(pages.select("page_id", host(F.col("url")).alias("host"), lines(F.col("html")).alias("lines")), keep=True)
        marks = scratch.write(boilerplate(rows, ratio, least_pages), keep=True)
    marks = bounded(marks)
    rows = rows.join(marks, rows["host"] == marks["of_host"], "left")
    stays = F.filter("lines", lambda x: ~F.array_contains("marks", F.xxhash64(x)))
    return rows.select("page_id", "host", "lines", F.when(F.col("marks").isNull(), F.col("lines")).otherwise(stays).alias("kept"))


def report(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, host, n_lines, n_dropped, kept_sha256 (of the kept lines joined by line feeds)."""
    n, kept = F.size("lines").cast("long"), F.size("kept").cast("long")
    return without_boilerplate(pages).select(
        "page_id", "host", n.alias("n_lines"), (n - kept).alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )
