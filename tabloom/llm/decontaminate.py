"""Benchmark decontamination: a broadcast hash set of benchmark windows against every window of every document.

Only DataFrame functions.  A window is ten consecutive normalised words of an item, or the whole item if it is shorter.  Each
document position is hashed once per window length that the benchmark has, looked up in the hash set, and a hit is verified
word by word.  What follows the lookup is as large as the hits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.llm.common import Scratch, bounded, lower_ascii, packed

WINDOW = 10
# Windows that one pass broadcasts (some 200 bytes each in memory); a larger benchmark takes several passes.
PASS_WINDOWS = 200_000
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
CASED_BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
CASED_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; none of NULL."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _key(documents: DataFrame) -> list[Column]:
    """What tells documents apart: id and text.  Rows that agree in both have the same answer."""
    return [F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"), F.octet_length("text").alias("octets")]


KEY = ["id", "digest", "octets"]


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, window): every window of every item, with its number of words."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    return items.select("item_id", "w", F.explode(starts).alias("at")).select(
        "item_id", F.least(F.size("w"), F.lit(WINDOW)).alias("n"), F.slice("w", F.col("at"), F.lit(WINDOW)).alias("window")
    )


def index(benchmark: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(hash, n, window, items_key) with one row per distinct window, and (items_key, items) with the items that share
    windows in the same way.  Items without an id mark words and are not counted."""
    found = item_windows(benchmark).groupBy("n", "window").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = scratch.write(found.select(F.xxhash64("window").alias("hash"), "n", "window",
                                       F.sha2(F.to_json("items"), 256).alias("items_key"), "items"))
    return found.drop("items"), found.groupBy("items_key").agg(F.first("items").alias("items"))


def hits(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, digest, octets, n_words, start, end, items_key, n_rows): every hit of a window, and for each document a row
    without one (``start`` NULL), whose ``n_rows`` counts its repeated rows."""
    facts = windows.agg(F.count(F.lit(1)).alias("windows"), F.collect_set("n").alias("lengths")).first()
    lengths = sorted(facts["lengths"]) or [WINDOW]
    passes = max(1, math.ceil(facts["windows"] / PASS_WINDOWS))
    out = []
    for part in range(passes):
        # outer: a document without any window keeps a row, and nothing is evaluated twice to filter it out first
        at = F.explode_outer(F.when(F.size("w") >= lengths[0], F.sequence(F.lit(0), F.size("w") - lengths[0])))
        rows = documents.select(*_key(documents), words(F.col("text")).alias("w")).select(*KEY, "w", at.alias("at"))
        if len(lengths) == 1:
            rows = rows.withColumn("n", F.lit(lengths[0]))
        else:
            rows = rows.withColumn("n", F.explode(F.array(*[F.lit(n) for n in lengths])))
        piece = F.slice("w", F.col("at") + 1, F.col("n"))
        rows = rows.select(*KEY, F.size("w").alias("n_words"), "at", "n", "w",
                           F.when(F.col("at") + F.col("n") <= F.size("w"), F.xxhash64(piece)).alias("probe"))
        wanted = windows if passes == 1 else windows.where(F.pmod("hash", F.lit(passes)) == part)
        known = F.broadcast(wanted.select(F.col("hash"), F.col("n").alias("wn"), "window", "items_key"))
        first = (F.col("at").isNull() | (F.col("at") == 0)) & (F.col("n") == lengths[0])
        # one long is the key of the hash set; the words are compared where it matches
        rows = rows.join(known, rows["probe"] == known["hash"], "left").where(first | F.col("hash").isNotNull())
        hit = F.coalesce((F.col("n") == F.col("wn")) & (F.slice("w", F.col("at") + 1, F.col("n")) == F.col("window")), F.lit(False))
        out.append(rows.select(*KEY, "n_words", F.when(hit, F.col("at")).alias("start"),
                               F.when(hit, F.col("at") + F.col("n")).alias("end"),
                               F.when(hit, F.col("items_key")).alias("items_key"),
                               (first if part == 0 else F.lit(False)).cast("int").alias("is_first")))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(*KEY, "n_words", "start", "end", "items_key").agg(F.sum("is_first").alias("n_rows"))


def covered(found: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit (words inside any hit), the keys of its item lists, its repeated rows and its spans."""
    before = F.max("end").over(W.partitionBy(*KEY).orderBy("start", "end", "items_key").rowsBetween(W.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("before", F.lit(0))))
    return found.withColumn("before", before).groupBy(*KEY, "n_words").agg(
        F.coalesce(F.sum(new), F.lit(0)).alias("n_hit"),
        F.collect_set("items_key").alias("keys"),
        F.sum("n_rows").alias("n_rows"),
        F.array_sort(F.collect_list(F.when(new > 0, F.struct("start", "end")))).alias("spans"),
    )


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    NULL, empty and wordless texts have no words and no hits; so has everything when the benchmark is empty.  Benchmark rows
    may repeat; an item of several texts has the windows of each.  Repeated documents have one result row each.
    """
    with Scratch(documents.sparkSession, "decontaminate") as scratch:
        windows, lists = index(benchmark, scratch)
        per = scratch.write(covered(hits(documents, windows)).drop("spans"))
        items = per.select(*KEY, F.explode("keys").alias("items_key")).join(lists, "items_key").groupBy(*KEY).agg(
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
        )
        items = items.select(*[F.col(c).alias(f"of_{c}") for c in KEY], F.array_sort(F.col("items").cast("array<string>")).alias("items"))
        match = [per[c].eqNullSafe(items[f"of_{c}"]) for c in KEY]
        names = F.coalesce("items", F.array().cast("array<string>"))
        out = per.where("n_hit = 0").withColumn("items", F.lit(None).cast("array<string>")).unionByName(
            per.where("n_hit > 0").join(items, match, "left").select(per["*"], "items")
        )
        return scratch.write(
            out.select("id", "n_words", "n_hit", "n_rows", names.alias("items"))
            .select(F.col("id").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"),
                    F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
                    F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))).alias("copy"))
            .drop("copy"),
            keep=True,
        )


def _without(text: Column, spans: Column) -> Column:
    """A text without the words in the spans and the separators between them."""
    kept = F.coalesce(text, F.lit(""))
    gaps, tokens = F.split(kept, CASED_WORD), F.array_remove(F.split(kept, CASED_BETWEEN), "")
    inside = lambda i, s: (i >= s["start"]) & (i < s["end"])
    pieces = F.transform(
        F.arrays_zip(gaps.alias("gap"), tokens.alias("token")),
        lambda x, i: F.when(F.exists(spans, lambda s: inside(i, s)), F.when(F.exists(spans, lambda s: i == s["start"]), x["gap"])
                            .otherwise("")).otherwise(F.concat(x["gap"], F.coalesce(x["token"], F.lit("")))),
    )
    return F.array_join(pieces, "")


def clean(documents: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """The documents, all columns, without contaminated ones, or (``remove="spans"``) without their hit words.

    Clean documents and those with NULL or empty texts stay as they are.  Hits are judged on the input: words that only
    meet once others are gone do not count.
    """
    spark = documents.sparkSession
    with Scratch(spark, "decontaminate") as scratch:
        windows, _ = index(benchmark, scratch)
        found = covered(hits(documents, windows)).where("n_hit > 0")
        found = scratch.write(found.select(*[F.col(c).alias(f"of_{c}") for c in KEY], "spans"), keep=True)
    found = bounded(found.drop("spans") if remove == "documents" else found)
    rows = documents.select(packed(documents).alias("row"), *_key(documents))
    match = [rows[c].eqNullSafe(found[f"of_{c}"]) for c in KEY]
    if remove == "documents":
        return rows.join(found, match, "left_anti").select("row.*")
    if remove != "spans":
        raise ValueError(f"remove is documents or spans, not {remove}")
    rows = rows.join(found, match, "left")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(_without(F.col("row.text"), F.col("spans")))
    return rows.select(F.col("row").withField("text", text).alias("row")).select("row.*")
