"""Quality rules as a short-circuit cascade: the rule that rejects most for its cost comes first.

Each rule is a condition on a text's words or characters.  On a sample every rule is timed alone and its rejections are
counted; the cascade is one CASE expression in the order of rejections per second, so that a rejected document is not put
to the rules that follow.  The order changes what a run costs, never its verdicts.  Only DataFrame functions.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import BLANKS, Scratch, blank_split

SAMPLE_ROWS = 2000
SYMBOL = "[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED = 50


def _count(text: Column, pattern: str) -> Column:
    """How many characters match a one-character pattern."""
    return F.size(F.split(text, pattern)) - 1


def measured(documents: DataFrame) -> DataFrame:
    """The rows with text, words and lines (those with a word) as ``text``, ``words``, ``lines``; NULL is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), blank_split(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    return rows.withColumn("lines", lines).withColumn("n_words", F.size("words").cast("long"))


def counted(rows: DataFrame) -> DataFrame:
    """Adds word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Words in repeated three-word windows: the windows' hashes are sorted with their places, equal neighbours give the
    places of repeated windows, and each covers three words.  A text whose hashes all differ skips that.
    """
    n = F.size("words") - 2
    some = n > 0
    piece = lambda start: F.slice("words", start, F.greatest(n, F.lit(0)))
    pairs = F.zip_with(piece(1), piece(2), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    hashes = F.zip_with(pairs, piece(3), lambda p, c: F.xxhash64(p["a"], p["b"], c))
    rows = rows.withColumn("hashes", F.when(some, hashes).otherwise(F.array().cast("array<bigint>")))
    sorted_places = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.size(F.array_distinct("hashes")) < F.size("hashes")
    rows = rows.withColumn("places", F.when(repeated, sorted_places))
    m = F.size("places") - 1
    equal = F.zip_with(F.slice("places", 1, m), F.slice("places", 2, m),
                       lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    windows = F.flatten(F.array_compact(equal))
    covered = F.array_distinct(F.flatten(F.transform(windows, lambda i: F.array(i, i + 1, i + 2))))
    return rows.withColumns({
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": _count(F.col("text"), SYMBOL).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": F.coalesce(F.when(F.col("places").isNotNull(), F.size(covered)), F.lit(0)).cast("long"),
    }).drop("hashes", "places")


def base_failed() -> Column:
    """Too short, or most words in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def rules() -> dict[str, Column]:
    """The method's rules; each is true for a text to reject, and reads ``text``, ``words`` or ``lines`` alone."""
    text, n = F.col("text"), F.size("words")
    length = F.length(F.array_join("words", ""))
    return {
        "symbols": 10 * _count(text, SYMBOL) > n,
        "marks": 10 * _count(text, "[!?]") > n,
        "shouting": 10 * _count(text, "[A-Z]") > 4 * F.length(text),
        "word_length": (2 * length < 5 * n) | (length > 12 * n),
        "repeated_lines": 2 * (F.size("lines") - F.size(F.array_distinct("lines"))) > F.size("lines"),
        "few_kinds": 10 * F.size(F.array_distinct("words")) < n,
    }


def estimated(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """Share of rejections and seconds of each rule, alone, on a sample of ``rows`` (from ``measured``)."""
    with Scratch(rows.sparkSession, "rules") as scratch:
        n = rows.select(F.count(F.lit(1)).alias("n")).first()["n"]
        few = rows if n <= sample_rows else rows.sample(fraction=sample_rows / n, seed=1)
        few = scratch.write(few.select("text", "words", "lines"))
        columns = rules()
        shares = few.agg(*[F.avg(rule.cast("int")).alias(name) for name, rule in columns.items()]).first()
        out = {}
        for name, rule in columns.items():
            began = time.perf_counter()
            few.agg(F.count_if(rule)).collect()
            out[name] = (shares[name] or 0.0, time.perf_counter() - began)
        return out


def cascade(estimates: dict[str, tuple[float, float]]) -> Column:
    """Name of the first rule that rejects a row, or NULL; later rules are then not evaluated."""
    columns = rules()
    names = sorted(columns, key=lambda name: (-estimates[name][0] / max(estimates[name][1], 1e-6), name))
    out = F.when(columns[names[0]], names[0])
    for name in names[1:]:
        out = out.when(columns[name], name)
    return out


def judged(documents: DataFrame) -> DataFrame:
    """doc_id, text, the counts, base_failed and rejected_by (the first rule in the cascade's order, NULL if none)."""
    rows = measured(documents)
    estimates = estimated(rows)
    rows = counted(rows).withColumn("base_failed", base_failed())
    return rows.withColumn("rejected_by", F.when(~F.col("base_failed"), cascade(estimates)))


def report(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    NULL, empty and blank texts have no words, fail the base and are not kept.  Repeated rows have equal result rows; no
    rows give none.
    """
    kept = ~F.col("base_failed") & F.col("rejected_by").isNull()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged(documents).select("doc_id", *counts, "base_failed", kept.alias("kept"))
