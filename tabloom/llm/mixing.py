"""Mixing sources to target weights by entropy balancing.

Of all rates between 0 and 3 that make each source's words meet its target, the ones closest to 1 in relative entropy are
exponentially tilted: rate = min(3, exp(tilt * size / mean size)), one tilt per source.  The tilts solve a convex dual; each
Newton step sums it on the executors over the table of distinct sizes per source.  Rates are then rounded into whole copies
so that the errors of a source cancel from size to size, the largest first.  Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.llm.common import Scratch, blank_split, packed

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
STEPS = 60
CLOSE = 1e-10
UNIT_ROWS = 1000
RUN_SIZES = 1000


def identity(documents: DataFrame) -> list[Column]:
    """What tells documents apart: id, source and a hash of both and the text."""
    return [F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.xxhash64("doc_id", "source", "text").alias("h")]


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, source, h, size, rows): distinct documents with their number of words and of repeated rows."""
    rows = documents.select(*identity(documents), F.size(blank_split(F.col("text"))).cast("long").alias("size"))
    return rows.groupBy("doc_id", "source", "h", "size").agg(F.count(F.lit(1)).alias("rows"))


def targets(classes: DataFrame) -> DataFrame:
    """Per source: sid (its rank by code point, NULL last), source_size, n_rows and target.

    Sources weigh 5, 2, 1, repeating, and share the sum of all sizes; a target stops at three times its source's size, and
    the others share the excess.  With sources in the order of cap per weight, those at their cap come first, and the rest
    have one price: what is left by the weight that is left.  These windows see one row per source.
    """
    every = classes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_rows"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    rows = every.withColumn("sid", rank).withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST_COPIES)
    order = W.orderBy(F.col("cap") / F.col("weight"), "sid")
    whole, before = W.partitionBy(), order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({
        "left": F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weight_left": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    rows = rows.withColumn("price", F.col("left") / F.col("weight_left"))
    rows = rows.withColumn("full", F.col("cap") <= F.col("weight") * F.col("price"))
    price = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "sid", "price"))).over(whole)["price"]
    return rows.withColumn("price", price).select(
        "sid", "source", "source_size", "n_rows", "full",
        F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("price")).alias("target"),
    )


def _rate(tilt: Column, size: Column, mean: Column) -> Column:
    return F.least(F.lit(float(MOST_COPIES)), F.exp(tilt * size / mean))


def tilts(classes: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(sid, mean, tilt) of the sources that are not at their cap, by safeguarded Newton steps on the logarithm of the
    dual's slope; a step that leaves the known bracket becomes its middle."""
    start = wanted.where((F.col("target") > 0) & ~F.col("full"))
    state = scratch.write(start.select("sid", "target", (F.col("source_size") / F.col("n_rows")).alias("mean"),
                                       F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"),
                                       F.lit(None).cast("double").alias("high"), F.lit(None).cast("double").alias("off")))
    for _ in range(STEPS):
        rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"))
        words = F.col("n") * F.col("size") * rate
        slope = F.when(rate < MOST_COPIES, words * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = classes.join(state, "sid").groupBy("sid").agg(F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        off = F.log(F.col("words") / F.col("target"))
        new = state.drop("off").join(sums, "sid").withColumn("off", off).withColumns({
            "low": F.when(F.col("off") < 0, F.greatest("low", "tilt")).otherwise(F.col("low")),
            "high": F.when(F.col("off") > 0, F.least("high", "tilt")).otherwise(F.col("high")),
        })
        newton = F.col("tilt") - F.col("off") * F.col("words") / F.col("slope")
        limit = F.abs(F.col("tilt")) * 2 + 2
        step = F.greatest(-limit, F.least(limit, F.when((F.col("slope") > 0), newton).otherwise(limit)))
        middle = (F.col("low") + F.col("high")) / 2
        inside = F.coalesce(step > F.col("low"), F.lit(True)) & F.coalesce(step < F.col("high"), F.lit(True))
        new = new.withColumn("tilt", F.when(F.abs("off") <= CLOSE, F.col("tilt")).otherwise(F.when(inside, step).otherwise(middle)))
        state = scratch.replace(state, new.select("sid", "target", "mean", "tilt", "low", "high", "off"))
        if not state.where(F.abs("off") > CLOSE).where("low is null or high is null or high - low > 1e-13").take(1):
            break
    return state.select("sid", "mean", "tilt")


def rounded(classes: DataFrame) -> DataFrame:
    """(sid, size, n, copies, extra) of classes with a ``rate``: each of n documents is taken ``copies`` times, ``extra``
    of them once more.  What a size misses of its words is carried to the next smaller one of the source."""
    one = F.struct((-F.col("size")).alias("order"), "n", (F.col("rate") - F.floor("rate")).alias("part"))
    parts = classes.groupBy("sid").agg(F.sort_array(F.collect_list(one)).alias("parts"))

    def step(seen, x):
        size = -x["order"]
        due = seen["due"] + x["n"] * x["part"] * size
        extra = F.when(size > 0, F.greatest(F.lit(0), F.least(x["n"], F.round(due / size).cast("long")))).otherwise(F.lit(0)).cast("long")
        return F.struct((due - extra * size).alias("due"), F.concat(seen["extra"], F.array(extra)).alias("extra"), seen["runs"].alias("runs"))

    def run(seen, at):
        """A thousand sizes; finished runs are put aside, for an array grows by being copied."""
        begin = F.struct(seen["due"].alias("due"), none.alias("extra"), F.concat(seen["runs"], F.array(seen["extra"])).alias("runs"))
        return F.aggregate(F.slice("parts", at * RUN_SIZES + 1, F.lit(RUN_SIZES)), begin, step)

    none = F.array().cast("array<bigint>")
    zero = F.struct(F.lit(0.0).alias("due"), none.alias("extra"), F.array().cast("array<array<bigint>>").alias("runs"))
    runs = F.sequence(F.lit(0), F.floor((F.size("parts") - 1) / RUN_SIZES).cast("int"))
    parts = parts.withColumn("done", F.aggregate(runs, zero, run))
    parts = parts.withColumn("extra", F.concat(F.flatten("done.runs"), "done.extra")).drop("done")
    parts = parts.select("sid", F.explode(F.arrays_zip(F.col("parts"), F.col("extra"))).alias("x"))
    extras = parts.select("sid", (-F.col("x.parts.order")).alias("size"), F.col("x.extra").alias("extra"))
    return classes.join(extras, ["sid", "size"]).select("sid", "size", "n", F.floor("rate").alias("copies"), "extra")


def taken(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct documents (doc_id, source, h, size, rows) with source_size, target, copies and extra: each of the ``rows``
    repeated rows is taken ``copies`` times, ``extra`` of them once more."""
    docs = scratch.write(measured(documents))
    classes = scratch.write(docs.groupBy("source", "size").agg(F.sum("rows").alias("n")))
    wanted = scratch.write(targets(classes))
    same = classes["source"].eqNullSafe(wanted["source"])
    classes = scratch.write(classes.join(wanted, same).select("sid", classes["source"], "size", "n", "full", "target"))
    tilt = tilts(classes.select("sid", "size", "n"), wanted, scratch)
    rate = F.when(F.col("full"), F.lit(float(MOST_COPIES))).otherwise(
        F.coalesce(_rate(F.col("tilt"), F.col("size"), F.col("mean")), F.lit(0.0))
    )
    plan = scratch.write(rounded(classes.join(tilt, "sid", "left").select("sid", "size", "n", rate.alias("rate"))))
    facts = wanted.select("sid", F.col("source").alias("of"), "source_size", "target").join(plan, "sid")
    units = F.ceil(F.col("n") / UNIT_ROWS)
    match = docs["source"].eqNullSafe(facts["of"]) & (docs["size"] == facts["size"])
    rows = docs.join(facts, match).select(docs["*"], "sid", "source_size", "target", "n", "copies", "extra",
                                          F.pmod("h", units).alias("unit"))
    # a class of many documents is ranked in units of about a thousand, each with its part of the extra copies
    some = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    ranked = scratch.write(rows.where(some))
    by_unit = ranked.groupBy("sid", "size", "n", "extra", "unit").agg(F.sum("rows").alias("in_unit"))
    upto = F.sum("in_unit").over(W.partitionBy("sid", "size").orderBy("unit"))
    part = lambda x: F.floor(F.col("extra") * x / F.col("n"))
    by_unit = by_unit.withColumn("upto", upto).select(
        "sid", "size", "unit", (part(F.col("upto")) - part(F.col("upto") - F.col("in_unit"))).alias("of_unit")
    )
    before = F.sum("rows").over(W.partitionBy("sid", "size", "unit").orderBy("h", "doc_id")) - F.col("rows")
    ranked = ranked.join(by_unit, ["sid", "size", "unit"]).withColumn("before", before)
    share = F.greatest(F.lit(0), F.least(F.col("rows"), F.col("of_unit") - F.col("before")))
    all_or_none = F.when(F.col("extra") > 0, F.col("rows")).otherwise(F.lit(0))
    columns = ["doc_id", "source", "h", "size", "rows", "source_size", "target", "copies"]
    return ranked.select(*columns, share.cast("long").alias("extra")).unionByName(
        rows.where(~some).select(*columns, all_or_none.cast("long").alias("extra"))
    )


def report(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (its words in the mix, copies counted).

    NULL, empty and blank texts have size 0 and nothing taken; NULL is a source of its own, the last.  Repeated rows have a
    result row each and may differ by one copy.  The same rows give the same mix in any order or partitioning.
    """
    with Scratch(documents.sparkSession, "mix") as scratch:
        rows = taken(documents, scratch).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
        copies = F.col("copies") + (F.col("row") <= F.col("extra")).cast("int")
        return scratch.write(
            rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken")), keep=True
        )


def mix(documents: DataFrame) -> DataFrame:
    """The mix itself: the documents, all columns, each as often as it is taken."""
    spark = documents.sparkSession
    with Scratch(spark, "mix") as scratch:
        found = taken(documents, scratch).where("size > 0").select(
            F.col("doc_id").alias("of_id"), F.col("source").alias("of_source"), F.col("h").alias("of_h"), "rows", "copies", "extra"
        )
        found = scratch.write(found.where("copies + extra > 0"), keep=True)
    rows = documents.select(packed(documents).alias("row"), *identity(documents))
    match = rows["h"].eqNullSafe(found["of_h"]) & rows["doc_id"].eqNullSafe(found["of_id"]) & rows["source"].eqNullSafe(found["of_source"])
    rows = rows.join(found, match)
    single = rows.where("rows = 1").select("row", (F.col("copies") + F.col("extra")).alias("times"))
    # repeated rows: count the equal ones, then hand the extra copies out among those that differ in other columns
    several = rows.where("rows > 1").groupBy("row", "doc_id", "source", "h", "copies", "extra").agg(F.count(F.lit(1)).alias("equal"))
    before = F.sum("equal").over(W.partitionBy("doc_id", "source", "h").orderBy(F.to_json("row"))) - F.col("equal")
    share = F.greatest(F.lit(0), F.least(F.col("equal"), F.col("extra") - before))
    several = several.select("row", (F.col("copies") * F.col("equal") + share).alias("times"))
    times = single.unionByName(several).where("times > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
