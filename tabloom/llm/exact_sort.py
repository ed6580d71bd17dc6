"""Exact duplicates by sorting content: equal normalised texts end up next to each other and are compared in full.

Sampled splitters deal the texts out by their leading bytes, then by their hash, then by row, so that neither a common beginning
nor one text on a third of all rows fills a partition.  Spark's external sort orders each partition.  One pass over it compares
every text with the one before and ends a run where they differ.  Only runs at the edges of a partition can go on in the next
one: these, at most a few for each partition, are put together by their whole text.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import BLANK_RUN, Scratch, packed, small_batches

LEADING = 32
PARTITION_BYTES = 128 << 20
FLUSH_ROWS = 512


def normalised(text: Column) -> Column:
    """A text with each run of blanks as one space; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK_RUN, " ")


def in_content_order(documents: DataFrame, carry: bool, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(doc_id, text, digest, row): range-partitioned by content and sorted by it within each partition, then by doc_id, NULL last.

    Rows of one text differ in the last splitter column alone: the hash of their id, or their place in the input without one.
    """
    spark = documents.sparkSession
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // partition_bytes))
    row = packed(documents) if carry else F.lit(None).cast("boolean")
    rows = documents.select("doc_id", normalised(F.col("text")).alias("text"), row.alias("row"))
    rows = rows.select(
        "doc_id", "text", "row", F.substring("text", 1, LEADING).alias("leading"), F.xxhash64("text").alias("digest"),
        F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("doc_id")).alias("salt"),
    )
    rows = rows.repartitionByRange(partitions, "leading", "digest", "salt")
    rows = rows.sortWithinPartitions("leading", "digest", "text", F.col("doc_id").asc_nulls_last())
    return rows.select("doc_id", "text", "digest", "row")


class Runs:
    """Runs of equal neighbours of one partition.  ``add`` and ``end`` give rows (doc_id, first id, run size, first, sha256,
    edge, text, row): the first row of a run carries ``row``, and ``text`` if the run may go on in another partition."""

    def __init__(self) -> None:
        self.first_digest, self.digest, self.text = None, None, None
        self.open: list[tuple[str, list, object]] = []  # runs of the current digest: text, ids, row of the first

    def add(self, batch: pa.RecordBatch) -> list[tuple]:
        out = []
        text, digest = batch.column("text"), batch.column("digest").to_pylist()
        ids, row = batch.column("doc_id").to_pylist(), batch.column("row")
        if not digest:
            return out
        same = [False, *pc.equal(text.slice(1), text.slice(0, len(digest) - 1)).to_pylist()]
        for i, now in enumerate(digest):
            if self.first_digest is None:
                self.first_digest = now
            if i == 0:
                same[0] = self.text is not None and self.text == text[0].as_py()
            if same[i]:
                self.open[-1][1].append(ids[i])
                continue
            if now != self.digest:
                out += self.closed(self.digest == self.first_digest)
                self.digest = now
            self.text = text[i].as_py()
            self.open.append((self.text, [ids[i]], row.slice(i, 1)))
        return out

    def closed(self, edge: bool) -> list[tuple]:
        out = []
        for text, ids, row in self.open:
            digest = hashlib.sha256(text.encode()).hexdigest()
            out.append((ids[0], ids[0], len(ids), True, digest, edge, text if edge else None, row))
            out += [(i, ids[0], len(ids), False, digest, edge, None, None) for i in ids[1:]]
        self.open = []
        return out

    def end(self) -> list[tuple]:
        return self.closed(True)


def runs(rows: DataFrame) -> DataFrame:
    """Every row with its run; ``rows`` is in content order."""
    of_id, of_row = rows.schema["doc_id"].dataType, rows.schema["row"].dataType
    schema = T.StructType([
        T.StructField("doc_id", of_id), T.StructField("first_id", of_id), T.StructField("run_size", T.LongType()),
        T.StructField("first", T.BooleanType()), T.StructField("sha", T.StringType()), T.StructField("edge", T.BooleanType()),
        T.StructField("text", T.StringType()), T.StructField("row", of_row),
    ])

    def of_partition(batches):
        found, kinds, waiting = Runs(), None, []

        def table(some: list[tuple]) -> pa.RecordBatch:
            id_type, row_type = kinds
            columns = list(zip(*some))
            types = [id_type, id_type, pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            none = pa.nulls(1, row_type)
            arrays.append(pa.concat_arrays([none if r is None else r for r in columns[7]]))
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "first_id", "run_size", "first", "sha", "edge", "text", "row"])

        for batch in batches:
            kinds = kinds or (batch.schema.field("doc_id").type, batch.schema.field("row").type)
            waiting += found.add(batch)
            while len(waiting) >= FLUSH_ROWS:
                yield table(waiting[:FLUSH_ROWS])
                waiting = waiting[FLUSH_ROWS:]
        waiting += found.end()
        for low in range(0, len(waiting), FLUSH_ROWS):
            yield table(waiting[low : low + FLUSH_ROWS])

    return rows.mapInArrow(of_partition, schema)


def grouped(documents: DataFrame, carry: bool = False, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and in ``row`` all its columns if it is kept and
    ``carry`` says so.

    NULL texts count as empty.  The smallest id of equal texts stays, ids before NULL; of repeated rows with that id, one.  A
    group without any id has a NULL keep_id and keeps one row.  No rows, no result rows.
    """
    spark = documents.sparkSession
    with Scratch(spark, "exact") as scratch, small_batches(spark):
        found = runs(in_content_order(documents, carry, partition_bytes)).withColumn("part", F.spark_partition_id())
        found = scratch.write(found, keep=True)
    order = F.struct(F.col("first_id").isNull().alias("lacks"), "first_id", "part")
    across = found.where("text is not null").groupBy("text").agg(
        F.min(order).alias("best"), F.sum("run_size").alias("size"), F.min("sha").alias("of_sha"), F.count(F.lit(1)).alias("n")
    )
    across = across.where("n > 1").select("of_sha", "size", F.col("best.first_id").alias("least"), F.col("best.part").alias("of_part"))
    # groups that cross the edge of a partition: fewer than there are partitions
    rows = found.join(F.broadcast(across), F.col("edge") & (F.col("sha") == F.col("of_sha")), "left")
    alone = F.col("of_sha").isNull()
    kept = F.col("first") & (alone | (F.col("part") == F.col("of_part")))
    return rows.select(
        "doc_id", F.when(alone, F.col("first_id")).otherwise(F.col("least")).alias("keep_id"),
        F.coalesce("size", "run_size").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"),
        F.when(kept, F.col("row")).alias("row"),
    )


def unique(documents: DataFrame) -> DataFrame:
    """The documents, all columns, with one row left of each group of equal texts."""
    return grouped(documents, carry=True).where("kept").select("row.*")


def report(documents: DataFrame) -> DataFrame:
    """``grouped`` without the rows themselves."""
    return grouped(documents).drop("row")
