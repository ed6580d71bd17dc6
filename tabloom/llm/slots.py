"""Sharding by fixed virtual slots and a versioned map from slots to shards.

Every record hashes into one of some thousands of slots, for good.  Bytes are summed by slot, and a small table says which
shard holds which slot.  Rebalancing edits that table: whole slots move from the fullest shards to the emptiest, all other
rows stay where they are, and each edit is stored as a new version.  Given the folder of a map, a run goes on from its newest
version, also with more data or another number of shards.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.llm.common import Scratch

SLOTS = 8192
SHARDS = 24
ROW_OVERHEAD = 8
MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long, n_rows long"


def virtual_slot(key: Column, text_crc: Column, slots: int = SLOTS) -> Column:
    """The slot of a record.  The text takes part, so that rows that share an id, or have none, spread as well."""
    return F.pmod(F.xxhash64(key, text_crc), F.lit(slots)).cast("int")


def measured(documents: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of each row; a NULL text has no bytes."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return documents.select("doc_id", (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
                            F.crc32(text).alias("text_crc32")).withColumn(
        "virtual_slot", virtual_slot(F.col("doc_id"), F.col("text_crc32"), slots)
    )


def slot_totals(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each slot, added up below the shuffle."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))


def first_map(slots: int, shards: int) -> dict[int, int]:
    """Version 1, before anything is known of the data: slots dealt round."""
    return {slot: slot % shards for slot in range(slots)}


def rebalanced(held: dict[int, int], weights: dict[int, int], shards: int) -> dict[int, int]:
    """The map after moving slots until no move or swap between the fullest and another shard narrows their gap.

    Over-full shards give up slots, those beyond ``shards`` give up all, the largest of these go first to the emptiest shard;
    then single slots move or swap with the fullest shard.  It works on the slot totals alone, some thousands of numbers whatever the data.
    """
    out = {slot: shard if shard < shards or slot in weights else slot % shards for slot, shard in held.items()}
    load = [0] * shards
    members: list[set[int]] = [set() for _ in range(shards)]
    pool = [slot for slot in weights if out[slot] >= shards]
    for slot, weight in weights.items():
        if out[slot] < shards:
            load[out[slot]] += weight
            members[out[slot]].add(slot)
    mean = sum(weights.values()) / shards
    for shard in range(shards):
        for slot in sorted(members[shard], key=lambda s: (-weights[s], s)):
            if load[shard] - weights[slot] >= mean:
                load[shard] -= weights[slot]
                members[shard].discard(slot)
                pool.append(slot)
    heap = [(load[shard], shard) for shard in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(pool, key=lambda s: (-weights[s], s)):
        _, shard = heapq.heappop(heap)
        load[shard] += weights[slot]
        members[shard].add(slot)
        out[slot] = shard
        heapq.heappush(heap, (load[shard], shard))
    for _ in range(8 * shards):
        full, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[full] - load[low]
        # moving d bytes from the fullest to the emptiest helps if 0 < d < gap, most at gap / 2
        best = min(
            ((abs(gap / 2 - (weights[a] - b_weight)), a, b) for a in members[full] for b, b_weight in
             [(None, 0), *[(b, weights[b]) for b in members[low]]] if 0 < weights[a] - b_weight < gap),
            default=None, key=lambda found: (found[0], found[1], -1 if found[2] is None else found[2]),
        )
        if best is None:
            break
        _, a, b = best
        for slot, source, target in ((a, full, low), (b, low, full)):
            if slot is not None:
                members[source].discard(slot)
                members[target].add(slot)
                load[source] -= weights[slot]
                load[target] += weights[slot]
                out[slot] = target
    return out


def store_map(spark, path: str, version: int, held: dict[int, int], totals: dict[int, tuple[int, int]]) -> None:
    """Append a version of the map; a version is one small file and is never changed."""
    rows = [(version, slot, shard, *totals.get(slot, (0, 0))) for slot, shard in sorted(held.items())]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("error").parquet(f"{path}/version={version:06d}")


def read_map(spark, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version:06d}")


def versions(spark, path: str) -> dict[int, bool]:
    """The versions of the map at ``path``, and whether each was written to its end."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return {}
    folders = [f.getPath() for f in files.listStatus(root) if f.getPath().getName().startswith("version=")]
    return {int(p.getName().split("=")[1]): files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")) for p in folders}


def plan(rows: DataFrame, path: str, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Balance ``rows`` (from ``measured``) from the newest map at ``path``, store the result as its next version and return it.

    Without a map, version 1 is stored first.  The driver sees one row per slot, ``slots`` at most.
    """
    spark = rows.sparkSession
    totals = {r["virtual_slot"]: (r["bytes"], r["n_rows"]) for r in slot_totals(rows).collect()}
    stored = versions(spark, path)
    whole = [version for version, done in stored.items() if done]
    if whole:
        held = {r["virtual_slot"]: r["shard"] for r in read_map(spark, path, max(whole)).collect()}
        if len(held) != slots:
            raise ValueError(f"the map at {path} has {len(held)} slots, not {slots}: slots are fixed for good")
        number = max(stored) + 1
    else:
        held, number = first_map(slots, shards), max(stored, default=0) + 2
        store_map(spark, path, number - 1, held, totals)
    weights = {slot: totals[slot][0] for slot in totals}
    store_map(spark, path, number, rebalanced(held, weights, shards), totals)
    return read_map(spark, path, number)


def shard_rows(documents: DataFrame, slots: int = SLOTS, shards: int = SHARDS, map_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ``bytes``, shard, slot, grown_shard, virtual_slot.

    ``slot`` is the row's place in its shard, from 0 without gaps.  Virtual slots follow each other within a shard, so a
    place is the rows of the slots before it plus the place in its own slot; only the latter needs an order of rows.
    The map of slots is carried on at ``map_path``; without it, one is made for this run.  Repeated rows each get a place; an empty table gives no rows; a NULL text has 8 bytes, the crc32 of nothing.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "shards")
    rows = scratch.write(measured(documents, slots))
    layout = plan(rows, map_path or scratch.path(), slots, shards)
    before = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    layout = layout.select("virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("place", place).join(F.broadcast(layout), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )
