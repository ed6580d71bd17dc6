"""Near duplicates by 64-bit SimHash: vantage-point trees over the distinct fingerprints, then connected components.

Fingerprints at most four bits apart are linked.  Whole 64-bit distances gather so closely around 32 that a vantage point
would separate little, so the tree is a forest of three: tree t measures distance on its own third of the bits.  Of four
differing bits at most one falls into some third, so that each link is found by a tree with search radius 1.  A node sends a
fingerprint inside its ball up to that radius beyond it and outside from the ball's edge on (the triangle bound), so two
fingerprints within the radius always meet in a leaf; those at a boundary go to both shards.  Leaves compare exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import Scratch, bounded, packed, small_batches

SHINGLE = 4
SEED = 42
LINK_BITS = 4
BLOCKS = (0, 21, 42, 64)
RADIUS = LINK_BITS // (len(BLOCKS) - 1)
LEAF_ROWS = 1500
MAX_DEPTH = 16
SAMPLE_PER_LEAF = 24
SPLIT_ROWS = 12_000
ROUNDS = 60
_SLICE = 65_536


def fingerprint(text: str | None) -> int:
    """Bit j is set if it is set in over half of the hashes of the text's word shingles; 0 without words."""
    words = (text or "").encode("utf-8").lower().split()  # of bytes: only A-Z, and only ASCII blanks
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[-n:].tolist()
    votes = np.zeros(64, dtype=np.int64)
    for low in range(0, n, _SLICE):
        hashes = np.array(
            [xxhash.xxh64_intdigest(whole[a:b], SEED) for a, b in zip(starts[low : min(n, low + _SLICE)], last[low : low + _SLICE])],
            dtype="<u8",
        )
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def masks() -> np.ndarray:
    return np.array([((1 << high) - 1) ^ ((1 << low) - 1) for low, high in zip(BLOCKS, BLOCKS[1:])], dtype=np.uint64)


class Tree:
    """One tree as arrays in heap order: node k has children 2k+1 (inside) and 2k+2 (outside); radius -1 is a leaf."""

    def __init__(self, sample: np.ndarray, mask: np.uint64, depth: int, seed: int) -> None:
        self.mask, self.depth = mask, depth
        self.vantage = np.zeros(2**depth - 1, dtype=np.uint64)
        self.reach = np.full(2**depth - 1, -1, dtype=np.int8)
        random = np.random.default_rng(seed)
        todo = [(0, sample)]
        while todo:
            node, points = todo.pop()
            if node >= len(self.reach) or len(points) < 8:
                continue
            best = None
            for vantage in random.choice(points, min(12, len(points)), replace=False):
                counts = np.bincount(np.bitwise_count((points ^ vantage) & mask), minlength=65)
                upto = np.cumsum(counts)
                for reach in range(0, 64 - RADIUS):
                    inside, outside = upto[reach + RADIUS], len(points) - upto[reach]
                    cost = int(inside) ** 2 + int(outside) ** 2
                    if max(inside, outside) < len(points) and (best is None or cost < best[0]):
                        best = (cost, vantage, reach)
            if best is None:
                continue
            _, self.vantage[node], self.reach[node] = best
            distance = np.bitwise_count((points ^ self.vantage[node]) & mask)
            todo.append((2 * node + 1, points[distance <= self.reach[node] + RADIUS]))
            todo.append((2 * node + 2, points[distance > self.reach[node]]))

    def leaves(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``points`` and the leaf each goes to; a point at a boundary comes more than once."""
        at, node = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
        done_at, done_node = [], []
        for _ in range(self.depth):
            leaf = self.reach[node] < 0
            done_at.append(at[leaf])
            done_node.append(node[leaf])
            at, node = at[~leaf], node[~leaf]
            distance = np.bitwise_count((points[at] ^ self.vantage[node]) & self.mask).astype(np.int16)
            inside, outside = distance <= self.reach[node] + RADIUS, distance > self.reach[node]
            at, node = np.concatenate([at[inside], at[outside]]), np.concatenate([2 * node[inside] + 1, 2 * node[outside] + 2])
        return np.concatenate([*done_at, at]), np.concatenate([*done_node, node])


def forest(nodes: DataFrame, n: int) -> list[Tree]:
    """Trees over a bounded sample of the ``n`` fingerprints: 24 for each leaf of at most 2^16 leaves, never more than an
    eighth of all.  They only deal the work out; which pairs are found does not depend on them."""
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, n) / LEAF_ROWS)))))
    if depth == 0:
        return [Tree(np.array([], dtype=np.uint64), mask, 0, 0) for mask in masks()]
    wanted = min(SAMPLE_PER_LEAF * 2**depth, n // 8)
    drawn = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(wanted).toPandas()["fp"].to_numpy()
    sample = drawn.astype(np.int64).view(np.uint64)
    return [Tree(sample, mask, depth, t) for t, mask in enumerate(masks())]


def dealt(nodes: DataFrame, trees: list[Tree]) -> DataFrame:
    """Every fingerprint with each leaf of each tree that it belongs to."""

    def of_batches(batches):
        for batch in batches:
            points = batch["fp"].to_numpy().view(np.uint64)
            for t, tree in enumerate(trees):
                at, node = tree.leaves(points)
                yield pd.DataFrame({"tree": np.int32(t), "leaf": node, "fp": points[at].view(np.int64)})

    return nodes.select("fp").mapInPandas(of_batches, "tree int, leaf long, fp long")


def components(points: np.ndarray) -> np.ndarray:
    """For each point the first position of those it is linked with, by comparing all; keeps no list of pairs."""
    label = np.arange(len(points))
    step = max(1, (1 << 18) // max(1, len(points)))
    for low in range(0, len(points), step):
        near = np.bitwise_count(points[low : low + step, None] ^ points[None, low:]) <= LINK_BITS
        i, j = np.nonzero(near)
        i, j = i[j > i] + low, j[j > i] + low
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label != label[label]).any():
                label = label[label]
    return label


def _leaf_links(rows: pd.DataFrame) -> pd.DataFrame:
    points = np.unique(rows["fp"].to_numpy()).view(np.uint64)
    label = components(points)
    linked = label != np.arange(len(points))
    return pd.DataFrame({"a": points[linked].view(np.int64), "b": points[label[linked]].view(np.int64)})


def links(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints which chains of links connect: a star for each group in a leaf.

    A leaf too large for one task (fingerprints that agree on a third of their bits) is compared block by block, each pair
    of blocks in a task of its own.
    """
    n = nodes.count()
    rows = scratch.write(dealt(nodes, forest(nodes, n)))
    large = rows.groupBy("tree", "leaf").count().where(F.col("count") > SPLIT_ROWS)
    large = large.select("tree", "leaf", F.ceil(F.col("count") / (SPLIT_ROWS // 2)).cast("int").alias("blocks"))
    rows = rows.join(large, ["tree", "leaf"], "left")
    block = F.pmod(F.xxhash64("fp", "tree"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", F.coalesce(block, F.lit(0)))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    rows = rows.select("tree", "leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp")
    return scratch.write(rows.groupBy("tree", "leaf", "i", "j").applyInPandas(_leaf_links, "a long, b long").distinct())


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the smallest node of each component, by passing labels along edges and through labels.

    Every round is a written table; the driver sees one count a round.
    """
    both = scratch.write(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    for _ in range(ROUNDS):
        near = both.join(labels, both["a"] == labels["node"]).groupBy("b").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["b"], "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        far = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        step = step.join(far, step["label"] == far["via"], "left").select(
            "node", "old", F.least("label", "far").alias("label")
        )
        step = scratch.replace(labels, step)
        changed = step.where("old <> label").count()
        labels = step.select("node", "label")
        labels.scratch_path = step.scratch_path
        if changed == 0:
            return labels
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def grouped(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """Every row's doc_id, digest (of the text) and fp, and the component_id of its fingerprint."""
    spark = documents.sparkSession
    with small_batches(spark):
        rows = documents.select("doc_id", F.xxhash64("text").alias("digest"), fingerprints("text").alias("fp"))
        rows = scratch.write(rows)
    nodes = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = connected(links(nodes, scratch), scratch)
    roots = nodes.join(labels, nodes["fp"] == labels["node"], "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("root")
    )
    smallest = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    found = roots.join(smallest, "root").select("fp", "root", "component_id")
    return rows.join(found, "fp").select("doc_id", "digest", "fp", "root", "component_id")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    NULL and empty texts have fingerprint zero, linked like any other.  Repeated rows are in one component; a row without
    an id is never the smallest, and a component without any id has a NULL component_id.  No rows, no result rows.
    """
    with Scratch(documents.sparkSession, "simhash") as scratch:
        return scratch.write(
            grouped(documents, scratch).select(
                "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
            ),
            keep=True,
        )


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents, all columns, with one row left of each component: that of the smallest doc_id (ids before NULL).

    Among several texts with that id the one of the least hash stays, among repeated rows the least row.  Texts are not
    shuffled while the list of rows to drop is short enough to broadcast.
    """
    with Scratch(documents.sparkSession, "simhash") as scratch:
        found = grouped(documents, scratch)
        keys = scratch.write(found.groupBy("root", "doc_id", "digest").agg(F.count(F.lit(1)).alias("copies")))
        order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
        best = keys.groupBy("root").agg(F.min(order).alias("best"))
        keys = keys.join(best, "root").withColumn("stays", order.eqNullSafe(F.col("best")))
        keys = keys.select(F.col("doc_id").alias("of_id"), F.col("digest").alias("of_digest"), "copies", "stays")
        listed = scratch.write(keys.where(~F.col("stays") | (F.col("copies") > 1)), keep=True)
    rows = documents.select(packed(documents).alias("row"), "doc_id", F.xxhash64("text").alias("digest"))
    match = lambda other: rows["doc_id"].eqNullSafe(other["of_id"]) & (rows["digest"] == other["of_digest"])
    dropped = bounded(listed.select("of_id", "of_digest"))
    out = rows.join(dropped, match(dropped), "left_anti").select("row")
    repeated = listed.where("stays").select("of_id", "of_digest")
    if repeated.take(1):
        repeated = bounded(repeated)
        again = rows.join(repeated, match(repeated), "left_semi").groupBy("doc_id", "digest")
        out = out.unionByName(again.agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"))
    return out.select("row.*")
