"""Which rows differ between a table and a file, found without handing out every row hash.

Both sides sum up their row hashes in a tree of hash prefixes.  Only children of nodes that differ are handed out, and only
the hashes of leaves that differ: with k changed rows of n about 16 k log n nodes and k leaves, where ``load.delta_prep``
hands out n hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.load import delta_changes
from tabloom.operators.skew import keep_by_key
from tabloom.session import materialize
from tabloom.types import ROW_HASH

LEAF_HASHES = 64  # of a leaf, about
DIGITS = 16  # children of a node
SUMS = ["n", "sum_high", "sum_low"]


def tree_depth(row_count: int) -> int:
    """Hex digits of a leaf that keep it near ``LEAF_HASHES`` hashes."""
    return max(1, math.ceil(math.log(max(row_count, 1) / LEAF_HASHES, DIGITS)))


def _number(start: int) -> Column:
    return F.conv(F.substring(ROW_HASH, start, 15), 16, 10).cast("decimal(38,0)")


def hash_tree(rows: DataFrame, depth: int) -> DataFrame:
    """(depth, prefix, n, sum_high, sum_low): number and sums of the distinct row hashes below each prefix of up to ``depth`` digits.

    Rows without a hash are in no node.  Hashes are shuffled once, leaves once more; the tree has about a leaf for each
    ``LEAF_HASHES`` rows, so it is a table like others and nothing of it comes to the driver.
    """
    distinct = rows.select(ROW_HASH).where(F.col(ROW_HASH).isNotNull()).distinct()
    leaves = distinct.groupBy(F.substring(ROW_HASH, 1, depth).alias("leaf")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(_number(1)).alias("sum_high"), F.sum(_number(17)).alias("sum_low")
    )
    levels = leaves.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    return levels.groupBy("depth", F.substring("leaf", F.lit(1), F.col("depth")).alias("prefix")).agg(
        *[F.sum(c).alias(c) for c in SUMS]
    )


def differing_nodes(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(depth, prefix) of the nodes of two trees that do not agree, or that one of them lacks."""
    here, there = (side.select("depth", "prefix", F.struct(*SUMS).alias(name)) for side, name in ((mine, "here"), (theirs, "there")))
    return here.join(there, ["depth", "prefix"], "full").where(~F.col("here").eqNullSafe(F.col("there"))).select("depth", "prefix")


def handed_nodes(tree: DataFrame, differing: DataFrame) -> DataFrame:
    """The nodes that the owner of a tree hands out: the root, and the children of nodes that differ."""
    parents = differing.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    children = tree.where("depth > 0").withColumn("parent", F.expr("substring(prefix, 1, depth - 1)"))
    below = keep_by_key(children, parents, ["depth", "parent"], present=True, unique=True).drop("parent")
    return tree.where("depth = 0").unionByName(below)


def handed_hashes(rows: DataFrame, differing: DataFrame, depth: int) -> DataFrame:
    """The row hashes in leaves that differ, with repeats."""
    leaves = differing.where(F.col("depth") == depth).select(F.col("prefix").alias("leaf"))
    hashed = rows.select(ROW_HASH, F.substring(ROW_HASH, 1, depth).alias("leaf"))
    return keep_by_key(hashed, leaves, ["leaf"], present=True, unique=True).select(ROW_HASH)


def reconciled_changes(target: DataFrame, incoming: DataFrame, depth: int) -> DataFrame:
    """``load.delta_changes`` of two sides that exchange what ``handed_nodes`` and ``handed_hashes`` say.

    The differing nodes are written out at once, since both sides read them: Spark then knows how few they are and
    broadcasts them, so that only hashes of differing leaves are shuffled.
    """
    differing = materialize(differing_nodes(hash_tree(target, depth), hash_tree(incoming, depth)), "differing")
    return delta_changes(handed_hashes(target, differing, depth), handed_hashes(incoming, differing, depth))
