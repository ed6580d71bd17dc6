"""Set reconciliation finds what a comparison of all row hashes finds, and hands out little."""

import hashlib

import pytest

from tabloom.operators import exchange, load

SCHEMA = "row_hash string"


def hashes(spark, texts):
    rows = [(None if t is None else hashlib.md5(str(t).encode()).hexdigest(),) for t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def as_set(changes):
    return {(r.row_hash, r.target_rows, r.file_rows) for r in changes.collect()}


@pytest.mark.parametrize("mine, theirs", [
    (range(500), range(500)),
    (range(500), [*range(3, 500), 900, 901, 901]),
    ([1, 1, 1, 2, None], [2, 2, 3, None, None]),  # repeats and rows without a hash
    (range(300), range(300, 600)),
    ([], range(40)),
    (range(40), []),
    ([], []),
])
def test_reconciled_is_the_full_change_set(spark, mine, theirs):
    target, incoming = hashes(spark, mine), hashes(spark, theirs)
    wanted = as_set(load.delta_changes(target, incoming))
    for depth in (1, 3):
        assert as_set(exchange.reconciled_changes(target, incoming, depth)) == wanted


def test_little_is_handed_out(spark):
    n, changed = 20_000, 3
    target, incoming = hashes(spark, range(n)), hashes(spark, [*range(changed, n)])
    depth = exchange.tree_depth(n)
    tree = exchange.hash_tree(target, depth)
    differing = exchange.differing_nodes(tree, exchange.hash_tree(incoming, depth))
    assert differing.count() <= changed * (depth + 1)
    assert exchange.handed_nodes(tree, differing).count() <= 1 + exchange.DIGITS * changed * depth
    given = exchange.handed_hashes(target, differing, depth)
    gone = {r.row_hash for r in hashes(spark, range(changed)).collect()}
    assert gone <= {r.row_hash for r in given.collect()}
    assert given.count() <= changed * 2 * exchange.LEAF_HASHES


def test_tree_adds_up(spark):
    tree = exchange.hash_tree(hashes(spark, [*range(1000), 5, 5, None]), 2)
    levels = {r.depth: r.n for r in tree.groupBy("depth").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert levels == {0: 1000, 1: 1000, 2: 1000}
    assert [exchange.tree_depth(n) for n in (0, 64, 1024, 1025, 10**11)] == [1, 1, 1, 2, 8]


@pytest.mark.parametrize("removed", [[], [1, 7]])
def test_a_precomputed_delta_takes_listed_hashes_out_of_both_sides(spark, removed):
    out = load.delta_precomputed(hashes(spark, [1, 1, 2, None]), hashes(spark, [2, 7, 8, 8, None]), hashes(spark, removed))
    kept = [t for t in (1, 1, 2, None, 7, 8, 8, None) if t not in removed]
    assert sorted(str(r.row_hash) for r in out.collect()) == sorted(str(r.row_hash) for r in hashes(spark, kept).collect())
