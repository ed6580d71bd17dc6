"""Exact duplicates: brute force over odd rows, groups across partitions, rows carried along."""

import collections
import hashlib
import re

import pytest

from tabloom.llm import exact_sort

ROWS = [
    (4, "Same text", "a"), (3, "Same \t\n text", "b"), (3, "Same  text", "c"), (None, "Same text", "d"), (9, None, "e"), (8, "", "f"),
    (7, " ", "g"), (6, "\n\n", "h"), (None, "no id", "i"), (None, "no id", "i"), (1, "é " * 200_000, "j"), (2, "é\t" * 200_000, "k"),
    (5, "same text", "l"),
] + [(i, "hot", "m") for i in range(100, 400)] + [(None, "hot", "n")] * 5
SCHEMA = "doc_id long, text string, row string, digest int, first boolean, sha string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, r, 1, True, "x") for i, t, r in ROWS], SCHEMA).repartition(3)


def expected():
    groups = collections.defaultdict(list)
    for i, t, _ in ROWS:
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", t or "")].append(i)
    return sorted(
        (str(i), str(min((x for x in ids if x is not None), default=None)), len(ids), hashlib.sha256(t.encode()).hexdigest())
        for t, ids in groups.items() for i in ids
    ), len(groups)


@pytest.mark.parametrize("partition_bytes", [exact_sort.PARTITION_BYTES, 30_000])
def test_groups_are_those_of_brute_force(odd, partition_bytes):
    found = exact_sort.grouped(odd, partition_bytes=partition_bytes).drop("row").collect()
    rows, groups = expected()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in found) == rows
    kept = [r for r in found if r["kept"]]
    assert len(kept) == groups == len({r["text_sha256"] for r in kept}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_a_hot_group_fills_no_partition(odd):
    parts = exact_sort.in_content_order(odd, False, 30_000).where("text = 'hot'").selectExpr("spark_partition_id() as p")
    assert parts.distinct().count() > 3


def test_kept_rows_keep_their_columns(odd):
    kept = exact_sort.unique(odd)
    assert kept.columns == odd.columns and kept.count() == expected()[1]
    assert {r["row"] for r in kept.where("text like 'Same%' or doc_id in (1, 6)").collect()} <= {"b", "c", "j", "h"}


def test_no_rows(odd):
    assert exact_sort.report(odd.limit(0)).count() == 0 and exact_sort.unique(odd.limit(0)).count() == 0
