"""Every registered query against its SQL, and the contract of the entry module."""

import importlib

import pytest
from compare import connect, difference, rows_of

from conftest import SF
from tabloom.checks import load_registry

REGISTRY = load_registry()


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_query(spark, db, name):
    found = rows_of(REGISTRY.queries[name](spark, SF).toArrow())
    assert found[0]
    if name in REGISTRY.sql:
        assert difference(found, rows_of(db.execute(REGISTRY.sql[name]).to_arrow_table())) is None


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 3
