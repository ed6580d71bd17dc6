"""Tables that a query defines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.mapping import describe_source
from tabloom.plans.scoped_sql import run_query
from tabloom.sources.store import TableStore
from tabloom.types import ColumnSpec


def derived_rows(spark, sql: str, scope: Mapping[str, Mapping[str, DataFrame]]) -> DataFrame:
    """The rows of a derived table."""
    return run_query(spark, sql, scope)


def refresh_derived(
    store: TableStore, table: str, sql: str, scope: Mapping[str, Mapping[str, DataFrame]], load_id: str
) -> tuple[DataFrame, list[ColumnSpec]]:
    """Write the result of a query as the next version of a table; returns it with its columns."""
    stored = store.publish(table, derived_rows(store.spark, sql, scope), "derived", load_id)
    return stored, describe_source(stored)


def _share(amount: Column, part: Column, whole: Column) -> Column:
    """``amount`` in proportion of ``part`` to ``whole``; nothing is shared out of zero."""
    empty = F.coalesce(whole, F.lit(0.0)) == 0
    return F.when(empty, F.lit(0.0)).otherwise(F.coalesce(amount, F.lit(0.0)) * part / whole)


def allocate(df: DataFrame, gross: str, net: str, discount: str, part: str) -> DataFrame:
    """Split net value and discount of each entry in proportion of its part to its gross value."""
    whole, share = F.col(gross).cast("double"), F.col(part).cast("double")
    empty = F.coalesce(whole, F.lit(0.0)) == 0
    return df.withColumns(
        {
            "net_allocated": _share(F.col(net).cast("double"), share, whole),
            "discount_allocated": _share(F.col(discount).cast("double"), share, whole),
            "allocation_rate": F.when(empty, F.lit(0.0)).otherwise(share / whole),
        }
    )
