"""The registered queries: every operator over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, each with its SQL where SQL can express it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(build: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = build
            if sql is not None:
                self.sql[name] = sql
            return build

        return register


def load_registry() -> Registry:
    from tabloom.checks import (
        aggregates,
        conversions,
        governance,
        loads,
        profiles,
        reconciliation,
        sources,
        streams,
    )

    whole = Registry()
    for module in (sources, profiles, conversions, aggregates, loads, governance, reconciliation, streams):
        for name, build in module.registry.queries.items():
            whole.query(name, module.registry.sql.get(name))(build)
    return whole
