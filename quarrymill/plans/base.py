"""Registration of queries: each takes a Catalog and gives a DataFrame; its SQL may name the catalog views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quarrymill.sources.catalog import Catalog, with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(plan: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: plan(Catalog(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql)
        return plan

    return register
