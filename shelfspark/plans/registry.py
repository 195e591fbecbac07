"""All queries of the catalogue engine with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its equivalent on the driver's tables."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    import shelfspark.plans.catalogue
    import shelfspark.plans.enrichment
    import shelfspark.plans.identities
    import shelfspark.plans.library
    import shelfspark.plans.matches
    import shelfspark.plans.records
    import shelfspark.plans.reporting
    import shelfspark.plans.searches
    import shelfspark.plans.surgery
    import shelfspark.plans.tablefunctions  # noqa: F401  all register


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
