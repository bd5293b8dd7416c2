"""All registered queries, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetfold.plans import deadletter_queries, geo_queries, ingest_queries, log_queries, report_queries, state_queries, stream_queries
from fleetfold.plans.telemetry import naive

Query = Callable[[SparkSession, str], DataFrame]

FAMILIES = [log_queries, state_queries, ingest_queries, deadletter_queries, geo_queries, report_queries, stream_queries]


def _naive(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return naive(query(spark, sf_dir))

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries() -> dict[str, Query]:
    return {name: _naive(query) for family in FAMILIES for name, (query, _) in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, (_, sql) in family.QUERIES.items() if sql is not None}
