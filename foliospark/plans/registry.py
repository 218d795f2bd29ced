"""Named queries over the standard tables, each with an optional DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    plan: Plan
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register ``plan(spark, sf_dir)`` under ``name``; ``ids`` are inventory IDs."""

    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, ids, plan, sql)
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a scan with fewer splits than the session has cores.

    Only for CPU-heavy row-local work on small inputs: a scan of any size has more
    splits than that and is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores) if splits < cores else df
