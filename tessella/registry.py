"""Queries of the engine and their ANSI SQL twins, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` is its twin over the same tables."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


for _module in ("graph_queries", "inventory_queries", "retrieval_queries", "context_queries", "lifecycle_queries", "state_queries", "code_queries", "evidence_queries", "pack_queries", "build_queries", "nested_queries", "report_queries", "stream_queries"):
    importlib.import_module(f"tessella.plans.{_module}")
