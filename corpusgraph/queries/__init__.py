"""Registered queries, each over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def all_queries() -> tuple[dict[str, Query], dict[str, str]]:
    from corpusgraph.queries import chats, graphs, scoring, tables, texts

    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}
    for module in (graphs, texts, tables, chats, scoring):
        queries |= {f.__name__: f for f in module.QUERIES}
        oracles |= module.ORACLES
    return queries, oracles
