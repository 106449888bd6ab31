"""Named queries: each is a Spark callable (spark, sf_dir) -> DataFrame plus, where SQL can express it, the DuckDB
oracle text over the driver's views (region nation customer supplier part orders lineitem events documents embeddings
pages benchmark labels conversations). Column names are identical on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, tuple[str, ...]] = {}


def query(name: str, operators: tuple[str, ...] = (), oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        OPERATORS[name] = operators
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco
