"""Name -> query and name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from motorpool.sources.tables import load_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Source:
    """The tables of one directory, loaded on demand: ``src.orders`` or ``src["orders"]``."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory

    def __getitem__(self, name: str) -> DataFrame:
        return load_table(self.spark, self.directory, name)

    def __getattr__(self, name: str) -> DataFrame:
        return self[name]


def query(name: str, sql: str | None = None):
    """Register a function of a :class:`Source`, with its SQL where SQL can state the result."""

    def register(fn: Callable[[Source], DataFrame]):
        QUERIES[name] = lambda spark, directory: fn(Source(spark, directory))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
