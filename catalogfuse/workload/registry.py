"""Query registry and table access."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)
WIDE_WORK = ("documents", "pages", "part")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The parquet tables of one directory."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        """The table, over all cores when it is one that queries do heavy work per row on.

        A file of one row group is one scan partition however many cores there are. Tables with
        enough partitions are left alone, so this costs nothing on real data.
        """
        return self.read(name, name in WIDE_WORK)

    def read(self, name: str, spread: bool) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        if not spread or df.rdd.getNumPartitions() >= cores:
            return df
        return df.repartition(cores)

    def sql(self, text: str, spread: bool = False) -> DataFrame:
        """Fixture SQL: table names stand in braces. ``spread`` is for heavy work per line."""
        used = {n: self.read(n, spread or n in WIDE_WORK) for n in TABLES if "{" + n + "}" in text}
        return self.spark.sql(text, **used)


def in_sql(fixture: str) -> str:
    """The same fixture for the SQL side, where the tables are views."""
    return fixture.format(**{n: n for n in TABLES})


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` and its SQL twin."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register
