"""Sorts, limits and set operations in the form the jobs use them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sort_paths(inventory: DataFrame) -> DataFrame:
    """Global path order: range partitioned, each task sorts its own range."""
    return inventory.orderBy("path")


def sort_report(df: DataFrame, *columns: str) -> DataFrame:
    """Newest first, then by code, descending."""
    return df.orderBy(*[F.col(c).desc() for c in columns])


def sort_by_length(values: Column | str, longest_first: bool = False) -> Column:
    """Array sorted by text length, equal lengths in their given order."""
    sign = -1 if longest_first else 1
    keyed = F.transform(values, lambda v, i: F.struct((F.length(v) * sign).alias("n"), i.alias("i"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


def top_n(df: DataFrame, n: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows, per group when ``by`` is given."""
    if not by:
        return df.orderBy(*order).limit(n)
    ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_rn") <= n).drop("_rn")


def first_wins_dedupe(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key. Spark keeps one row per key and task before the shuffle."""
    return top_n(df, 1, [F.col(o) if isinstance(o, str) else o for o in order], key)


def union_distinct(*frames: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.dropDuplicates(list(keys)) if keys else out.distinct()


def intersect_sources(field_sources: DataFrame, type_sources: DataFrame) -> DataFrame:
    """Field sources that are also sources of the type."""
    return field_sources.join(type_sources.select("source"), "source", "left_semi")


def except_codes(catalog: DataFrame, local: DataFrame, key: str = "item_code") -> DataFrame:
    return catalog.join(local.select(key), key, "left_anti")
