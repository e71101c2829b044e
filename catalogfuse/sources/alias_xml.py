"""Alias tables stored as XML attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keyword_list(c: Column) -> Column:
    """``,one,two,`` to its entries."""
    return F.filter(F.split(F.btrim(c, F.lit(",")), ","), lambda k: k != "")


def read_alias_table(
    spark: SparkSession, path: str, languages: Sequence[str] = ("zh_cn", "zh_tw", "jp"), row_tag: str = "a"
) -> DataFrame:
    """``aliases(ord, canonical, keywords, href)`` from rows with one attribute per language.

    ``ord`` follows the document: the reader keeps file order inside a partition and partitions in
    order, and an alias document is one file. Several files have no order among them and are refused.
    """
    names = [*languages, "keyword", "href"]
    schema = T.StructType([T.StructField(f"_{n}", T.StringType()) for n in names])
    raw = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "_").schema(schema).load(path)
    if len(raw.inputFiles()) > 1:
        raise ValueError("an alias table is one document: read several one by one, in their order")
    return alias_rows(raw.withColumn("ord", F.monotonically_increasing_id()), languages, prefix="_")


def alias_rows(raw: DataFrame, languages: Sequence[str], prefix: str = "") -> DataFrame:
    pairs = [x for lang in languages for x in (F.lit(lang), F.trim(F.col(prefix + lang)))]
    return raw.select(
        "ord", F.create_map(*pairs).alias("canonical"), keyword_list(F.col(prefix + "keyword")).alias("keywords"),
        F.col(prefix + "href").alias("href"),
    )
