"""Run ledger, code cache, people database and text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogfuse.schemas import LEDGER


def ledger_append(entries: DataFrame, path: str) -> None:
    """Append processed paths. Appending never rewrites what is there, so a lost task costs nothing."""
    names = [f.name for f in LEDGER.fields if f.name in entries.columns]
    entries.select(*names).write.mode("append").parquet(path)


def ledger_latest(ledger: DataFrame) -> DataFrame:
    """Latest entry of every path."""
    rest = [c for c in ledger.columns if c != "path"]
    order = F.struct("ts", *[c for c in rest if c != "ts"])
    return ledger.groupBy("path").agg(F.max(order).alias("_r")).select("path", *[F.col(f"_r.{c}").alias(c) for c in rest])


def ledger_read(spark: SparkSession, path: str) -> DataFrame:
    return ledger_latest(spark.read.schema(LEDGER).parquet(path))


def remaining_paths(todo: DataFrame, ledger: DataFrame, done: tuple[str, ...] = ("ok",)) -> DataFrame:
    """Work list without the paths whose latest entry is done."""
    return todo.join(ledger_latest(ledger).where(F.col("status").isin(*done)).select("path"), "path", "left_anti")


def upsert_code_cache(old: DataFrame, new: DataFrame, overwrite: bool = False) -> DataFrame:
    """``cache(path, item_code, has_sub)``: cached rows are reused, new paths added.

    ``overwrite`` prefers the new row instead.
    """
    first, second = (1, 0) if overwrite else (0, 1)
    both = old.withColumn("_o", F.lit(first)).unionByName(new.withColumn("_o", F.lit(second)))
    row = F.struct("_o", "item_code", "has_sub")
    return both.groupBy("path").agg(F.min(row).alias("_r")).select("path", "_r.item_code", "_r.has_sub")


def load_people_db(spark: SparkSession, names, info, **jdbc_options) -> tuple[DataFrame, DataFrame]:
    """(names, info) tables of a people database.

    ``names`` and ``info`` are parquet paths, or table names when JDBC options are given.
    """
    if jdbc_options:
        read = lambda t: spark.read.format("jdbc").options(dbtable=t, **jdbc_options).load()
        return read(names), read(info)
    return spark.read.parquet(names), spark.read.parquet(info)


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with the file they come from."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file"))


def write_lines(df: DataFrame, path: str, line: str = "line", mode: str = "overwrite") -> None:
    df.select(F.col(line).alias("value")).write.mode(mode).text(path)
