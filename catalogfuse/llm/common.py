"""What the operators of this subpackage share: tables, the shared folder, the registry."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# The white space of all word and line rules here: space, and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` and, where SQL can express it, its twin."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """The columns an operator uses and no others: extra columns never clash with its own; a null text is empty."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A folder of this machine only where all tasks run in the driver."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: the rows as a table in the shared folder, read back. Tasks that are lost later read it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the table of a frame that ``written`` gave, once all that was made from it is written itself."""
    spark, files = df.sparkSession, df.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


SIEVE = 1 << 24  # bits


def sifted(df: DataFrame, column: str, keys: DataFrame, outside: bool = False) -> DataFrame:
    """The rows of ``df`` that may have a key of ``keys`` (same column name), before any shuffle; ``outside``: all others.

    What is broadcast is a set of hashed keys as bits, 64 in a row: SIEVE / 64 rows at most however many keys there are. Rows
    with another key of the same bit pass as well: a join has to follow.
    """
    bit = F.pmod(F.xxhash64(column), F.lit(SIEVE))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bit").bitwiseAND(F.lit(63)).cast("int"))
    held = keys.select(bit.alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.bit_or(one).alias("_bits"))
    met = (F.shiftright("_bit", 6) == F.col("_word")) & (F.col("_bits").bitwiseAND(one) != 0)
    return df.withColumn("_bit", bit).join(F.broadcast(held), met, "left_anti" if outside else "left_semi").drop("_bit")


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

