"""Shards and slots computed from a permuted global row number.

A Feistel network over Z_a x Z_b permutes the row numbers 0 .. n-1 (a * b is the least such product that is at
least n); a value that falls on or beyond n walks the cycle until it is below. Shard and slot follow from
the permuted number by division, so any row's place can be computed from its number, the seed and n.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalogfuse.llm.common import parts, query, table, texts

WALKS = 64


def feistel(x: Column, n: int, seed: int, rounds: int = 6) -> Column:
    """The permutation of 0 .. n-1 at ``x``.

    Fewer than ``a`` of the ``a * b`` values lie beyond ``n``, so a walk beyond ``WALKS`` steps has a chance of
    about n ** -32; it ends the job with an error rather than give a wrong place.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))

    def once(value: Column) -> Column:
        # One lambda step per round: the halves are columns of a struct, so no expression is repeated.
        start = F.struct((value % a).cast("bigint").alias("l"), F.floor(value / a).cast("bigint").alias("r"))

        def step(s: Column, i: Column) -> Column:
            even = i % 2 == 0
            other = F.when(even, s["r"]).otherwise(s["l"])
            mixed = F.xxhash64(other, i, F.lit(seed))
            return F.struct(
                F.when(even, F.pmod(s["l"] + F.pmod(mixed, F.lit(a)), F.lit(a))).otherwise(s["l"]).cast("bigint").alias("l"),
                F.when(even, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(mixed, F.lit(b)), F.lit(b))).cast("bigint").alias("r"),
            )

        return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda s: s["r"] * F.lit(a) + s["l"])

    walked = F.aggregate(
        F.sequence(F.lit(0), F.lit(WALKS)), F.lit(n).cast("bigint"),
        lambda v, i: F.when((i > 0) & (v < n), v).otherwise(once(F.when(i == 0, x).otherwise(v))),
    )
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("the permutation's cycle is longer than its bound")).cast("bigint"))


def numbered(rows: DataFrame, key: Column, order: list[str], buckets: int) -> DataFrame:
    """Gapless global numbers ``row_no`` from 0, without one task that sees all rows.

    Rows are numbered inside ``buckets`` buckets of ``key``; a table of one row per bucket holds how many rows stand
    before it. Its size is ``buckets``, whatever the rows.
    """
    dealt = rows.withColumn("_b", F.pmod(key, F.lit(buckets)))
    counts = dealt.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_b", (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_before"))
    inside = dealt.withColumn("_i", F.row_number().over(W.partitionBy("_b").orderBy(*order)) - 1)
    return inside.join(F.broadcast(before), "_b").select(*rows.columns, (F.col("_before") + F.col("_i")).alias("row_no"))


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 20, buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    Counts per shard differ by one at most. Rerunning on the same rows gives the same places.
    A null text counts as empty (size 8). Rows that repeat a doc_id get places of their own; rows that are equal in
    doc_id, size and checksum may swap theirs. Rows without doc_id are dealt by their text's checksum.
    An empty table gives an empty result.
    """
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    n = docs.select(F.count(F.lit(1))).first()[0]
    buckets = buckets or 4 * parts(docs.sparkSession)
    placed = numbered(rows, F.xxhash64("doc_id", "text_crc32", "size"), ["doc_id", "text_crc32", "size"], buckets)
    return placed.withColumn("_p", feistel(F.col("row_no"), n, seed)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_p") % shards).cast("int").alias("shard"),
        F.floor(F.col("_p") / shards).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_no",
    )


def write_shards(docs: DataFrame, plan: DataFrame, folder: str) -> None:
    """The documents as Parquet, one folder per shard, in slot order inside it. ``plan`` needs one row per doc_id."""
    placed = docs.join(plan.select("doc_id", "shard", "slot"), "doc_id")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


@query("op10_sharding")
def _query(spark, sf_dir):
    return shard_rows(table(spark, sf_dir, "documents"))
