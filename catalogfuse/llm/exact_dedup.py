"""Exact duplicates by a sort of the contents.

The normalised texts are range-partitioned by splitters that Spark samples, sorted externally inside
the ranges, and equal texts end up side by side, where a window compares each row's whole text with
its neighbour's. Nothing but JVM expressions runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalogfuse.llm.common import SPACE, parts, query, table, texts


def exact_dedup(docs: DataFrame, head_chars: int = 64, pieces: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after each run of white space became one space. The row with the
    smallest doc_id of a group stays.

    The splitters are sampled from the first ``head_chars`` characters, so the sample stays small
    whatever the texts' length; texts with an equal head are told apart by a hash before the texts
    themselves are compared. A group is sorted in ``pieces`` pieces dealt by doc_id (the session's shuffle
    partitions unless given), so a text that a third of the rows share is no single task's; the pieces' small
    heads are then merged by the digest of the text.

    A null text is an empty one. A row without doc_id stays only where its group has no row with one;
    of rows that repeat a doc_id and its text, one stays. An empty table gives an empty result.
    """
    pieces = pieces or parts(docs.sparkSession)
    norm = texts(docs).select("doc_id", F.regexp_replace("text", f"{SPACE}+", " ").alias("norm"))
    keyed = norm.select(
        "doc_id", "norm", F.substring("norm", 1, head_chars).alias("head"), F.xxhash64("norm").alias("mix"),
        F.pmod(F.xxhash64("doc_id"), F.lit(pieces)).alias("piece"),
    )
    same = W.partitionBy("head", "mix", "piece", "norm")
    sorted_rows = keyed.repartitionByRange(parts(docs.sparkSession), "head", "mix", "piece").select(
        "doc_id", "piece", F.sha2("norm", 256).alias("text_sha256"),
        F.row_number().over(same.orderBy(F.col("doc_id").asc_nulls_last())).alias("rank"),
        F.min("doc_id").over(same).alias("piece_min"), F.count(F.lit(1)).over(same).alias("piece_rows"),
    )
    heads = sorted_rows.where("rank = 1").select("text_sha256", "piece", "piece_min", "piece_rows")
    groups = heads.groupBy("text_sha256").agg(
        F.min("piece_min").alias("keep_id"), F.sum("piece_rows").alias("group_size"),
        F.min(F.struct(F.col("piece_min").isNull(), "piece_min", "piece")).getField("piece").alias("keep_piece"),
    )
    placed = heads.select("text_sha256", "piece").join(groups, "text_sha256")
    return sorted_rows.join(placed, ["text_sha256", "piece"]).select(
        "doc_id", "keep_id", "group_size", ((F.col("rank") == 1) & (F.col("piece") == F.col("keep_piece"))).alias("kept"), "text_sha256"
    )


@query(
    "op1_exact_dedup",
    r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY t)
    """,
)
def _query(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))
