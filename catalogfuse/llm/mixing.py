"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target / source size. Its whole part is
certain; the fractional part is a chance that pairs of documents trade: mass (chance times size) moves at random
from one to the other until one chance is 0 or 1, so a source's expected words never change and only one
document per block stays undecided (large ones trade first, so it is seldom a large one). Blocks' residuals meet in the next level's blocks: a reduction tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalogfuse.llm.common import WORD, query, table, written

STEP = 64
ITEM = "struct<size:bigint,h:bigint,doc_id:bigint,p:double>"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """source, source_size, target: ``weights`` repeat over the sources by code point, null last.

    Targets share the total by weight; what a target has beyond ``cap`` times its source's size is shared again
    among the rest. In order of size per weight the capped sources come first, so the level at which the sharing
    ends is found with running sums over the table of sources (one row each).
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double")
    w = per.select("source", "source_size", weight.alias("weight")).withColumn("limit", (F.col("source_size") * cap).cast("double"))
    fill = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(W.unboundedPreceding, -1)
    rest = fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    share = (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))) / F.sum("weight").over(rest)
    level = w.withColumn("share", share).withColumn("open", F.when(F.col("share") * F.col("weight") <= F.col("limit"), F.col("share")))
    first_open = F.first("open", ignorenulls=True).over(fill.rowsBetween(W.unboundedPreceding, W.currentRow))
    return level.withColumn("level", first_open).select(
        "source", "source_size",
        F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"),
    )


def _trade(seed: int, level: int):
    """One pivotal step: ``s`` holds the undecided document and what is decided; ``x`` comes in."""

    def step(s: Column, x: Column) -> Column:
        r = s["rest"]
        a, b = r["p"] * r["size"], x["p"] * x["size"]
        to_x = F.least(a, x["size"] - b)  # mass that may move from the one at rest to x
        to_r = F.least(b, r["size"] - a)
        chance = F.pmod(F.xxhash64(r["h"], x["h"], F.lit(seed), F.lit(level)), F.lit(1 << 52)) / float(1 << 52)
        moved = F.when(chance * (to_x + to_r) < to_r, to_x).otherwise(-to_r)

        def settled(p: Column) -> Column:  # the sums are floating point: a hair from 0 or 1 is 0 or 1
            return F.when(p < 1e-9, 0.0).when(p > 1 - 1e-9, 1.0).otherwise(p)

        def item(of: Column, p: Column) -> Column:
            return F.struct(of["size"].alias("size"), of["h"].alias("h"), of["doc_id"].alias("doc_id"), p.alias("p"))

        def after(m: Column) -> Column:
            r2 = item(r, settled((a - m) / r["size"]))
            x2 = item(x, settled((b + m) / x["size"]))
            done = r2["p"].isin(0.0, 1.0)
            return F.struct(
                F.when(done, x2).otherwise(r2).alias("rest"),
                F.concat(s["done"], F.array(F.when(done, r2).otherwise(x2))).alias("done"),
            )

        # transform over one element names the moved mass once
        return F.when(r.isNull(), F.struct(x.alias("rest"), s["done"].alias("done"))).otherwise(
            F.element_at(F.transform(F.array(moved), after), 1)
        )

    return step


def _row_hash(seed: int) -> Column:
    return F.xxhash64("doc_id", "source", "text", F.lit(seed))


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 9, tables: str = "mix"
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, h (a hash of the row).

    ``taken`` is ``copies`` times ``size``; a source's sum of it is its target to within its largest document, and
    no document is taken more than ``cap`` times. Reruns agree: every choice is a hash of ids and the seed.

    A null text and a null source count as a document of size 0 and as a source of its own, the last.
    Documents of size 0 take nothing. Rows that repeat a doc_id are documents of their own; rows alike in doc_id,
    source and size may swap decisions. An empty table gives an empty result.
    """
    sized = written(
        docs.select(
            "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), _row_hash(seed).alias("h"),
        ),
        tables,
    )
    targets = source_targets(sized, weights, cap)
    # As many blocks as keep the fullest one near STEP documents, a power of STEP, so that each level divides them.
    rows, levels = sized.count(), 1
    while STEP**levels < rows:
        levels += 1
    # The table of sources is as small as their number: one row each. Spark broadcasts it only when it measures so.
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = sized.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    known = known.withColumn("whole", F.floor(rate)).withColumn("p", rate - F.floor(rate))
    out = ["h", "doc_id", "size", "source_size", "target", "whole"]
    sure = known.where((F.col("size") == 0) | (F.col("p") < 1e-9)).select(*out, F.lit(0.0).alias("up"))
    level_rows = known.where((F.col("size") > 0) & (F.col("p") >= 1e-9))
    constant = ["source", "source_size", "target", "whole"]
    pending = level_rows.select(
        *constant, F.pmod(F.shiftright("h", 8), F.lit(STEP ** (levels - 1))).alias("block"), F.struct("size", "h", "doc_id", "p").cast(ITEM).alias("item")
    )
    results = [sure]
    for level in range(levels):
        empty = F.struct(F.lit(None).cast(ITEM).alias("rest"), F.array().cast(f"array<{ITEM}>").alias("done"))
        traded = written(
            pending.groupBy(*constant, "block").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
            .select(*constant, "block", F.aggregate("items", empty, _trade(seed, level)).alias("s")),
            tables,
        )
        done = traded.select(*constant, F.explode("s.done").alias("d"))
        results.append(done.select("d.h", "d.doc_id", "d.size", "source_size", "target", "whole", F.col("d.p").alias("up")))
        pending = traded.select(*constant, F.floor(F.col("block") / STEP).alias("block"), F.col("s.rest").alias("item"))
    # One undecided document per source is left. It goes to the nearer side, which leaves the sum nearest the target.
    results.append(
        pending.select(
            "item.h", "item.doc_id", "item.size", "source_size", "target", "whole", F.when(F.col("item.p") >= 0.5, 1.0).otherwise(0.0).alias("up")
        )
    )
    every = results[0]
    for more in results[1:]:
        every = every.unionByName(more)
    copies = (F.col("whole") + F.col("up")).cast("bigint")
    return every.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "h")


def mixed_documents(docs: DataFrame, seed: int = 9, **options) -> DataFrame:
    """The documents of the mix: each as many times as it is taken. Equal rows are one with the copies of all."""
    copies = mix_sources(docs, seed=seed, **options).groupBy("h").agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    rows = docs.select(_row_hash(seed).alias("h"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    taken = rows.dropDuplicates(["h"]).join(copies, "h")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies"))).select("row.*")


@query("op9_mixing")
def _query(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"))
