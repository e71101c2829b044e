"""Streaming twins of the incremental jobs.

State is keyed and bounded by a watermark or a timeout everywhere; checkpoints go to the folder the
caller passes as ``checkpointLocation``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogfuse.functions.paths import extension, file_name, is_scannable, parent_dir
from catalogfuse.plans.skew import runs

FILE_SCHEMA = "path string, size bigint, mtime timestamp"


def stream_inventory(
    spark: SparkSession, folder: str, exts: Sequence[str], horizon: str = "1 day", fmt: str = "json"
) -> DataFrame:
    """New inventory rows of a folder of listings, each path once within the horizon."""
    raw = spark.readStream.format(fmt).schema(FILE_SCHEMA).load(folder)
    return dedupe_inventory(raw, exts, horizon)


def dedupe_inventory(raw: DataFrame, exts: Sequence[str], horizon: str = "1 day") -> DataFrame:
    """Scannable files, each path once within ``horizon`` of its arrival. The clock is that of arrival, so no row is too
    late, and the state holds the paths of one horizon whatever their dates; ``only_new_paths`` catches older repeats."""
    rows = raw.where(extension("path").isin(*exts) & is_scannable("path"))
    rows = rows.withColumn("dir", parent_dir("path")).withColumn("name", file_name("path")).withColumn("_seen", F.current_timestamp())
    return rows.withWatermark("_seen", horizon).dropDuplicatesWithinWatermark(["path"]).drop("_seen")


def only_new_paths(rows: DataFrame, ledger: str, checkpoint: str, bits: int = 27, buckets: int = 256):
    """Append the rows whose path no earlier batch had to ``ledger``. Returns the started query; read the rows with :func:`new_paths`.

    A bitmap of 2 ** ``bits`` hashed paths, at most 2 ** (bits - 15) rows of 4 kB, follows the ledger. A path whose bit is clear is new
    for certain. Only the others meet the ledger, and of it only the hash buckets that they fall into; a batch
    without such paths reads none of it. A repeated batch replaces itself: it reads what was before it.
    """
    place = F.pmod(F.xxhash64("path"), F.lit(1 << bits)) + 1
    keyed = {"bucket": F.pmod(F.xxhash64("path", F.lit(1)), F.lit(buckets)).cast("int"), "_block": F.bitmap_bucket_number(place), "_bit": F.bitmap_bit_position(place)}

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        found = batch.withColumns(keyed)
        earlier = _batches_before(spark, f"{ledger}/seen", batch_id)
        fresh = found
        if earlier:
            seen = spark.read.parquet(f"{ledger}/seen/batch={earlier[-1]}")
            octet = F.conv(F.hex(F.substring(F.col("held"), (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            known = F.coalesce(F.call_function("getbit", octet, (F.col("_bit") % 8).cast("int")) == 1, F.lit(False))
            gated = found.join(seen, "_block", "left").withColumn("_known", known).drop("held")
            maybe = gated.where("_known").drop("_known")
            fresh = gated.where("not _known").drop("_known")
            wanted = [r.bucket for r in maybe.select("bucket").distinct().collect()]  # at most ``buckets``
            if wanted:
                rows_ = spark.read.parquet(f"{ledger}/rows").where(F.col("batch").isin(*earlier) & F.col("bucket").isin(*wanted))
                fresh = fresh.unionByName(maybe.join(rows_.select("bucket", "path"), ["bucket", "path"], "left_anti"))
        target = f"{ledger}/rows/batch={batch_id}"
        fresh.drop("_block", "_bit").write.mode("overwrite").partitionBy("bucket").parquet(target)
        bits_of = spark.read.parquet(target).select("path").withColumns(keyed).groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("held"))
        if earlier:
            bits_of = bits_of.unionByName(seen).groupBy("_block").agg(F.bitmap_or_agg("held").alias("held"))
        bits_of.write.mode("overwrite").parquet(f"{ledger}/seen/batch={batch_id}")

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_paths(spark: SparkSession, ledger: str) -> DataFrame:
    return spark.read.parquet(f"{ledger}/rows").drop("bucket", "batch")


def _batches_before(spark: SparkSession, folder: str, batch_id: int) -> list[int]:
    """The batches that were written whole below ``folder``, but for this one and later ones."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [s.getPath() for s in files.listStatus(path)]
    done = [int(p.getName().partition("=")[2]) for p in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(b for b in done if b < batch_id)


def batch_first_result(events: DataFrame) -> DataFrame:
    """One resolution per code over a complete table ``events(item_code, path, kind, ok, seq)``: outcome of
    every request given the code's first result."""
    first = events.groupBy("item_code").agg(
        F.min(F.when(F.col("kind") == "request", F.struct("seq", "path"))).alias("_owner"),
        F.min(F.when(F.col("kind") == "result", F.struct("seq", "ok"))).alias("_result"),
    )
    outcome = (
        F.when(F.col("path") == F.col("_owner.path"), "resolve")
        .when(F.col("_result.ok"), "reused")
        .when(~F.col("_result.ok"), "rejected")
        .otherwise("wait")
    )
    requests = events.where(F.col("kind") == "request")
    return requests.join(first, "item_code").select("item_code", "path", "seq", outcome.alias("outcome"))


def stream_fuse(
    observations: DataFrame, fuse: Callable[[DataFrame], DataFrame], sources: Sequence[str], order: Sequence[str], items: str, checkpoint: str,
    keys: Sequence[str] = ("item_code",),
):
    """Keep an item table current while observations arrive. Returns the started query.

    The stream's state holds, per item, each ranked source's first record by ``order``: what fusion reads of all
    history, and a least value per source, so a batch merges into it and no earlier record is read again. ``sources`` are those
    of the priority table, which bounds the state of an item. A batch writes its touched items, fused anew from their
    state, as its own folder of ``items``, so a repeated batch replaces itself. Readers use :func:`current_items`.
    """
    rest = [c for c in observations.columns if c not in (*keys, "source", *order)]
    record = F.struct(*order, *rest)
    first = [F.min(F.when(F.col("source") == s, record)).alias(f"_s{i}") for i, s in enumerate(sources)]
    state = observations.where(F.col("source").isin(*sources)).groupBy(*keys).agg(*first)
    records = F.array(*[F.struct(F.lit(s).alias("source"), F.col(f"_s{i}").alias("r")) for i, s in enumerate(sources)])

    def step(batch: DataFrame, batch_id: int) -> None:
        held = batch.select(*keys, F.inline(F.filter(records, lambda x: x["r"].isNotNull()))).select(*keys, "source", "r.*")
        fuse(held).write.mode("overwrite").parquet(f"{items}/changes/batch={batch_id}")

    return state.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_items(spark: SparkSession, items: str, keys: Sequence[str] = ("item_code",)) -> DataFrame:
    """Latest fused row of every item: the compacted table and the changes since."""
    upto = _batches_before(spark, f"{items}/base", 2**62)
    rows = spark.read.parquet(f"{items}/changes")
    if upto:
        base = spark.read.parquet(f"{items}/base/upto={upto[-1]}").withColumn("batch", F.lit(upto[-1]))
        rows = rows.where(F.col("batch") > upto[-1]).unionByName(base)
    value = [c for c in rows.columns if c not in (*keys, "batch")]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*value), "batch").alias("_r"))
    return latest.select(*keys, "_r.*")


def compact_items(spark: SparkSession, items: str, keys: Sequence[str] = ("item_code",)) -> None:
    """Merge the changes so far into one table, so that reading costs the items and not the batches."""
    done = _batches_before(spark, f"{items}/changes", 2**62)
    if done:
        current_items(spark, items, keys).write.mode("overwrite").parquet(f"{items}/base/upto={done[-1]}")


def error_bursts(events: DataFrame, gap: str = "2 seconds", by: Sequence[str] = ("source",), delay: str = "10 minutes") -> DataFrame:
    """Bursts of throttled responses per key: (by, start, end, errors), where ``end`` is a gap after the last response.

    A stream keeps session windows. A table is scanned by summaries of short spans of time (``plans.skew.runs``), so a key
    that has nearly all rows is many tasks' work.
    """
    if events.isStreaming:
        rows = events.withWatermark("ts", delay)
        return rows.groupBy(*by, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("errors")).select(
            *by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "errors"
        )
    secs = pd.Timedelta(gap).total_seconds()
    at = lambda c: F.timestamp_micros(c)
    return runs(events, by, "ts", secs, closed=True).select(
        *by, at(F.col("first")).alias("start"), at(F.col("last") + int(secs * 1_000_000)).alias("end"), F.col("rows").alias("errors")
    )


def burst_levels(bursts: DataFrame, by: Sequence[str] = ("source",), cap: int = 6) -> DataFrame:
    """Penalty level of every burst: its number per key, capped.

    Only the first ``cap`` bursts of a key need a number; they are found with a top-k window that
    Spark cuts down per task, and all later ones are at the cap.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy(*by).orderBy("start")
    early = bursts.select(*by, "start", F.row_number().over(order).alias("level")).where(F.col("level") <= cap)
    return bursts.join(early, [*by, "start"], "left").withColumn("level", F.coalesce("level", F.lit(cap)))


def windowed_counts(
    events: DataFrame, width: str = "1 hour", slide: str | None = None, by: Sequence[str] = ("status",), delay: str = "10 minutes"
) -> DataFrame:
    """Run counters per time window; on a stream, rows later than the delay are dropped."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(span.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), *by, "n"
    )
