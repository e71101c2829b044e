"""File inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogfuse.functions.basics import contains_any
from catalogfuse.functions.paths import ancestors, extension, file_name, is_scannable, parent_dir

# A directory holding one of these files is skipped with everything below it.
SKIP_MARKERS = ("skip", ".skip", ".ignore")
SKIPPED_DIR_WORDS = ("behind the scenes",)


def list_files(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Every file under the roots. Only metadata columns are read, never the content."""
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*")
        .load(list(roots)).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    )
    return raw.withColumn("path", F.regexp_replace("path", "^file:/*", "/"))


def filter_inventory(
    files: DataFrame, exts: Sequence[str], ignore_dirs: Sequence[str] = (), skip_markers: Sequence[str] = SKIP_MARKERS
) -> DataFrame:
    """Scannable files of the wanted extensions.

    Ignored directories and directories with a marker file are dropped with their subtrees: a file
    is out when any of its ancestors is one of them.
    """
    rows = files.select(
        "path", parent_dir("path").alias("dir"), file_name("path").alias("name"), extension("path").alias("ext"), "size",
        *([F.col("mtime")] if "mtime" in files.columns else []),
    )
    marked = rows.where(F.col("name").isin(*skip_markers)).select(F.col("dir").alias("_bad"))
    wanted = rows.where(F.col("ext").isin(*[e.lower() for e in exts]) & is_scannable("path"))
    wanted = wanted.where(~contains_any("dir", SKIPPED_DIR_WORDS))
    if ignore_dirs:
        banned = [d.rstrip("/") for d in ignore_dirs]
        wanted = wanted.where(~F.exists(ancestors("path"), lambda d: d.isin(*banned)))
    hit = wanted.select("path", F.explode(ancestors("path")).alias("_bad")).join(marked.distinct(), "_bad", "left_semi")
    return wanted.join(hit.select("path").distinct(), "path", "left_anti")


def scan_inventory(
    spark: SparkSession, roots: Sequence[str], exts: Sequence[str], ignore_dirs: Sequence[str] = (),
    skip_markers: Sequence[str] = SKIP_MARKERS,
) -> DataFrame:
    """Sorted inventory of the roots."""
    return filter_inventory(list_files(spark, roots), exts, ignore_dirs, skip_markers).orderBy("path")
