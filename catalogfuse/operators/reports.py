"""Quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogfuse.plans.skew import exact_percentiles


def run_report(ledger: DataFrame) -> DataFrame:
    """Totals of a run and the mean seconds per item."""
    total, ok = F.count(F.lit(1)), F.count_if(F.col("status") == "ok")
    return ledger.agg(
        total.alias("total"), ok.alias("success"), (total - ok).alias("failed"), F.round(F.avg("secs"), 2).alias("mean_secs")
    )


def failed_items(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("status") != "ok").select("path", "item_code", "reason")


# List modes as (picture, text) requirements; None is any.
LIST_MODES = {
    "all": (None, None),
    "image_and_text": (True, True),
    "text_only": (False, True),
    "image_only": (True, False),
    "neither": (False, False),
    "has_text": (None, True),
    "no_text": (None, False),
    "has_image": (True, None),
    "no_image": (False, None),
}


def list_people(people: DataFrame, mode: str) -> DataFrame:
    image, text = LIST_MODES[mode]
    out = people if image is None else people.where(F.col("has_image") == image)
    return out if text is None else out.where(F.col("has_text") == text)


def completeness_report(people: DataFrame) -> DataFrame:
    """Counts over has_image x has_text with both margins and the total."""
    flag = lambda c: F.when(F.grouping(c) == 1, "any").when(F.col(c), "yes").otherwise("no")
    return people.cube("has_image", "has_text").agg(
        flag("has_image").alias("image"), flag("has_text").alias("text"), F.count(F.lit(1)).alias("n")
    ).select("image", "text", "n")


def duplicate_targets(df: DataFrame, target: str = "target", path: str = "path") -> DataFrame:
    """Inputs that map to the same output path: every such input, and whether it is the one kept.

    The group is reduced to its first path and its size; inputs are joined back, so a target with
    very many inputs is never gathered in one place.
    """
    groups = df.groupBy(target).agg(F.min(path).alias("kept"), F.count(F.lit(1)).alias("inputs"))
    clashes = groups.where(F.col("inputs") > 1)
    return df.select(target, path).join(clashes, target).select(
        target, path, "inputs", (F.col(path) == F.col("kept")).alias("is_kept")
    )


def fetch_report(
    log: DataFrame, by: Sequence[str] = ("source",), ratios: Sequence[float] = (0.5, 0.9, 0.99), span_secs: Column | None = None
) -> DataFrame:
    """Totals, success rate, rate per second and exact nearest-rank latency percentiles.

    ``log(<by>, ok, secs, ts)``.
    """
    total, ok = F.count(F.lit(1)), F.count_if(F.col("ok"))
    span = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    counts = log.groupBy(*by).agg(
        total.alias("total"), ok.alias("success"), (total - ok).alias("failed"),
        F.round(ok * 100 / total, 2).alias("success_pct"),
        F.round(total / F.nullif(span / 1e6, F.lit(0.0)), 4).alias("per_sec"),
    )
    quantiles = exact_percentiles(log, list(by), "secs", ratios)
    return counts.join(quantiles, list(by), "left")


def top_errors(log: DataFrame, error: str = "error", n: int = 5) -> DataFrame:
    counts = log.where(F.col(error).isNotNull() & (F.col(error) != "")).groupBy(error).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), error).limit(n)


def status_counts(log: DataFrame, status: str = "status") -> DataFrame:
    return log.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def person_catalog(listing: DataFrame, single_works: DataFrame, order: str = "pos") -> DataFrame:
    """Catalogue of every person: code, date as y/m/d, single-work flag, availability class.

    ``listing(person, item_code, pos, title, date_text, url, has_download, has_subtitle)``,
    ``single_works(person, item_code)``. The last listing row of a person's code, by ``order``, wins.
    """
    rest = [c for c in listing.columns if c not in ("person", "item_code")]
    last = listing.groupBy("person", "item_code").agg(F.max_by(F.struct(*rest), order).alias("_r"))
    listing = last.select("person", "item_code", "_r.*")
    parts = F.split("date_text", "[./-]")
    date = F.when(F.length(parts[0]) == 2, F.concat_ws("/", parts[2], parts[0], parts[1])).otherwise(
        F.concat_ws("/", parts[0], parts[1], parts[2])
    )
    klass = F.when(F.col("has_subtitle"), "subtitle").when(F.col("has_download"), "download").otherwise("none")
    single = single_works.select("person", "item_code").distinct().withColumn("_single", F.lit(True))
    return listing.join(single, ["person", "item_code"], "left").select(
        "person", "item_code", "title", date.alias("date"), "url", klass.alias("availability"),
        F.coalesce("_single", F.lit(False)).alias("single_work"),
    )
