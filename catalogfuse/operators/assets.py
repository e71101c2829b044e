"""Choice of one asset among several."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogfuse.functions.basics import as_col, first_hit
from catalogfuse.functions.urls import asset_rank, is_playlist

# An asset smaller than these shares of the crop loses to the crop; and the size from
# which an existing asset is good enough.
MIN_CROP_AREA, MIN_CROP_HEIGHT, GOOD_BYTES = 0.70, 0.80, 400 * 1024


def best_asset(df: DataFrame, key: str = "item_code", url: str = "url", seq: str = "seq") -> DataFrame:
    """Address of the highest quality rank per item; the earlier one wins ties; playlists never."""
    usable = df.where((F.col(url) != "") & ~is_playlist(url))
    return usable.groupBy(key).agg(
        F.min_by(url, F.struct((-asset_rank(url)).alias("r"), F.col(seq).alias("s"))).alias("best"),
        F.max(asset_rank(url)).alias("best_rank"),
    )


def variant_score(variant: Column, preferred: Sequence[str]) -> Column:
    """Score of a product variant: preferred source 20, picture 5, runtime 2, one per sample."""
    source = F.lower(F.coalesce(variant["source"], F.lit("")))
    liked = first_hit([(source.contains(p), F.lit(20)) for p in preferred], F.lit(0))
    return (
        liked
        + F.when(F.coalesce(variant["image_url"], F.lit("")) != "", 5).otherwise(0)
        + F.when(F.coalesce(variant["volume"].cast("string"), F.lit("")) != "", 2).otherwise(0)
        + F.coalesce(F.size(variant["samples"]), F.lit(0))
    )


def best_variant(df: DataFrame, variants: str = "variants", preferred: Sequence[str] = ()) -> DataFrame:
    """Best variant of each row's own array, first of equals; and the longest sample list, ties by
    being the best variant, then by score."""
    scored = F.transform(
        variants, lambda v, i: F.struct(variant_score(v, preferred).alias("score"), (-i).alias("i"), v.alias("v"))
    )
    staged = df.withColumn("_s", scored).withColumn("_best", F.array_max("_s"))
    with_samples = F.filter("_s", lambda s: F.coalesce(F.size(s["v"]["samples"]), F.lit(0)) > 0)
    by_samples = F.array_max(
        F.transform(
            with_samples,
            lambda s: F.struct(
                F.size(s["v"]["samples"]).alias("n"),
                (s["i"] == F.col("_best.i")).cast("int").alias("own"),
                s["score"].alias("score"),
                s["i"].alias("i"),
                s["v"]["samples"].alias("samples"),
            ),
        )
    )
    return staged.select(
        *df.columns, F.col("_best.v").alias("best"), F.col("_best.score").alias("best_score"),
        by_samples["samples"].alias("samples"),
    )


def right_crop_size(w: Column | str, h: Column | str) -> Column:
    """Size of the right part cut from a wide cover."""
    w, h = as_col(w), as_col(h)
    # Cut columns of the known cover sizes.
    left = (
        F.when((w == 800) & (h == 439), F.lit(420.0))
        .when((w == 800) & h.between(499, 503), 437.0)
        .when(w == 800, 421.0)
        .when((w == 840) & (h == 472), 473.0)
        .otherwise(w / 1.9)
    )
    right = F.when((w == 840) & (h == 472), 788).otherwise(w)
    known = (w > 0) & (h > 0)
    return F.struct(
        F.when(known, F.greatest(F.floor(right - left).cast("int"), F.lit(0))).otherwise(0).alias("w"),
        F.when(known, h).otherwise(0).alias("h"),
    )


def _worse_than_crop(area: Column, height: Column, crop_w: Column, crop_h: Column) -> Column:
    known = (crop_w > 0) & (crop_h > 0)
    return known & ((area < crop_w * crop_h * MIN_CROP_AREA) | (height < crop_h * MIN_CROP_HEIGHT))


def select_by_area(df: DataFrame, key: str = "item_code") -> DataFrame:
    """Largest asset of known size per item, NULL when clearly smaller than the crop; with no known
    size the first one.

    Reads ``url, seq, w, h, crop_w, crop_h`` (the crop repeated on an item's rows).
    """
    area = F.greatest(F.col("w"), F.lit(0)) * F.greatest(F.col("h"), F.lit(0))
    known = (F.col("w") > 0) & (F.col("h") > 0)
    best = F.min(F.when(known, F.struct((-area).alias("a"), F.col("seq").alias("s"), F.col("url").alias("url"), F.col("h").alias("h"))))
    grouped = df.groupBy(key).agg(
        best.alias("_b"), F.min_by("url", "seq").alias("_first"), F.max("crop_w").alias("_cw"), F.max("crop_h").alias("_ch")
    )
    worse = _worse_than_crop(-F.col("_b.a"), F.col("_b.h"), F.col("_cw"), F.col("_ch"))
    return grouped.select(
        key,
        F.when(F.col("_b").isNull(), F.col("_first")).when(worse, F.lit(None).cast("string")).otherwise(F.col("_b.url")).alias("selected"),
        F.when(F.col("_b").isNull(), "first").when(worse, "crop").otherwise("largest").alias("how"),
    )


def skip_search(
    poster: Column | str, source: Column | str, w: Column | str, h: Column | str, size_bytes: Column | str,
    crop_w: Column | str, crop_h: Column | str, searched_source: str, compare_crop: Column | bool = True,
) -> Column:
    """The asset at hand is good enough to skip the search: known size, not worse than the crop, big file."""
    poster, source, w, h = as_col(poster), as_col(source), as_col(w), as_col(h)
    compare = compare_crop if isinstance(compare_crop, Column) else F.lit(compare_crop)
    worse = compare & _worse_than_crop(w * h, h, as_col(crop_w), as_col(crop_h))
    good = (
        (poster != "") & (source != searched_source) & (w > 0) & (h > 0) & ~worse
        & (as_col(size_bytes) >= GOOD_BYTES)
    )
    return F.coalesce(good, F.lit(False))


def prefer_edition_asset(
    df: DataFrame, categories: Sequence[str], key: str = "item_code", late_medium: str = "bluray"
) -> DataFrame:
    """Record with a picture that comes first by (late medium, category rank, result order, url).

    ``categories`` are best first. Reads ``thumb, medium, category, seq, url``.
    """
    rank = first_hit([(F.col("category") == c, F.lit(i)) for i, c in enumerate(categories)], F.lit(len(categories)))
    order = F.struct((F.col("medium") == late_medium).cast("int").alias("m"), rank.alias("c"), F.col("seq").alias("s"), F.col("url").alias("u"))
    return df.where(F.col("thumb") != "").groupBy(key).agg(
        F.min_by(F.struct("url", "thumb", "category", "medium"), order).alias("_r")
    ).select(key, "_r.*")
