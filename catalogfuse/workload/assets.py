"""Queries that choose among assets."""

from pyspark.sql import functions as F

from catalogfuse.operators import assets as S
from catalogfuse.workload import fixtures as X
from catalogfuse.workload.registry import Tables, query
from catalogfuse.workload.urls import RANK_SQL

_CLIPS = """
SELECT 'P' || cast(l_partkey AS string) AS item_code, (l_orderkey * 10 + l_linenumber) * 100000000 + cast(floor(l_extendedprice * 100) AS bigint) AS seq,
  'http://v.example/' || cast(l_orderkey AS string) || CASE l_orderkey % 6 WHEN 0 THEN '_sm_w.mp4' WHEN 1 THEN 'dmb.mp4' WHEN 2 THEN '_mhbs_s.mp4' WHEN 3 THEN '/list.m3u8' WHEN 4 THEN '.mp4' ELSE '_4K_w.mp4' END AS url
FROM {lineitem}
"""


@query(
    "best_asset",
    X.cte(f=_CLIPS)
    + f", r AS (SELECT *, {RANK_SQL} AS rk FROM f WHERE NOT contains(url, '.m3u8')) SELECT item_code, arg_min(url, (-rk, seq)) AS best, max(rk) AS best_rank FROM r GROUP BY 1",
)
def best_asset(t: Tables):
    return S.best_asset(t.sql(_CLIPS))


_VARIANTS = """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'shop.example' ELSE 'other' END AS s1, CASE WHEN p_size % 3 = 0 THEN 'http://i' ELSE '' END AS i1, p_size % 4 AS n1,
  CASE WHEN p_size % 5 = 0 THEN 'SHOP.example' ELSE '' END AS s2, 'http://j' AS i2, p_partkey % 7 AS n2
FROM {part}
"""


@query(
    "best_variant",
    X.cte(f=_VARIANTS)
    + """, g AS (SELECT *, CASE WHEN contains(lower(s1), 'shop.example') THEN 20 ELSE 0 END + CASE WHEN i1 <> '' THEN 5 ELSE 0 END + CASE WHEN n1 > 0 THEN 2 ELSE 0 END + n1 AS a, CASE WHEN contains(lower(s2), 'shop.example') THEN 20 ELSE 0 END + 5 + n2 AS b FROM f)
      SELECT p_partkey, CASE WHEN a >= b THEN 'one' ELSE 'two' END AS best, greatest(a, b) AS best_score,
        CASE WHEN n1 = 0 AND n2 = 0 THEN NULL WHEN n1 > n2 THEN 'one' WHEN n2 > n1 THEN 'two' WHEN a >= b THEN 'one' ELSE 'two' END AS samples_of FROM g""",
)
def best_variant(t: Tables):
    def variant(tag, source, image, volume, n):
        samples = F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i > 0), lambda i: F.concat(F.lit(tag), i.cast("string")))
        return F.struct(source.alias("source"), image.alias("image_url"), volume.alias("volume"), samples.alias("samples"), F.lit(tag).alias("tag"))

    c = F.col
    volume = F.when(c("n1") > 0, F.lit("90")).otherwise("")
    n2 = c("n2").cast("int")
    both = F.array(variant("one", c("s1"), c("i1"), volume, c("n1")), variant("two", c("s2"), c("i2"), F.lit(""), n2))
    out = S.best_variant(t.sql(_VARIANTS).withColumn("variants", both), preferred=("shop.example",))
    of = F.regexp_extract(F.get("samples", F.lit(0)), "^[a-z]+", 0)
    return out.select("p_partkey", c("best.tag").alias("best"), "best_score", of.alias("samples_of"))


_SIZES = """
SELECT 'P' || cast(l_partkey AS string) AS item_code, (l_orderkey * 10 + l_linenumber) * 100000000 + cast(floor(l_extendedprice * 100) AS bigint) AS seq, 'u' || cast(l_orderkey AS string) AS url,
  CASE WHEN l_suppkey % 3 = 0 OR l_partkey % 17 = 0 THEN 0 ELSE cast(floor(l_quantity * 10) AS int) END AS w, cast(floor(l_quantity * 15) AS int) AS h, cast(l_partkey % 500 AS int) AS crop_w, cast(700 AS int) AS crop_h
FROM {lineitem}
"""


@query(
    "select_by_area",
    X.cte(f=_SIZES)
    + """, g AS (SELECT item_code, arg_min(url, (-w * h, seq)) FILTER (w > 0 AND h > 0) AS u, arg_min(h, (-w * h, seq)) FILTER (w > 0 AND h > 0) AS bh, max(w * h) FILTER (w > 0 AND h > 0) AS ba, arg_min(url, seq) AS u1, max(crop_w) AS cw, max(crop_h) AS ch FROM f GROUP BY 1)
      SELECT item_code, CASE WHEN u IS NULL THEN u1 WHEN cw > 0 AND (ba < cw * ch * 0.7 OR bh < ch * 0.8) THEN NULL ELSE u END AS selected, CASE WHEN u IS NULL THEN 'first' WHEN cw > 0 AND (ba < cw * ch * 0.7 OR bh < ch * 0.8) THEN 'crop' ELSE 'largest' END AS how FROM g""",
)
def select_by_area(t: Tables):
    return S.select_by_area(t.sql(_SIZES))


_POSTERS = """
SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'http://p' END AS poster, CASE WHEN o_orderkey % 5 = 0 THEN 'shop' ELSE 'site' END AS source, cast(o_custkey % 700 AS int) AS w, cast(o_custkey % 1000 AS int) AS h,
  cast(o_totalprice * 4 AS bigint) AS bytes, cast(CASE o_orderkey % 4 WHEN 0 THEN 800 WHEN 1 THEN 840 WHEN 2 THEN 0 ELSE 1000 END AS int) AS tw, cast(CASE o_orderkey % 3 WHEN 0 THEN 439 WHEN 1 THEN 500 ELSE 472 END AS int) AS th
FROM {orders}
"""


@query(
    "skip_search",
    X.cte(f=_POSTERS)
    + """, c AS (SELECT *, CASE WHEN tw = 800 AND th = 439 THEN 380 WHEN tw = 800 AND th BETWEEN 499 AND 503 THEN 363 WHEN tw = 800 THEN 379 WHEN tw = 840 AND th = 472 THEN 315 WHEN tw > 0 THEN CAST(floor(tw - tw / 1.9::DOUBLE) AS INT) ELSE 0 END AS cw, CASE WHEN tw > 0 THEN th ELSE 0 END AS ch FROM f)
      SELECT o_orderkey, cw AS crop_w, poster <> '' AND source <> 'shop' AND w > 0 AND h > 0 AND NOT (cw > 0 AND ch > 0 AND (w * h < cw * ch * 0.7 OR h < ch * 0.8)) AND bytes >= 409600 AS skip FROM c""",
)
def skip_search(t: Tables):
    rows = t.sql(_POSTERS).withColumn("crop", S.right_crop_size("tw", "th"))
    skip = S.skip_search("poster", "source", "w", "h", "bytes", F.col("crop.w"), F.col("crop.h"), "shop")
    return rows.select("o_orderkey", F.col("crop.w").alias("crop_w"), skip.alias("skip"))


_RECORDS = """
SELECT 'P' || cast(l_partkey AS string) AS item_code, l_linenumber AS seq, CASE WHEN l_orderkey % 4 = 0 THEN '' ELSE 'http://t/' || cast(l_orderkey AS string) END AS thumb, CASE WHEN l_suppkey % 2 = 0 THEN 'bluray' ELSE 'dvd' END AS medium,
  CASE l_suppkey % 3 WHEN 0 THEN 'digital' WHEN 1 THEN 'mono' ELSE 'odd' END AS category, 'http://d/' || cast(l_orderkey AS string) || '/' || cast(l_suppkey AS string) AS url
FROM {lineitem}
"""


@query(
    "prefer_edition_asset",
    X.cte(f=_RECORDS)
    + """, g AS (SELECT *, (CASE medium WHEN 'bluray' THEN 1 ELSE 0 END, CASE category WHEN 'digital' THEN 0 WHEN 'mono' THEN 1 ELSE 2 END, seq, url) AS k FROM f WHERE thumb <> '')
      SELECT item_code, arg_min(url, k) AS url, arg_min(thumb, k) AS thumb, arg_min(category, k) AS category, arg_min(medium, k) AS medium FROM g GROUP BY 1""",
)
def prefer_edition_asset(t: Tables):
    return S.prefer_edition_asset(t.sql(_RECORDS), ("digital", "mono"))
