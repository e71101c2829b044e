"""URL and asset-address queries."""

from pyspark.sql import functions as F

from catalogfuse.functions import urls as U
from catalogfuse.workload import fixtures as X
from catalogfuse.workload.registry import Tables, query

FULL = "CASE WHEN contains(trim(url), '://') THEN trim(url) WHEN starts_with(trim(url), '//') THEN 'https:' || trim(url) ELSE 'https://' || trim(url) END"
_DOMAINS = (("tv.store.example", "tv"), ("store.example", "store"))
_CUSTOM = (("cdn.other", "other"),)


@query(
    "route_url",
    X.cte(f=X.URLS)
    + f"SELECT p_partkey, {FULL} AS url, CASE WHEN contains(lower(url), 'tv.store.example') THEN 'tv' WHEN contains(lower(url), 'store.example') THEN 'store' WHEN contains(url, 'cdn.other') THEN 'other' END AS source FROM f",
)
def route_url(t: Tables):
    rows = t.sql(X.URLS)
    return rows.select("p_partkey", U.with_scheme("url").alias("url"), U.route_url("url", _DOMAINS, _CUSTOM).alias("source"))


@query(
    "route_pages",
    "SELECT page_id, CASE WHEN contains(lower(url), 'blog.') THEN 'blog' WHEN contains(lower(url), 'www.') THEN 'www' WHEN contains(url, 'example.org') THEN 'org' END AS source FROM pages",
)
def route_pages(t: Tables):
    return t("pages").select("page_id", U.route_url("url", (("blog.", "blog"), ("WWW.", "www")), (("example.org", "org"),)).alias("source"))


_RE = "^([a-zA-Z][a-zA-Z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\\?[^#]*)?(#.*)?$"
_NORM = f"""n0 AS (SELECT *, regexp_extract(url, '{_RE}', 1) AS s, regexp_extract(url, '{_RE}', 2) AS h, regexp_extract(url, '{_RE}', 3) AS p, regexp_extract(url, '{_RE}', 4) AS q FROM f),
  n1 AS (SELECT *, lower(substr(h, 3)) AS host, CASE WHEN regexp_matches(lower(substr(h, 3)), '(store\\.example)$') THEN regexp_replace(p, '/{{2,}}', '/', 'g') ELSE p END AS p2,
    array_to_string(list_filter(string_split(substr(q, 2), '&'), lambda x: x NOT IN ('', 'w=120', 'h=90')), '&') AS q2 FROM n0),
  n2 AS (SELECT *, rtrim(s || h || p2 || CASE WHEN q2 <> '' THEN '?' || q2 ELSE '' END, '?&') AS norm FROM n1)"""
_FAMILY, _PROBE = ("store.example",), ("w=120", "h=90")


@query("normalize_asset_url", X.cte(f=X.URLS) + f", {_NORM} SELECT p_partkey, norm AS url FROM n2")
def normalize_asset_url(t: Tables):
    return t.sql(X.URLS).select("p_partkey", U.normalize_asset_url("url", _FAMILY, _PROBE).alias("url"))


@query(
    "flag_asset_url",
    X.cte(f=X.URLS)
    + f""", {_NORM} SELECT p_partkey, regexp_matches(lower(p), '\\.(jpg|jpeg|png|webp|gif|bmp|avif)$') AND regexp_matches(host, '(store\\.example)$') AS is_asset,
      contains(lower(url), 'now_printing') OR contains(lower(url), 'login') AS placeholder FROM n2""",
)
def flag_asset_url(t: Tables):
    return t.sql(X.URLS).select(
        "p_partkey", U.is_asset_url("url", _FAMILY).alias("is_asset"),
        U.is_placeholder_asset("url", ("now_printing", "login")).alias("placeholder"),
    )


_RULES = (("tv.store", "tv"), ("/digital/", "digital"), ("/mono/", "mono"), ("/rental/", "rental"))


@query(
    "url_category",
    X.cte(f=X.URLS)
    + "SELECT p_partkey, CASE WHEN contains(url, 'tv.store') THEN 'tv' WHEN contains(url, '/digital/') THEN 'digital' WHEN contains(url, '/mono/') THEN 'mono' WHEN contains(url, '/rental/') THEN 'rental' ELSE 'other' END AS category FROM f",
)
def url_category(t: Tables):
    return t.sql(X.URLS).select("p_partkey", U.url_category("url", _RULES).alias("category"))


_NAMES = "mmbs|hmbs|mhbs|hhbs|dmb|mmb|hmb|mhb|hhb|4ks|sm|dm|4k"
RANK_SQL = f"""CASE lower(coalesce(nullif(regexp_extract(url, '(?i)_({_NAMES})_[a-z]\\.mp4$', 1), ''), regexp_extract(url, '(?i)({_NAMES})\\.mp4$', 1)))
  WHEN 'sm' THEN 1 WHEN 'dm' THEN 2 WHEN 'dmb' THEN 3 WHEN 'mmb' THEN 4 WHEN 'mmbs' THEN 4 WHEN 'hmb' THEN 5 WHEN 'hmbs' THEN 5 WHEN 'mhb' THEN 6 WHEN 'mhbs' THEN 6
  WHEN 'hhb' THEN 7 WHEN 'hhbs' THEN 7 WHEN '4k' THEN 8 WHEN '4ks' THEN 8 ELSE 0 END"""


@query("asset_rank", X.cte(f=X.URLS) + f"SELECT p_partkey, {RANK_SQL} AS rank FROM f")
def asset_rank(t: Tables):
    return t.sql(X.URLS).select("p_partkey", U.asset_rank("url").alias("rank"))


@query(
    "asset_variants",
    X.cte(f=X.URLS)
    + f""", n AS (SELECT p_partkey, url AS u0, rtrim(url, '?&') AS u FROM f), m AS (SELECT p_partkey, CASE WHEN contains(u, '://') THEN u WHEN starts_with(u, '//') THEN 'https:' || u ELSE 'https://' || u END AS w FROM n),
      l AS (SELECT p_partkey, [CASE WHEN contains(w, 'pics.store.example') THEN replace(w, 'pics.store.example', 'big.store.example') END, 'https://big.store.example/' || p_partkey || '/' || p_partkey || 'pl.jpg', w,
        CASE WHEN ends_with(w, 'pl.jpg') THEN regexp_replace(w, 'pl\\.jpg$', 'ps.jpg') END] AS v FROM m)
      SELECT p_partkey, array_to_string(list_filter(v, lambda x, i: x IS NOT NULL AND list_position(v, x) = i), ' ') AS variants FROM l""",
)
def asset_variants(t: Tables):
    v = U.asset_variants(
        "url", ("pics.store.example", "big.store.example"), F.col("p_partkey").cast("string"),
        "https://big.store.example/{code}/{code}pl.jpg",
    )
    return t.sql(X.URLS).select("p_partkey", F.array_join(v, " ").alias("variants"))


_PAIRS = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'http://a/' || p_name || 'pl.jpg' WHEN 1 THEN '' WHEN 2 THEN 'http://a/t.png' ELSE '' END AS thumb, CASE p_partkey % 3 WHEN 0 THEN 'http://b/' || p_name || 'ps.jpg' WHEN 1 THEN '' ELSE 'http://b/p.png' END AS poster FROM {part}"


@query(
    "fill_thumb_poster",
    X.cte(f=_PAIRS)
    + """, b AS (SELECT *, CASE WHEN regexp_matches(thumb, '(pl|ps)\\.jpg$') THEN regexp_replace(thumb, '(pl|ps)\\.jpg$', '') WHEN regexp_matches(poster, '(pl|ps)\\.jpg$') THEN regexp_replace(poster, '(pl|ps)\\.jpg$', '') END AS base FROM f)
      SELECT p_partkey, coalesce(base || 'pl.jpg', nullif(thumb, ''), nullif(poster, '')) AS thumb, coalesce(base || 'ps.jpg', nullif(poster, ''), nullif(thumb, '')) AS poster FROM b""",
)
def fill_thumb_poster(t: Tables):
    return t.sql(_PAIRS).select("p_partkey", U.fill_thumb_poster("thumb", "poster").alias("x")).select("p_partkey", "x.*")


_GALLERY = """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'https://pics.store.example/adult/' || cast(p_partkey AS string) || '.jpg' END AS cover,
  'https://pics.store.example/adult/' || cast(p_partkey AS string) || '.jpg' AS g1, 'https://big.store.example/pics/adult/' || cast(p_partkey AS string) || '.jpg' AS g2, 'https://pics.store.example//adult/' || cast(p_partkey + 1 AS string) || '.jpg' AS g3
FROM {part}
"""


@query(
    "drop_cover_from_gallery",
    X.cte(f=_GALLERY) + "SELECT p_partkey, CASE WHEN cover = '' THEN g1 || ' ' || g2 || ' ' || g3 ELSE g3 END AS gallery FROM f",
)
def drop_cover_from_gallery(t: Tables):
    gallery = U.drop_cover_from_gallery(F.array("g1", "g2", "g3"), "cover", ("big.store.example", "/pics"), _FAMILY)
    return t.sql(_GALLERY).select("p_partkey", F.array_join(gallery, " ").alias("gallery"))
