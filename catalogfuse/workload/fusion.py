"""Fusion queries."""

from pyspark.sql import functions as F

from catalogfuse.operators import fusion as U
from catalogfuse.schemas import FUSED_FIELDS, Field
from catalogfuse.workload import fixtures as X
from catalogfuse.workload.registry import Tables, query

FIELDS = [f for f in FUSED_FIELDS if f.name in X.FIELD_ORDER]
NAMES = [f.name for f in FIELDS]

_REL = (
    "CAST(CAST(try_strptime(regexp_extract(replace(replace({c}, '/', '-'), '.', '-'), '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}'),"
    " '%Y-%m-%d') AS DATE) AS VARCHAR)"
)
RELEASE_SQL = _REL.format(c="release")
VALID_SQL = {
    "title": "nullif(title, '')",
    "thumb": "nullif(thumb, '')",
    "poster": "nullif(poster, '')",
    "release": RELEASE_SQL,
    "runtime": "CASE WHEN regexp_full_match(runtime, '0+(\\.0+)?') THEN NULL ELSE nullif(runtime, '') END",
    "score": "CASE WHEN TRY_CAST(score AS DOUBLE) = 0 THEN NULL ELSE nullif(score, '') END",
    "maker": "nullif(maker, '')",
}
_LONG = "SELECT item_code, item_type, source, external_id, field, val FROM obs, LATERAL (VALUES " + ", ".join(
    f"('{n}', {VALID_SQL[n]})" for n in NAMES
) + ") u(field, val)"
_WIN = (
    "SELECT item_code, field, min(rank) AS win, arg_min(val, rank) AS val, arg_min(source, rank) AS src,"
    " arg_min(external_id, rank) AS ext FROM long JOIN pri USING (item_type, field, source) WHERE val IS NOT NULL GROUP BY 1, 2"
)
_BASE = X.cte(obs=X.OBSERVATIONS, pri=X.PRIORITY) + f", long AS ({_LONG}), win AS ({_WIN})"
_SEEN = "(SELECT DISTINCT item_code, item_type FROM obs JOIN (SELECT DISTINCT item_type, source FROM pri) USING (item_type, source))"


def observations(t: Tables):
    return t.sql(X.OBSERVATIONS)


def observed(t: Tables):
    """All records, several of a source among them: the operators pick by ``OBSERVED_ORDER``."""
    return t.sql(X.OBSERVED)


def priorities(t: Tables):
    return U.priority_frame(t.spark, X.PRIORITY_ROWS)


def _fused_sql(where: str = "") -> str:
    cols = ", ".join(f"max(CASE WHEN field = '{n}' THEN val END) AS {n}" for n in NAMES)
    srcs = ", ".join(f"max(CASE WHEN field = '{n}' THEN src END) AS {n}_source" for n in NAMES)
    ids = "string_agg(DISTINCT src || '=' || ext, ';' ORDER BY src || '=' || ext) AS ids"
    year = "max(CASE WHEN field = 'release' THEN left(val, 4) END) AS year"
    return f"{_BASE} SELECT item_code, any_value(s.item_type) AS item_type, {cols}, {year}, {srcs}, {ids} FROM {_SEEN} s LEFT JOIN win USING (item_code) {where} GROUP BY item_code"


@query("fuse_fields", _fused_sql())
def fuse_fields(t: Tables):
    fused = U.fuse_fields(observed(t), priorities(t), FIELDS, X.OBSERVED_ORDER)
    ids = F.transform(F.map_entries("external_ids"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return fused.select(
        "item_code", "item_type", *NAMES, "year",
        *[F.col("field_sources")[n].alias(f"{n}_source") for n in NAMES],
        F.nullif(F.array_join(F.array_sort(ids), ";"), F.lit("")).alias("ids"),
    )


_RAW_FIELDS = [Field("title"), Field("maker"), Field("release", "release")]
_RAW_PRI = "SELECT * FROM (VALUES " + ", ".join(
    f"('{f}', 's{s}', {i})" for f, o in (("title", "01234"), ("maker", "4321"), ("release", "20"))
    for i, s in enumerate(o, 1)
) + ") AS p(field, source, rank)"


@query(
    "fuse_repeated_observations",
    X.cte(raw=X.RAW_OBSERVATIONS, pri=_RAW_PRI)
    + f""", obs AS (SELECT item_code, source, arg_min(title, (seq, title)) AS title, arg_min(maker, (seq, title)) AS maker,
        arg_min(release, (seq, title)) AS release FROM raw GROUP BY 1, 2),
      long AS (SELECT item_code, source, field, val FROM obs, LATERAL (VALUES ('title', nullif(title, '')), ('maker', nullif(maker, '')), ('release', {RELEASE_SQL})) u(field, val)),
      win AS (SELECT item_code, field, arg_min(val, rank) AS val FROM long JOIN pri USING (field, source) WHERE val IS NOT NULL GROUP BY 1, 2)
      SELECT item_code, max(CASE WHEN field = 'title' THEN val END) AS title, max(CASE WHEN field = 'maker' THEN val END) AS maker,
        max(CASE WHEN field = 'release' THEN val END) AS release
      FROM (SELECT DISTINCT item_code FROM obs) LEFT JOIN win USING (item_code) GROUP BY item_code""",
)
def fuse_repeated_observations(t: Tables):
    """Sources that report an item several times: the first record of each counts."""
    pri = t.sql(_RAW_PRI)
    fused = U.fuse_fields(t.sql(X.RAW_OBSERVATIONS), pri, _RAW_FIELDS, order=["seq", "title"])
    return fused.select("item_code", "title", "maker", "release")


_TYPE_SOURCES = "SELECT n_regionkey AS type_no, 'type' || cast(n_regionkey AS string) AS item_type, 's' || cast(n_nationkey % 9 AS string) AS source, n_nationkey + 1 AS rank FROM {nation}"
_FIELD_SOURCES = "SELECT 'f' || cast(s_nationkey % 4 AS string) AS field, 's' || cast(s_nationkey % 12 AS string) AS source, min(s_suppkey) + 1 AS rank FROM {supplier} GROUP BY 1, 2"
_OVERRIDES = "SELECT 'type' || cast(n_regionkey AS string) AS item_type, 'f' || cast(n_nationkey % 2 AS string) AS field, 's' || cast(n_nationkey % 5 AS string) AS source, n_nationkey AS rank FROM {nation} WHERE n_regionkey = 1"


@query(
    "resolve_priorities",
    X.cte(ty0=_TYPE_SOURCES, fs=_FIELD_SOURCES, ov=_OVERRIDES)
    + """, ty AS (SELECT item_type, source, min(rank) AS rank FROM ty0 GROUP BY 1, 2),
      fields AS (SELECT unnest(['f0', 'f1', 'f2', 'f3', 'f9']) AS field),
      hits AS (SELECT item_type, field, source, fs.rank AS o FROM ty JOIN fs USING (source)),
      slots AS (SELECT DISTINCT item_type, field FROM ty, fields),
      spare AS (SELECT s.item_type, s.field, ty.source, ty.rank AS o FROM slots s JOIN ty USING (item_type)
        WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.item_type = s.item_type AND h.field = s.field)),
      own AS (SELECT ov.item_type, ov.field, ov.source, ov.rank AS o FROM ov JOIN ty USING (item_type, source)),
      merged AS (SELECT * FROM (SELECT * FROM hits UNION ALL SELECT * FROM spare) m
        WHERE NOT EXISTS (SELECT 1 FROM ov WHERE ov.item_type = m.item_type AND ov.field = m.field) UNION ALL SELECT * FROM own)
      SELECT item_type, field, source, row_number() OVER (PARTITION BY item_type, field ORDER BY o, source) AS rank FROM merged""",
)
def resolve_priorities(t: Tables):
    types = t.sql(_TYPE_SOURCES).groupBy("item_type", "source").agg(F.min("rank").alias("rank"))
    return U.resolve_priorities(types, t.sql(_FIELD_SOURCES), ["f0", "f1", "f2", "f3", "f9"], t.sql(_OVERRIDES))


_SOURCE_ORDER = "SELECT * FROM (VALUES ('s3', 1), ('s0', 2), ('s4', 3), ('s1', 4)) AS o(source, rank)"


@query(
    "fuse_first_source",
    X.cte(obs=X.OBSERVATIONS, ord=_SOURCE_ORDER)
    + """, r AS (SELECT obs.*, rank FROM obs JOIN ord USING (source)),
      w AS (SELECT item_code, min(rank) AS win FROM r WHERE title <> '' GROUP BY 1)
      SELECT r.item_code, r.source, r.title, r.maker, r.release,
        (SELECT coalesce(string_agg(q.source, '>' ORDER BY q.rank), '') FROM r q WHERE q.item_code = r.item_code AND q.rank < w.win) AS skipped
      FROM r JOIN w ON r.item_code = w.item_code AND r.rank = w.win""",
)
def fuse_first_source(t: Tables):
    obs = observations(t).select("item_code", "source", "title", "maker", "release")
    out = U.fuse_first_source(obs, t.sql(_SOURCE_ORDER), log_skipped=True)
    return out.select("item_code", "source", "title", "maker", "release", F.array_join("skipped", ">").alias("skipped"))


@query(
    "fuse_single_source",
    X.cte(obs=X.OBSERVATIONS)
    + f"SELECT item_code, {', '.join(f'{VALID_SQL[n]} AS {n}' for n in NAMES)} FROM obs WHERE source = 's2'",
)
def fuse_single_source(t: Tables):
    return U.fuse_single_source(observations(t), "s2", FIELDS).select("item_code", *NAMES)


_ASKED = (
    _BASE
    + f""", fo AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {i})" for i, n in enumerate(NAMES))}) AS f(field, fidx)),
      ranked AS (SELECT o.item_code, o.source, p.field, p.rank, fo.fidx FROM obs o JOIN pri p USING (item_type, source) JOIN fo ON fo.field = p.field),
      touch AS (SELECT r.item_code, r.source, min(r.fidx * 1000 + r.rank) AS spot
        FROM ranked r LEFT JOIN win w ON w.item_code = r.item_code AND w.field = r.field
        WHERE r.rank <= coalesce(w.win, 999999) GROUP BY 1, 2),
      asked AS (SELECT touch.spot, o.*, pp.rank AS prank FROM touch JOIN obs o USING (item_code, source)
        LEFT JOIN pri pp ON pp.item_type = o.item_type AND pp.source = o.source AND pp.field = 'poster') """
)


@query(
    "collect_candidates",
    _ASKED
    + """, ppl AS (SELECT item_code, person, min(spot) AS spot FROM asked GROUP BY 1, 2)
      SELECT a.item_code, string_agg(source, '>' ORDER BY spot) AS consulted,
        coalesce(string_agg(source || '=' || thumb, ' ' ORDER BY spot) FILTER (thumb <> ''), '') AS thumbs,
        coalesce(string_agg(source || '=' || poster, ' ' ORDER BY prank) FILTER (poster <> '' AND prank IS NOT NULL), '') AS posters,
        (SELECT string_agg(person, ',' ORDER BY spot) FROM ppl WHERE ppl.item_code = a.item_code) AS people,
        arg_min(edition, spot) FILTER (edition <> '') AS edition
      FROM asked a GROUP BY a.item_code""",
)
def collect_candidates(t: Tables):
    obs = observed(t).withColumn("people", F.array("person"))
    out = U.collect_candidates(obs, priorities(t), FIELDS, X.OBSERVED_ORDER)
    pairs = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["source"], F.lit("="), s["url"])), " ")
    return out.select(
        "item_code", F.array_join("consulted", ">").alias("consulted"), pairs("thumbs").alias("thumbs"),
        pairs("posters").alias("posters"), F.array_join("people_union", ",").alias("people"), "edition",
    )


_PRESENT_SQL = ", ".join(f"('{n}', {n} <> '', {VALID_SQL[n]} IS NOT NULL)" for n in NAMES)


@query(
    "field_coverage",
    _BASE
    + f""", st AS (SELECT item_code, item_type, source, field, has, good FROM obs, LATERAL (VALUES {_PRESENT_SQL}) u(field, has, good))
      SELECT st.field, st.source,
        CASE WHEN p.rank > w.win THEN 'not_asked' WHEN p.rank = w.win THEN 'chosen' WHEN good THEN 'valid' WHEN has THEN 'invalid' ELSE 'missing' END AS status,
        count(*) AS n
      FROM st JOIN pri p ON p.item_type = st.item_type AND p.source = st.source AND p.field = st.field
      LEFT JOIN win w ON w.item_code = st.item_code AND w.field = st.field GROUP BY 1, 2, 3""",
)
def field_coverage(t: Tables):
    return U.field_coverage(observed(t), priorities(t), FIELDS, X.OBSERVED_ORDER)


_CATEGORIES = ("monthly", "prime", "rental", "mono", "stream_a", "stream_b", "digital")
_CATEGORY_OBS = """
SELECT 'P' || cast(l_partkey AS string) AS item_code, (l_orderkey * 10 + l_linenumber) * 100000000 + cast(floor(l_extendedprice * 100) AS bigint) AS seq,
  CASE l_suppkey % 7 WHEN 0 THEN 'monthly' WHEN 1 THEN 'prime' WHEN 2 THEN 'rental' WHEN 3 THEN 'mono' WHEN 4 THEN 'stream_a' WHEN 5 THEN 'stream_b' ELSE 'digital' END AS category,
  CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE 'title ' || cast(l_orderkey AS string) END AS title,
  CASE WHEN l_orderkey % 5 < 4 THEN '' ELSE cast(cast(l_shipdate AS date) AS string) END AS release
FROM {lineitem}
"""


@query(
    "merge_by_category",
    X.cte(obs=_CATEGORY_OBS)
    + f""", r AS (SELECT *, list_position({list(_CATEGORIES)!r}, category) AS c, category IN ('stream_a', 'stream_b') AS streaming FROM obs)
      SELECT item_code, arg_max(title, (c, seq)) FILTER (title <> '') AS title,
        coalesce(arg_max(release, (c, seq)) FILTER (release <> '' AND NOT streaming), arg_min(release, (-c, seq)) FILTER (release <> '' AND streaming)) AS release
      FROM r GROUP BY 1""",
)
def merge_by_category(t: Tables):
    fields = [Field("title"), Field("release", "release")]
    return U.merge_by_category(t.sql(_CATEGORY_OBS), _CATEGORIES, fields, stream_only=("stream_a", "stream_b"))


_BASE_ROWS = "SELECT 'P' || cast(p_partkey AS string) AS item_code, p_name AS title, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END AS maker, cast(p_size AS string) AS runtime FROM {part}"
_PATCH_ROWS = "SELECT 'P' || cast(l_partkey AS string) AS item_code, CASE WHEN min(l_orderkey) % 2 = 0 THEN '' ELSE 'order ' || cast(min(l_orderkey) AS string) END AS title, max(l_returnflag) AS maker, 'x' AS unknown_field FROM {lineitem} GROUP BY l_partkey"


@query(
    "overlay_valid",
    X.cte(b=_BASE_ROWS, p=_PATCH_ROWS)
    + "SELECT b.item_code, coalesce(nullif(p.title, ''), b.title) AS title, coalesce(nullif(p.maker, ''), b.maker) AS maker, b.runtime FROM b LEFT JOIN p USING (item_code)",
)
def overlay_valid(t: Tables):
    return U.overlay_valid(t.sql(_BASE_ROWS), t.sql(_PATCH_ROWS))
