"""Joins of inventory and item tables."""

from pyspark.sql import functions as F

from catalogfuse.functions import codes as C
from catalogfuse.functions import paths as P
from catalogfuse.operators import filters as L
from catalogfuse.operators import lookups as K
from catalogfuse.sources import ledger as LG
from catalogfuse.workload import fixtures as X
from catalogfuse.workload.registry import Tables, query

_CATALOG = "SELECT 'P' || cast(p_partkey AS string) AS item_code, p_name AS title, p_partkey % 3 = 0 AS has_download, p_partkey % 5 < 2 AS has_subtitle FROM {part}"
# Every fourth part's rows are held under another code, so that it is missing.
_LOCAL = "SELECT CASE WHEN l_partkey % 4 = 0 THEN 'Q' ELSE 'P' END || cast(l_partkey AS string) AS item_code, l_quantity > 48 AS has_subtitle FROM {lineitem}"


@query(
    "missing_items",
    X.cte(c=_CATALOG, l=_LOCAL)
    + """, h AS (SELECT item_code, bool_or(has_subtitle) AS s FROM l GROUP BY 1), j AS (SELECT c.*, h.s IS NULL AS absent, h.s IS NULL AND has_download AS absent_download, has_subtitle AND NOT coalesce(h.s, false) AS subtitle_wanted FROM c LEFT JOIN h USING (item_code))
      SELECT * FROM j WHERE absent OR subtitle_wanted""",
)
def missing_items(t: Tables):
    return K.missing_items(t.sql(_CATALOG), t.sql(_LOCAL))


# Subtitle store: several folders hold files of the same name.
_STORE = """
SELECT '/subs/' || cast(l_suppkey % 4 AS string) || CASE WHEN l_linenumber % 2 = 0 THEN '/a' ELSE '' END || '/' || CASE WHEN l_partkey % 3 = 0 AND l_quantity > 40 THEN 'Item-' ELSE 'Other-' END || cast(l_partkey AS string) || CASE l_suppkey % 3 WHEN 0 THEN '.srt' WHEN 1 THEN '.ASS' ELSE '.txt' END AS path
FROM {lineitem}
"""
_INV = "SELECT '/lib/' || p_brand || '/item-' || cast(p_partkey AS string) || '.mp4' AS path, p_partkey, p_name, p_partkey % 10 = 0 AS tagged FROM {part}"
_FIRST = "ix AS (SELECT lower(regexp_extract(path, '[^/]*$')) AS nm, arg_min(path, (string_split(regexp_extract(path, '^(.*)/', 1), '/'), path)) AS m FROM st GROUP BY 1)"
_FOUND = "coalesce((SELECT m FROM ix WHERE nm = 'item-' || p_partkey || '.srt'), (SELECT m FROM ix WHERE nm = 'item-' || p_partkey || '.ass'))"


def _names():
    stem = C.file_stem("path")
    return F.array(F.concat(stem, F.lit(".srt")), F.concat(stem, F.lit(".ass")))


@query("attach_sidecars", X.cte(st=_STORE, i=_INV) + f", {_FIRST} SELECT path, p_partkey, {_FOUND} AS sidecar FROM i")
def attach_sidecars(t: Tables):
    return K.attach_sidecars(t.sql(_INV), t.sql(_STORE), _names()).select("path", "p_partkey", "sidecar")


@query(
    "subtitle_flag",
    X.cte(st=_STORE, i=_INV)
    + f""", {_FIRST}, j AS (SELECT *, {_FOUND} AS m FROM i), k AS (SELECT path, CASE WHEN m IS NOT NULL THEN 'file' WHEN contains(upper(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '.')), '7.') AND NOT contains(path, '77') THEN 'name' WHEN tagged THEN 'record' END AS sub_from FROM j)
      SELECT path, sub_from, sub_from IS NOT NULL AS has_sub FROM k""",
)
def subtitle_flag(t: Tables):
    token = P.subtitle_token(C.file_stem("path"), ["7."], ["77"])
    return K.subtitle_flag(t.sql(_INV), t.sql(_STORE), _names(), token, F.col("tagged")).select("path", "sub_from", "has_sub")


@query(
    "subtitle_backfill",
    X.cte(st=_STORE, i=_INV)
    + f", {_FIRST}, j AS (SELECT *, {_FOUND} AS m FROM i WHERE NOT tagged) SELECT count(*) AS lacking, count(m) AS fillable, count(*) - count(m) AS still_lacking FROM j",
)
def subtitle_backfill(t: Tables):
    inv = t.sql(_INV).withColumnRenamed("tagged", "has_sub")
    return K.subtitle_backfill_report(K.subtitle_backfill(inv, t.sql(_STORE), _names()))


_LEDGER = """
SELECT 'o' || cast(o_custkey AS string) AS path, 'C' || cast(o_custkey AS string) AS item_code, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'failed' ELSE 'skipped' END AS status,
  o_orderpriority AS reason, o_totalprice / 1000 AS secs, o_orderdate AS ts, o_orderkey
FROM {orders}
"""
_TODO = "SELECT 'o' || cast(c_custkey AS string) AS path FROM {customer}"
_LATEST = "la AS (SELECT path, arg_max(status, (ts, item_code, status, reason, secs)) AS status, arg_max(reason, (ts, item_code, status, reason, secs)) AS reason FROM lg GROUP BY 1)"


def _ledger(t: Tables):
    return t.sql(_LEDGER).drop("o_orderkey")


@query("ledger_latest", X.cte(lg=_LEDGER) + f", {_LATEST} SELECT path, status, reason FROM la")
def ledger_latest(t: Tables):
    return LG.ledger_latest(_ledger(t)).select("path", "status", "reason")


@query("remaining_paths", X.cte(lg=_LEDGER, td=_TODO) + f", {_LATEST} SELECT path FROM td WHERE path NOT IN (SELECT path FROM la WHERE status = 'ok')")
def remaining_paths(t: Tables):
    return LG.remaining_paths(t.sql(_TODO), _ledger(t))


@query("skip_processed", X.cte(lg=_LEDGER, td=_TODO) + "SELECT path FROM td WHERE path NOT IN (SELECT path FROM lg WHERE status = 'ok')")
def skip_processed(t: Tables):
    return K.skip_processed(t.sql(_TODO), _ledger(t))


_OLD = "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'old' ELSE 'p' END || cast(p_partkey AS string) AS path, upper(p_name) AS item_code, p_size > 20 AS has_sub FROM {part}"
_NEW = "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'p' ELSE 'new' END || cast(p_partkey AS string) AS path, lower(p_brand) AS item_code, p_size > 40 AS has_sub FROM {part}"


@query("upsert_code_cache", X.cte(o=_OLD, n=_NEW) + "SELECT path, coalesce(o.item_code, n.item_code) AS item_code, coalesce(o.has_sub, n.has_sub) AS has_sub FROM o FULL JOIN n USING (path)")
def upsert_code_cache(t: Tables):
    return LG.upsert_code_cache(t.sql(_OLD), t.sql(_NEW))


_TERMS = "SELECT min(item_id) AS ord, term FROM (SELECT item_id, regexp_replace(split_part(text, '.', 1), '[^A-Za-z ]', '') AS t0, split_part(replace(text, '.', ' '), ' ', 3) AS term FROM {benchmark}) WHERE length(term) > 2 GROUP BY term"
_PHRASES = "SELECT item_id * 2 AS ord, lower(split_part(replace(replace(text, '.', ' '), ',', ' '), ' ', 2)) || ' ' || lower(split_part(replace(replace(text, '.', ' '), ',', ' '), ' ', 3)) AS term FROM {benchmark} UNION ALL SELECT item_id * 2 + 1, lower(split_part(text, ' ', 1)) FROM {benchmark} UNION ALL SELECT item_id * 2 + 1000, split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) || ' ' || split_part(text, ' ', 4) || ' ' || split_part(text, ' ', 5) || ' ' || split_part(text, ' ', 6) FROM {benchmark} UNION ALL SELECT item_id * 2 + 1001, split_part(text, ' ', 4) || '-' || split_part(text, ' ', 5) FROM {benchmark}"


@query(
    "dictionary_terms",
    X.cte(tm0=_PHRASES)
    + """, tm AS (SELECT array_to_string(list_filter(regexp_split_to_array(lower(term), '[^\\p{L}\\p{N}\\p{M}_]+'), lambda x: x <> ''), ' ') AS k, min((ord, term)) AS h FROM tm0 GROUP BY 1),
      w AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}\\p{M}_]+'), lambda x: x <> ''), ' ') || ' ' AS t FROM documents)
      SELECT doc_id, h[1] AS ord, h[2] AS term FROM w JOIN tm ON contains(w.t, ' ' || tm.k || ' ') AND tm.k <> ''""",
)
def dictionary_terms(t: Tables):
    return K.dictionary_terms(t("documents"), t.sql(_PHRASES), "text", "doc_id")


@query(
    "dictionary_substrings",
    X.cte(tm0=_TERMS)
    + ", tm AS (SELECT lower(term) AS k, min((ord, term)) AS h FROM tm0 GROUP BY 1) SELECT doc_id, h[1] AS ord, h[2] AS term FROM documents JOIN tm ON contains(lower(text), tm.k)",
)
def dictionary_substrings(t: Tables):
    return K.dictionary_terms(t("documents"), t.sql(_TERMS), "text", "doc_id", mode="substring")


_ROOTS = ("/lib/brand1", "/lib/brand12/", "/lib/brand2/old", "/lib/brand2")
_ROOT_CASE = "CASE WHEN path = '/lib/brand1' OR starts_with(path, '/lib/brand1/') THEN '/lib/brand1' WHEN starts_with(path, '/lib/brand12/') THEN '/lib/brand12' WHEN starts_with(path, '/lib/brand2/old/') THEN '/lib/brand2/old' WHEN starts_with(path, '/lib/brand2/') THEN '/lib/brand2' ELSE '/lib/brand1' END"


@query("assign_root", X.cte(f=X.PATHS) + f"SELECT p_partkey, {_ROOT_CASE} AS root FROM f")
def assign_root(t: Tables):
    return K.assign_root(t.sql(X.PATHS), _ROOTS).select("p_partkey", "root")


_ROOT_TABLE = "SELECT n_nationkey AS ord, '/lib/brand' || cast(n_nationkey AS string) || CASE WHEN n_nationkey % 3 = 0 THEN '/old' ELSE '' END AS root FROM {nation}"


@query(
    "assign_root_table",
    X.cte(f=X.PATHS, r=_ROOT_TABLE)
    + "SELECT p_partkey, coalesce((SELECT arg_min(root, ord) FROM r WHERE starts_with(f.path, root || '/')), (SELECT arg_min(root, ord) FROM r)) AS root FROM f",
)
def assign_root_table(t: Tables):
    return K.assign_root_table(t.sql(X.PATHS).select("p_partkey", "path"), t.sql(_ROOT_TABLE)).select("p_partkey", "root")


_SHARED = "SELECT o_orderkey, 'P' || cast(o_custkey % 700 AS string) AS item_code, o_orderstatus AS edition, o_orderkey % 2 = 0 AS has_sub, o_orderpriority <> '5-LOW' AS may FROM {orders}"


@query(
    "share_by_code",
    X.cte(f=_SHARED)
    + """, i AS (SELECT 'P' || p_partkey AS item_code, p_name AS title, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN [] ELSE [p_type] END AS tags, [p_type] AS own FROM part)
      SELECT o_orderkey, item_code, title, CASE WHEN title IS NOT NULL THEN array_to_string(CASE WHEN may THEN list_concat(tags, list_filter([edition, CASE WHEN has_sub THEN 'subtitled' END], lambda x: x IS NOT NULL)) ELSE own END, ',') END AS tags,
        may AS shared, title IS NOT NULL AS resolved FROM f LEFT JOIN i USING (item_code)""",
)
def share_by_code(t: Tables):
    items = t("part").select(F.concat(F.lit("P"), "p_partkey").alias("item_code"), F.col("p_name").alias("title"), F.array("p_type").alias("tags"))
    own = F.array("edition", F.when(F.col("has_sub"), F.lit("subtitled")))
    out = K.share_by_code(t.sql(_SHARED), lambda codes: codes.join(items, "item_code"), F.col("may"), own, ("SMALL", "LARGE"))
    return out.select("o_orderkey", "item_code", "title", F.array_join("tags", ",").alias("tags"), "shared", "resolved")


_CAST = "SELECT o_orderkey, 'P' || cast(o_custkey AS string) AS item_code, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Known' END AS people FROM {orders}"
_BY_CODE = "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'P' ELSE 'Q' END || cast(c_custkey AS string) AS item_code, c_name AS people FROM {customer}"


@query(
    "lookup_people_by_item",
    X.cte(f=_CAST, k=_BY_CODE) + "SELECT o_orderkey, item_code, CASE WHEN f.people = '' AND k.people IS NOT NULL THEN k.people ELSE f.people END AS people FROM f LEFT JOIN k USING (item_code)",
)
def lookup_people(t: Tables):
    return K.lookup_people(t.sql(_CAST), t.sql(_BY_CODE), F.col("people") == "")


_CLEAN = P.CleanupRules(ignore_ext=(".MKV",), ignore_contains=("RED",), ext=(".txt",), names=("HOT-00011.mp4",), contains=("leaked",), max_kb=2048)


@query(
    "cleanup_candidates",
    X.cte(f=X.PATHS)
    + """, g AS (SELECT *, regexp_extract(path, '[^/]*$') AS nm, regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]*)$', 1) AS ext FROM f)
      SELECT p_partkey, path FROM g WHERE NOT (ext = '.MKV' OR contains(nm, 'RED')) AND (ext = '.txt' OR nm = 'HOT-00011.mp4' OR contains(nm, 'leaked') OR size <= 2048 * 1024)""",
)
def cleanup_candidates(t: Tables):
    return L.cleanup_candidates(t.sql(X.PATHS), _CLEAN).select("p_partkey", "path")


@query("min_size", X.cte(f=X.PATHS) + "SELECT p_partkey FROM f WHERE size >= 52428800 OR p_size = 7")
def min_size(t: Tables):
    return L.min_size(t.sql(X.PATHS), 50, F.col("p_size") == 7).select("p_partkey")


_SCAN = X.PATHS.replace("FROM {part}", "FROM {part} WHERE true") + " UNION ALL SELECT s_suppkey, '', '', 0, '/lib/brand' || cast(s_suppkey % 9 + 3 AS string) || '/old/.skip', 0 FROM {supplier}"


@query(
    "filter_inventory",
    X.cte(f=_SCAN)
    + f""", g AS (SELECT path, regexp_extract(path, '^(.*)/', 1) AS dir, regexp_extract(path, '[^/]*$') AS nm, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]*)$', 1)) AS ext FROM f),
      b AS (SELECT DISTINCT dir FROM g WHERE nm IN ('skip', '.skip', '.ignore'))
      SELECT path, ext FROM g WHERE ext IN ('.mp4', '.mkv') AND NOT starts_with(nm, '.') AND NOT contains(path, 'trailer.') AND NOT starts_with(path, '/lib/brand1/')
        AND NOT EXISTS (SELECT 1 FROM b WHERE starts_with(g.path, b.dir || '/'))""",
)
def filter_inventory(t: Tables):
    from catalogfuse.sources.inventory import filter_inventory as keep

    return keep(t.sql(_SCAN), (".mp4", ".MKV"), ignore_dirs=("/lib/brand1/",)).select("path", "ext")


