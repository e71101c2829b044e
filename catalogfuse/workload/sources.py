"""Sources, sinks, user functions and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogfuse.functions import codes as C
from catalogfuse.operators.fusion import priority_frame
from catalogfuse.operators.tags import TagOptions
from catalogfuse.operators.translate import translate as translate_texts
from catalogfuse.plans import resolve as R
from catalogfuse.schemas import Field
from catalogfuse.sources import alias_xml, html, json_records, sidecars
from catalogfuse.sources.ledger import load_people_db
from catalogfuse.workload import fixtures as X
from catalogfuse.workload.identifiers import TOKENS, code_ctes
from catalogfuse.workload.registry import ORACLE, Tables, in_sql, query

# Sidecars --------------------------------------------------------------------------------------
_ITEMS = """
SELECT 'P-' || cast(p_partkey AS string) AS item_code, CASE WHEN p_partkey % 20 = 0 THEN NULL ELSE p_name || ' & <' || p_type || '>' END AS title, 'orig ' || p_name AS originaltitle, p_brand AS maker,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'Label ' || cast(p_size AS string) END AS label, '2021-03-0' || cast(p_partkey % 9 + 1 AS string) AS release, 'plot of' || chr(10) || p_name AS outline, p_type AS series, cast(p_size AS string) || '.5' AS score, p_name, p_partkey
FROM {part}
"""


@query(
    "sidecar_round_trip",
    X.cte(f=_ITEMS)
    + """SELECT item_code, title, originaltitle, item_code || ' ' || originaltitle AS sort_as, maker, label, release, outline, series, score, 'Ann,' || p_name AS people, 'red,' || p_name AS tags, 'red' AS own_tags FROM f WHERE title IS NOT NULL""",
)
def sidecar_round_trip(t: Tables):
    """Item rows to XML documents and back; rows without a title come out as damaged."""
    rows = t.sql(_ITEMS).withColumns({"people": F.array(F.lit("Ann"), "p_name"), "tags": F.array(F.lit("red"), "p_name")})
    docs = rows.select(sidecars.sidecar_xml(rows).alias("xml")).withColumn("sort_as", F.regexp_extract("xml", "<sorttitle>(.*)</sorttitle>", 1))
    items, _ = sidecars.sidecar_items(sidecars.parse_sidecars(docs))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return items.select(
        "item_code", "title", "originaltitle", "sort_as", "maker", "label", "release", "outline", "series", "score",
        joined("people"), joined("tags"), joined("own_tags"),
    )


@query("sidecar_quarantine", X.cte(f=_ITEMS) + "SELECT item_code FROM f WHERE title IS NULL")
def sidecar_quarantine(t: Tables):
    rows = t.sql(_ITEMS)
    docs = rows.select(sidecars.sidecar_xml(rows, ["plot"]).alias("xml"))
    _, bad = sidecars.sidecar_items(sidecars.parse_sidecars(docs))
    return bad.select("item_code")


_ATTRS = "SELECT s_suppkey AS ord, s_name AS zh_cn, lower(s_name) || ' ' AS zh_tw, upper(s_name) AS jp, ',' || s_name || ',,x' || cast(s_suppkey AS string) || ',' AS keyword, '/p/' || cast(s_suppkey AS string) AS href FROM {supplier}"


@query("alias_rows", X.cte(f=_ATTRS) + "SELECT ord, zh_cn AS a, trim(zh_tw) AS b, jp AS c, zh_cn || '|x' || ord AS keywords, href FROM f")
def alias_rows(t: Tables):
    out = alias_xml.alias_rows(t.sql(_ATTRS), ("zh_cn", "zh_tw", "jp"))
    names = [F.col("canonical")[k].alias(a) for k, a in (("zh_cn", "a"), ("zh_tw", "b"), ("jp", "c"))]
    return out.select("ord", *names, F.array_join("keywords", "|").alias("keywords"), "href")


def _documents(t: Tables):
    """JSON records of parts; some lack whole branches."""
    c = F.col
    site = F.struct(c("p_brand").alias("name"), F.struct(c("p_type").alias("name")).alias("network"))
    people = F.array(
        F.struct(F.lit("Ann").alias("name"), F.lit("F").alias("kind")), F.struct(F.lit("Bob").alias("name"), F.lit("M").alias("kind"))
    )
    body = F.struct(
        c("p_name").alias("title"), F.when(c("p_partkey") % 2 == 0, site).alias("site"), (c("p_size") * 60).alias("duration"),
        F.when(c("p_partkey") % 3 == 0, people).alias("performers"), F.lit("").alias("description"),
    )
    return t("part").select("p_partkey", F.to_json(F.struct(body.alias("data"))).alias("json"))


_SCHEMA = "data struct<title:string, description:string, duration:bigint, site:struct<name:string, network:struct<name:string>>, performers:array<struct<name:string, kind:string>>, missing:string>"
_FIELDS = {
    "title": "d.data.title",
    "outline": "d.data.description",
    "runtime": "cast(d.data.duration div 60 as string)",
    "series": "d.data.site.name",
    "maker": "d.data.site.network.name",
    "all_people": "transform(d.data.performers, p -> p.name)",
    "people": "transform(filter(d.data.performers, p -> p.kind <> 'M'), p -> p.name)",
    "score": "d.data.missing",
}


@query(
    "read_json_observations",
    """SELECT p_partkey, 'api' AS source, p_name AS title, CAST(NULL AS VARCHAR) AS outline, CAST(p_size AS VARCHAR) AS runtime, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS series, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS maker,
      CASE WHEN p_partkey % 3 = 0 THEN 'Ann,Bob' END AS all_people, CASE WHEN p_partkey % 3 = 0 THEN 'Ann' END AS people, CAST(NULL AS VARCHAR) AS score FROM part""",
)
def read_json_observations(t: Tables):
    out = json_records.read_json_observations(_documents(t), "api", _SCHEMA, _FIELDS, keep=("p_partkey",))
    for c in ("people", "all_people"):
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.array_join(c, ",")))
    return out


_VARIANT_FIELDS = {
    "title": ("$.data.title", "string"), "outline": ("$.data.description", "string"),
    "runtime": ("$.data.duration", "bigint", "cast({v} div 60 as string)"), "series": ("$.data.site.name", "string"),
    "maker": ("$.data.site.network.name", "string"),
    "all_people": ("$.data.performers", "array<struct<name: string, kind: string>>", "array_join(transform({v}, p -> p.name), ',')"),
    "people": ("$.data.performers", "array<struct<name: string, kind: string>>", "array_join(transform(filter({v}, p -> p.kind <> 'M'), p -> p.name), ',')"),
    "score": ("$.data.missing", "string"),
}


@query("read_variant_observations", ORACLE["read_json_observations"])
def read_variant_observations(t: Tables):
    """The same records read without a schema."""
    return json_records.read_variant_observations(_documents(t), "api", _VARIANT_FIELDS, keep=("p_partkey",))


@query(
    "json_shape",
    """SELECT p_partkey % 2 = 0 AS sited, p_partkey % 3 = 0 AS cast_known, count(*) AS documents, p_partkey % 2 = 0 AS has_site, p_partkey % 3 = 0 AS has_performers FROM part GROUP BY ALL""",
)
def json_shape(t: Tables):
    """Which branches the documents of each kind have."""
    rows = _documents(t).withColumns({"sited": F.col("p_partkey") % 2 == 0, "cast_known": F.col("p_partkey") % 3 == 0})
    out = json_records.json_shape(rows, by=("sited", "cast_known"))
    has = lambda name: F.col("shape").contains(f"{name}: ")
    return out.select("sited", "cast_known", "documents", has("site").alias("has_site"), has("performers").alias("has_performers"))


@query(
    "read_embedded_json",
    "SELECT page_id, url AS name, page_id * 2 AS n FROM pages",
)
def read_embedded_json(t: Tables):
    """A JSON island put into every page, plain or escaped, and read back."""
    island = F.to_json(F.struct(F.col("url").alias("name"), (F.col("page_id") * 2).alias("n")))
    escaped = F.replace(F.replace(island, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    body = F.when(F.col("page_id") % 2 == 0, island).otherwise(escaped)
    tag = F.concat(F.lit('<script data-x="1" type="application/ld+json">'), body, F.lit("</script></body>"))
    pages = t("pages").withColumn("html", F.replace("html", F.lit("</body>"), tag))
    pages = pages.withColumn("html", F.when(F.col("html").contains("ld+json"), F.col("html")).otherwise(F.concat("html", tag)))
    out = json_records.read_embedded_json(pages, "name string, n bigint")
    return out.select("page_id", "data.name", "data.n")


_RULES = (
    html.Rule("title", "<h9>([^<]*)</h9>", attempt=0),
    html.Rule("title", "(?s)<title>(.*?)</title>", attempt=1),
    html.Rule("lang", '<html lang="([a-z]+)"'),
    html.Rule("links", '<a href="(/[^"]*)"', many=True),
)
_NODE = "replace(replace(replace(trim({x}), chr(10), ''), chr(13), ''), '&nbsp;', ' ')"


@query(
    "extract_fields",
    f"""SELECT page_id, nullif({_NODE.format(x="regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, '') AS title, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang,
      nullif(array_to_string(list_filter(list_transform(regexp_extract_all(html, '<a href="(/[^"]*)"', 1), lambda x: {_NODE.format(x='x')}), lambda x: x <> ''), ' '), '') AS links, 'score' AS unsupported FROM pages""",
)
def extract_fields(t: Tables):
    out = html.extract_fields(t("pages"), _RULES, all_fields=("title", "lang", "links", "score"))
    return out.select(
        "page_id", "title", "lang", F.nullif(F.array_join("links", " "), F.lit("")).alias("links"),
        F.array_join("unsupported", ",").alias("unsupported"),
    )


_H1 = "nullif(" + _NODE.format(x="replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&amp;', '&')") + ", '')"


@query(
    "extract_tag_fields",
    f"""SELECT page_id, {_H1} AS heading, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang,
      nullif(array_to_string(list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda x: x <> ''), ' '), '') AS links FROM pages""",
)
def extract_tag_fields(t: Tables):
    """Tag-path rules: a parser walks each page in a Python worker."""
    rules = (html.Rule("heading", "h1", "tag"), html.Rule("links", "a@href", "tag", many=True), html.Rule("lang", '<html lang="([a-z]+)"'))
    out = html.extract_fields(t("pages"), rules)
    return out.select("page_id", "heading", "lang", F.array_join("links", " ").alias("links"))


@query(
    "user_rule_values",
    """SELECT page_id, 'heading' AS field, len(regexp_extract_all(html, '<h1>')) AS n FROM pages WHERE contains(html, '<h1>')
      UNION ALL SELECT page_id, 'link', len(regexp_extract_all(html, '<a href="[^"]')) FROM pages WHERE contains(html, '<a href="')""",
)
def user_rule_values(t: Tables):
    """User rules as a table function: one (field, value) row per hit."""
    values = html.page_values()
    rules = F.lit("heading\ttag\th1\nlink\ttag\ta@href")
    return t("pages").select("page_id", "html").lateralJoin(values(F.col("html").outer(), rules)).groupBy("page_id", "field").agg(
        F.count("value").alias("n")
    )


@query(
    "load_people_db",
    "SELECT c.c_name AS name, s.s_name AS alias, c.c_acctbal AS info FROM customer c JOIN supplier s ON s.s_suppkey = c.c_custkey",
)
def people_db(t: Tables):
    names, info = load_people_db(t.spark, f"{t.folder}/supplier.parquet", f"{t.folder}/customer.parquet")
    return info.join(names, info.c_custkey == names.s_suppkey).select(
        F.col("c_name").alias("name"), F.col("s_name").alias("alias"), F.col("c_acctbal").alias("info")
    )


def _shout(texts):
    return [x.upper() if "LOW" not in x else x for x in texts]


def _fails(texts):
    raise RuntimeError("engine is down")


def _mark(texts):
    return [f"<{x}>" for x in texts]


@query(
    "translate",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE CASE WHEN contains(lower(o_orderpriority), 'low') THEN '<' || lower(o_orderpriority) || '>' ELSE upper(o_orderpriority) END END AS shown,
      CASE WHEN o_orderkey % 2 = 0 THEN NULL WHEN contains(lower(o_orderpriority), 'low') THEN 'mark' ELSE 'shout' END AS shown_by FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN lower(o_orderpriority) ELSE o_orderpriority END AS o_orderpriority FROM orders)""",
)
def translate(t: Tables):
    """Engines in order: one is down, one leaves some texts as they are, one takes the rest."""
    text = F.when(F.col("o_orderkey") % 2 == 1, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority"))
    rows = t("orders").select("o_orderkey", text.alias("text"))

    def shout(texts):
        return [x if "low" in x.lower() else x.upper() for x in texts]

    engines = [("down", _fails), ("shout", shout), ("mark", _mark)]
    out = translate_texts(rows, "text", engines, where=F.col("o_orderkey") % 2 == 1, out="shown")
    return out.select("o_orderkey", "shown", "shown_by")


# Whole jobs --------------------------------------------------------------------------------------
_LIBRARY_OBS = """
SELECT upper(replace(p_name, ' ', '')) || '-' || lpad(cast(p_partkey AS string), 5, '0') AS item_code, 's' || cast(l_suppkey % 3 AS string) AS source, (l_orderkey * 10 + l_linenumber) * 100000000 + cast(floor(l_extendedprice * 100) AS bigint) AS seq,
  CASE WHEN l_orderkey % 4 = 0 THEN '' ELSE 'Title ' || cast(l_suppkey AS string) END AS title, CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE p_brand END AS maker
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""
_LIBRARY_PRI = [("general", "title", "s1", 1), ("general", "title", "s2", 2), ("general", "maker", "s0", 1), ("general", "maker", "s2", 2)]


def library(t: Tables):
    fields = (Field("title"), Field("maker"))
    options = R.LibraryOptions(noise=TOKENS, fields=fields, tags=TagOptions(include=("maker", "edition")))
    obs = t.sql(_LIBRARY_OBS)
    first = obs.groupBy("item_code", "source").agg(F.min_by(F.struct("title", "maker"), "seq").alias("r"))
    first = first.select("item_code", "source", "r.title", "r.maker")
    inventory = t.sql(X.PATHS).withColumn("ext", F.regexp_extract("path", "(\\.[^.]*)$", 1))
    return R.resolve_library(inventory, first, priority_frame(t.spark, _LIBRARY_PRI), options)


_LIB_SQL = (
    X.cte(f=X.PATHS, ob=_LIBRARY_OBS)
    + f""", {code_ctes('f')}, fo AS (SELECT item_code, source, arg_min(title, seq) AS title, arg_min(maker, seq) AS maker FROM ob GROUP BY 1, 2),
      it AS (SELECT item_code, arg_min(nullif(title, ''), CASE source WHEN 's1' THEN 1 WHEN 's2' THEN 2 END) FILTER (title <> '' AND source IN ('s1', 's2')) AS title,
        arg_min(nullif(maker, ''), CASE source WHEN 's0' THEN 1 WHEN 's2' THEN 2 END) FILTER (maker <> '' AND source IN ('s0', 's2')) AS maker FROM fo GROUP BY 1)"""
)


@query(
    "resolve_library",
    _LIB_SQL + " SELECT p_partkey, path, item_code, title, maker, CASE WHEN it.item_code IS NULL THEN 'failed' ELSE 'ok' END AS status FROM coded LEFT JOIN it USING (item_code)",
)
def resolve_library(t: Tables):
    return library(t).select("p_partkey", "path", "item_code", "title", "maker", "status")


_FOLDER = "'/out/' || CASE WHEN maker IS NULL THEN '' ELSE maker || '/' END || item_code"


@query(
    "resolve_library_targets",
    _LIB_SQL + f" SELECT CASE WHEN it.item_code IS NOT NULL THEN {_FOLDER} END AS folder, path, it.item_code IS NOT NULL AS placed, CASE WHEN it.item_code IS NOT NULL THEN item_code || CASE WHEN title IS NULL THEN '' ELSE ' ' || title END END AS stem FROM coded LEFT JOIN it USING (item_code)",
)
def resolve_library_targets(t: Tables):
    """The folder of every file of the library, and its name without part and extension; none for files without a record."""
    target = F.col("target")
    name = F.regexp_extract(target["file"], "([^/]*)[.][^.]*$", 1)
    stem = F.when(F.col("part") != "0", F.regexp_replace(name, "-cd[0-9]+$", "")).otherwise(name)
    return library(t).select(target["dir"].alias("folder"), "path", target.isNotNull().alias("placed"), F.when(target.isNotNull(), stem).alias("stem"))


# A second copy of every file, brand names of the makers, and records that some codes have already.
_TWICE = f"SELECT p_partkey, path, size FROM ({X.PATHS}) UNION ALL SELECT p_partkey, replace(path, '/lib/', '/lib2/') AS path, size FROM ({X.PATHS})"
_HOUSES = "SELECT row_number() OVER (ORDER BY p_brand) AS ord, p_brand FROM (SELECT DISTINCT p_brand FROM {part})"
_RECORDS = "SELECT upper(replace(p_name, ' ', '')) || '-' || lpad(cast(p_partkey AS string), 5, '0') AS item_code, 'Kept ' || p_name AS title, p_type AS maker FROM {part} WHERE p_partkey % 5 = 0"


@query(
    "resolve_run",
    _LIB_SQL.replace(in_sql(X.PATHS), in_sql(_TWICE), 1)
    + f""", rec AS ({in_sql(_RECORDS)}),
      al AS (SELECT item_code, CASE WHEN r.item_code IS NOT NULL THEN r.title ELSE replace(i.title, 'Title', 'Opus') END AS title, CASE WHEN r.item_code IS NOT NULL THEN r.maker WHEN i.maker IS NOT NULL THEN 'House ' || i.maker END AS maker, r.item_code IS NOT NULL AS kept
        FROM it i FULL JOIN rec r USING (item_code))
      SELECT path, item_code, al.title, al.maker, al.kept AS from_record, coalesce(NOT contains(item_code, '.'), false) AS shared,
        CASE WHEN coalesce(item_code, '') = '' THEN 'no code in the path' WHEN al.kept IS NULL THEN 'no source has the code' WHEN starts_with(path, '/lib2/') THEN 'another file has the target' END AS reason,
        CASE WHEN al.kept IS NULL THEN NULL ELSE {_FOLDER.replace('maker', 'al.maker')} END AS folder
      FROM coded LEFT JOIN al USING (item_code)""",
)
def resolve_run(t: Tables):
    """Everything a run does, over two copies of each file: records first, fusion, translation, names, duplicate targets."""
    options = R.RunOptions(
        library=R.LibraryOptions(noise=TOKENS, fields=(Field("title"), Field("maker")), tags=TagOptions(include=("maker", "edition")), language="en"),
        replacements=(("Titolo", "Opus"),), engines=(("down", _fails), ("words", lambda texts: [x.replace("Title", "Titolo") for x in texts])),
    )
    obs = t.sql(_LIBRARY_OBS)
    first = obs.groupBy("item_code", "source").agg(F.min_by(F.struct("title", "maker"), "seq").alias("r")).select("item_code", "source", "r.title", "r.maker")
    houses = t.sql(_HOUSES).select("ord", F.create_map(F.lit("en"), F.concat(F.lit("House "), "p_brand")).alias("canonical"), F.array("p_brand").alias("keywords"), F.lit("").alias("href"))
    inventory = t.sql(_TWICE).withColumn("ext", F.regexp_extract("path", "(\\.[^.]*)$", 1))
    out = R.resolve_run(inventory, first, priority_frame(t.spark, _LIBRARY_PRI), options, aliases=houses, records=t.sql(_RECORDS))
    folder = F.when(F.col("target").isNotNull(), F.regexp_extract("target", "^(.*)/[^/]*$", 1)).alias("folder")
    return out.select("path", "item_code", "title", "maker", "from_record", "shared", "reason", folder)


_CATALOG = "SELECT upper(replace(p_name, ' ', '')) || '-' || lpad(cast(p_partkey AS string), 5, '0') AS item_code, cast(p_size AS string) AS date, p_partkey % 3 = 0 AS has_download, p_partkey % 5 < 2 AS has_subtitle FROM {part}"


@query(
    "missing_report",
    X.cte(f=X.PATHS, c=_CATALOG)
    + f""", {code_ctes('f')}, h0 AS (SELECT unnest([item_code, nullif(regexp_extract(item_code, '\\d{{3,}}([a-zA-Z]+-\\d+)', 1), '')]) AS item_code, p_size % 2 = 0 AS s FROM coded), h AS (SELECT item_code, bool_or(s) AS s FROM h0 GROUP BY 1),
      j AS (SELECT c.*, h.s IS NULL AS absent, h.s IS NULL AND has_download AS absent_download, has_subtitle AND NOT coalesce(h.s, false) AS subtitle_wanted FROM c LEFT JOIN h USING (item_code)) SELECT * FROM j WHERE absent OR subtitle_wanted""",
)
def missing_report(t: Tables):
    inventory = t.sql(X.PATHS).withColumn("has_subtitle", F.col("p_size") % 2 == 0)
    return R.missing_report(t.sql(_CATALOG), inventory, TOKENS, C.SHAPE_RULES)
