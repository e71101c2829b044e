"""Alias table and tag queries."""

from pyspark.sql import functions as F

from catalogfuse.operators import aliases as A
from catalogfuse.operators import tags as G
from catalogfuse.workload import fixtures as X
from catalogfuse.workload.registry import Tables, query


def alias_table(t: Tables):
    return t.sql(X.ALIASES).select(
        F.col("ord").cast("int").alias("ord"),
        F.create_map(F.lit("en"), "en", F.lit("local"), "local", F.lit("short"), "short").alias("canonical"),
        F.array("kw1", "kw2", "kw3").alias("keywords"),
        F.concat(F.lit("/a/"), F.col("ord").cast("string")).alias("href"),
    )


# Key -> first alias row, as in the index.
_INDEX = """, ax AS (SELECT upper(k) AS k, min(ord) AS ord FROM (SELECT ord, unnest([kw1, kw2, kw3, en, local, short]) AS k FROM al) GROUP BY 1),
  ix AS (SELECT ax.k, al.* FROM ax JOIN al USING (ord)) """
_WORDS = """
SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'Nation_' || cast(s_nationkey AS string) WHEN 1 THEN 'ｎation ' || cast(s_nationkey % 20 AS string) WHEN 2 THEN 'REGION_' || cast(s_nationkey % 5 AS string) WHEN 3 THEN 'r' || cast(s_nationkey % 5 AS string) ELSE s_name END AS name
FROM {supplier}
"""


@query(
    "canonicalize",
    X.cte(al=X.ALIASES, f=_WORDS)
    + _INDEX
    + "SELECT s_suppkey, f.name, CASE WHEN ix.k IS NULL THEN f.name ELSE ix.en END AS en, CASE WHEN ix.k IS NULL THEN f.name ELSE replace(ix.short, 'delete', '') END AS short FROM f LEFT JOIN ix ON upper(replace(f.name, 'ｎ', 'n')) = ix.k",
)
def canonicalize(t: Tables):
    al = alias_table(t)
    rows = A.canonicalize(t.sql(_WORDS), "name", al, "en", out="en")
    return A.canonicalize(rows, "name", al, "short", out="short", delete_marker="delete")


_LISTS = """
SELECT o_orderkey, 'nation_' || cast(o_custkey % 30 AS string) AS a, 'NATION ' || cast(o_custkey % 7 AS string) AS b, o_orderstatus AS c, 'region_' || cast(o_custkey % 6 AS string) AS d FROM {orders}
"""


@query(
    "canonicalize_list",
    X.cte(al=X.ALIASES, f=_LISTS)
    + _INDEX
    + """, u AS (SELECT o_orderkey, unnest([a, b, c, d]) AS v, unnest(range(4)) AS i FROM f),
      m AS (SELECT o_orderkey, i, CASE WHEN ix.k IS NULL THEN u.v ELSE replace(ix.short, 'delete', '') END AS n FROM u LEFT JOIN ix ON upper(u.v) = ix.k),
      z AS (SELECT o_orderkey, n, min(i) AS i FROM m WHERE n <> '' GROUP BY 1, 2) SELECT f.o_orderkey, coalesce(string_agg(n, '|' ORDER BY i), '') AS names FROM f LEFT JOIN z USING (o_orderkey) GROUP BY 1""",
)
def canonicalize_list(t: Tables):
    rows = t.sql(_LISTS).select("o_orderkey", F.array("a", "b", "c", "d").alias("names"))
    out = A.canonicalize_list(rows, "names", alias_table(t), "short", ["o_orderkey"], delete_marker="delete")
    return out.select("o_orderkey", F.array_join("names", "|").alias("names"))


_PEOPLE_NAMES = "SELECT s_suppkey AS ord, s_name AS name, 'Al' || cast(s_suppkey * 7 % 100 AS string) || '-' || s_name AS alias FROM {supplier}"
_ASKED = "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Al' || cast(c_custkey % 120 AS string) WHEN 1 THEN 'Al' || cast((c_custkey % 100) * 7 % 100 AS string) || '-Supplier#' || lpad(cast(c_custkey % 100 AS string), 9, '0') ELSE 'none' END AS who FROM {customer}"


@query(
    "alias_prefix_lookup",
    X.cte(f=_ASKED, nm=_PEOPLE_NAMES)
    + """, e AS (SELECT f.c_custkey, arg_min(nm.name, ord) AS n, arg_min(nm.alias, ord) AS a FROM f JOIN nm ON nm.alias = f.who GROUP BY 1),
      p AS (SELECT f.c_custkey, arg_min(nm.name, ord) AS n, arg_min(nm.alias, ord) AS a FROM f JOIN nm ON starts_with(nm.alias, f.who) GROUP BY 1)
      SELECT f.c_custkey, f.who, coalesce(e.n, p.n) AS person, coalesce(e.a, p.a) AS alias, CASE WHEN e.n IS NOT NULL THEN 'exact' WHEN p.n IS NOT NULL THEN 'prefix' END AS matched_by
      FROM f LEFT JOIN e USING (c_custkey) LEFT JOIN p USING (c_custkey)""",
)
def alias_prefix_lookup(t: Tables):
    return A.alias_prefix_lookup(t.sql(_ASKED), t.sql(_PEOPLE_NAMES), "who")


_FILES = "SELECT '/pics/' || cast(s_nationkey % 3 AS string) || CASE WHEN s_suppkey % 2 = 0 THEN '/sub' ELSE '' END || '/NATION_' || cast(s_suppkey % 30 AS string) || CASE WHEN s_suppkey % 4 < 2 THEN '.jpg' ELSE '.png' END AS path FROM {supplier}"
_FACES = "SELECT CASE c_custkey % 3 WHEN 0 THEN 'NATION_' || cast(c_custkey % 40 AS string) WHEN 1 THEN 'NATION_' || cast(c_custkey % 40 AS string) || 'x' ELSE 'two words' END AS name, max(c_custkey) % 3 = 0 AS has_image FROM {customer} GROUP BY 1"


@query(
    "attach_portraits",
    X.cte(fl=_FILES, f=_FACES)
    + """, ix AS (SELECT regexp_extract(path, '[^/]*$') AS file, arg_min(path, (string_split(regexp_extract(path, '^(.*)/', 1), '/'), path)) AS p FROM fl GROUP BY 1)
      SELECT name, has_image, coalesce((SELECT p FROM ix WHERE file = name || '.jpg'), (SELECT p FROM ix WHERE file = name || '.png')) AS portrait FROM f WHERE NOT has_image AND NOT contains(name, ' ')""",
)
def attach_portraits(t: Tables):
    return A.attach_portraits(t.sql(_FACES), t.sql(_FILES))


_ROWS = "SELECT s_suppkey AS ord, s_name AS en, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE lower(s_name) END AS local, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE s_name || ',x' END AS kw FROM {supplier}"


@query(
    "redundant_aliases",
    X.cte(f=_ROWS)
    + "SELECT count(*) AS total, count_if(en = local AND kw = en) AS redundant, round(count_if(en = local AND kw = en) * 100 / count(*), 2) AS percent FROM f",
)
def redundant_aliases(t: Tables):
    rows = t.sql(_ROWS).select(
        "ord", F.create_map(F.lit("en"), "en", F.lit("local"), "local").alias("canonical"), F.split("kw", ",").alias("keywords")
    )
    return A.redundancy_report(rows, ("en", "local"))


@query(
    "alias_section",
    X.cte(al=X.ALIASES)
    + """, o AS (SELECT al.*, n_name FROM al JOIN nation ON n_nationkey = ord), b AS (SELECT min(ord) AS b FROM o WHERE n_name = 'NATION_6'),
      e AS (SELECT coalesce(min(ord), 1000000) AS e FROM o, b WHERE ord >= b AND n_name IN ('NATION_17', 'NATION_3'))
      SELECT DISTINCT v AS name FROM (SELECT unnest([kw1, n_name]) AS v FROM o, b, e WHERE ord >= b AND ord < e) WHERE v <> '' AND v <> 'NATION_9'""",
)
def alias_section(t: Tables):
    rows = t.sql(X.ALIASES).select(
        F.col("ord").cast("int").alias("ord"), F.create_map(F.lit("main"), "kw2", F.lit("low"), "kw1").alias("canonical")
    )
    return A.alias_section(rows, "NATION_6", ["NATION_17", "NATION_3"], "main", ["low", "main"], skip=["NATION_9"])


_TAGGED = """
SELECT p_partkey AS item_code, p_name || ',raw ' || p_type || ',nation_' || cast(p_partkey % 30 AS string) AS tags, CASE WHEN p_partkey % 2 = 0 THEN 'Ann,Bob' ELSE '' END AS people,
  CASE WHEN p_partkey % 3 = 0 THEN 'unknown' ELSE 'RED' END AS letters, p_partkey % 4 = 0 AS has_sub, CASE WHEN p_partkey % 5 = 0 THEN 'uncut' ELSE '' END AS edition,
  CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_type END AS series, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS maker, CASE WHEN p_partkey % 8 = 0 THEN 'Label' ELSE '' END AS label
FROM {part}
"""
_OPTIONS = G.TagOptions(templates={"people": "people", "series": "S: series", "maker": "M: maker", "label": "label"}, drop_words=("raw ",), people_whitelist=("Ann", "Bob"))


@query(
    "build_tags",
    X.cte(al=X.ALIASES, f=_TAGGED)
    + _INDEX
    + """, own AS (SELECT item_code, unnest(string_split(replace(tags, 'raw ', ''), ',')) AS v, unnest(range(10, 13)) AS i FROM f),
      parts AS (
        SELECT item_code, 0 AS i, letters AS v FROM f WHERE letters <> 'unknown'
        UNION ALL SELECT item_code, 1, 'Bob' FROM f WHERE people <> '' UNION ALL SELECT item_code, 2, 'Ann' FROM f WHERE people <> ''
        UNION ALL SELECT item_code, i, CASE WHEN ix.k IS NULL THEN own.v ELSE replace(ix.short, 'delete', '') END FROM own LEFT JOIN ix ON upper(own.v) = ix.k
        UNION ALL SELECT item_code, 20, 'subtitled' FROM f WHERE has_sub UNION ALL SELECT item_code, 21, edition FROM f
        UNION ALL SELECT item_code, 22, 'S: ' || series FROM f WHERE series <> '' UNION ALL SELECT item_code, 23, 'M: ' || coalesce(nullif(maker, ''), nullif(label, '')) FROM f
        UNION ALL SELECT item_code, 24, coalesce(nullif(label, ''), nullif(maker, '')) FROM f),
      d AS (SELECT item_code, v, min(i) AS i FROM parts WHERE v <> '' GROUP BY 1, 2) SELECT item_code, string_agg(v, '|' ORDER BY i) AS tags FROM d GROUP BY 1""",
)
def build_tags(t: Tables):
    rows = t.sql(_TAGGED).withColumns(
        {"tags": F.split("tags", ","), "people": F.filter(F.split("people", ","), lambda p: p != "")}
    )
    out = G.build_tags(rows, _OPTIONS, aliases=alias_table(t), lang="short", delete_marker="delete")
    return out.select("item_code", F.array_join("tags", "|").alias("tags"))


@query(
    "prioritize_tags",
    """WITH f AS (SELECT p_partkey, string_split(p_name, ' ') AS w, p_type FROM part), l AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN [w[1]] ELSE [p_type, 'Series ' || p_type, w[1], 'x', upper(w[2]), 'series'] END AS t FROM f),
      k AS (SELECT p_partkey, t, list_filter(t, lambda x: lower(x) IN ('red', 'hot', 'widget', 'plate')) AS a, list_filter(t, lambda x: lower(x) NOT IN ('red', 'hot', 'widget', 'plate') AND regexp_matches(lower(x), '^series .')) AS b FROM l)
      SELECT p_partkey, array_to_string(CASE WHEN len(t) < 2 OR len(a) = 0 THEN t ELSE list_concat(a, b, list_filter(t, lambda x: lower(x) NOT IN ('red', 'hot', 'widget', 'plate') AND NOT regexp_matches(lower(x), '^series .'))) END, '|') AS tags FROM k""",
)
def prioritize_tags(t: Tables):
    w = F.split("p_name", " ")
    tags = F.when(F.col("p_partkey") % 5 == 0, F.array(w[0])).otherwise(
        F.array("p_type", F.concat(F.lit("Series "), "p_type"), w[0], F.lit("x"), F.upper(w[1]), F.lit("series"))
    )
    rows = t("part").select("p_partkey", tags.alias("tags"))
    out = G.prioritize_tags("tags", ["Red", "hot", "widget", "plate"], None, "Series NAME", "NAME")
    return rows.select("p_partkey", F.array_join(out, "|").alias("tags"))


@query(
    "prioritize_tags_mixed",
    """WITH f AS (SELECT p_partkey, list_concat(string_split(p_name, ' '), [p_type, p_brand]) AS tags FROM part),
      g AS (SELECT *, list_filter(tags, lambda x: lower(trim(x)) IN ('red', 'hot', 'widget', 'plate')) AS pr, list_filter(tags, lambda x: lower(trim(x)) NOT IN ('red', 'hot', 'widget', 'plate')) AS rs FROM f),
      h AS (SELECT *, list_transform(list_sort(list_transform(pr, lambda x: md5(p_partkey || '|' || x) || x)), lambda x: substr(x, 33)) AS mx FROM g)
      SELECT p_partkey, array_to_string(CASE WHEN len(tags) < 2 OR len(pr) = 0 THEN tags ELSE list_concat(mx, rs) END, '|') AS tags FROM h""",
)
def prioritize_tags_mixed(t: Tables):
    """Priority tags mixed by a hash of item and tag: the same order on every run."""
    tags = F.concat(F.split("p_name", " "), F.array("p_type", "p_brand"))
    rows = t("part").select("p_partkey", tags.alias("tags"))
    out = G.prioritize_tags("tags", ["red", "hot", "widget", "plate"], shuffle_by=F.col("p_partkey"))
    return rows.select("p_partkey", F.array_join(out, "|").alias("tags"))


_CREDITED = """
SELECT o_orderkey, 'C-' || cast(o_custkey AS string) AS item_code, CASE o_orderkey % 2 WHEN 0 THEN lower(n_name) ELSE 'stage (' || n_name || ')' END AS person,
  CASE WHEN o_orderkey % 3 = 0 THEN 'C-' || cast(o_custkey AS string) || ' ' ELSE '' END || o_orderpriority || '/' || o_orderstatus
  || CASE o_orderkey % 5 WHEN 0 THEN ' ' || lower(n_name) WHEN 1 THEN ' ' || n_name || ' nation ' || cast(n_nationkey % 20 AS string) WHEN 2 THEN ' nation ' || cast(n_nationkey % 20 AS string) || ' ' || n_name WHEN 3 THEN ' Someone' ELSE '' END AS title
FROM {orders} JOIN {nation} ON n_nationkey = o_custkey % 25
"""
_STRIP = ", ".join(
    f"s{i} AS (SELECT * REPLACE (CASE WHEN len(list_filter(nm, lambda x: ends_with(title, ' ' || x))) > 0 THEN left(title, length(title) - length(list_filter(nm, lambda x: ends_with(title, ' ' || x))[1]) - 1) ELSE title END AS title) FROM {'c' if i == 1 else f's{i - 1}'})"
    for i in (1, 2, 3)
)


@query(
    "strip_title_names",
    X.cte(f=_CREDITED, al=X.ALIASES)
    + f"""kx AS (SELECT upper(k) AS k, min(ord) AS ord FROM (SELECT ord, unnest([kw1, kw2, kw3, en, local, short]) AS k FROM al) GROUP BY 1),
      q AS (SELECT o_orderkey, upper(trim(unnest(list_concat([person], regexp_extract_all(person, '([^()]+)', 1))))) AS k FROM f),
      h AS (SELECT DISTINCT o_orderkey, unnest([al.kw1, al.kw2, al.kw3]) AS nm FROM q JOIN kx USING (k) JOIN al USING (ord)),
      n AS (SELECT o_orderkey, list(nm ORDER BY length(nm) DESC, nm) AS nm FROM h GROUP BY 1),
      c AS (SELECT f.o_orderkey, f.item_code, f.title, coalesce(n.nm, []) AS nm FROM f LEFT JOIN n USING (o_orderkey)), {_STRIP}
      SELECT o_orderkey, trim(replace(CASE WHEN item_code <> trim(title) AND starts_with(trim(title), item_code) THEN trim(replace(trim(title), item_code, '')) ELSE trim(title) END, '/', '#'), ' -') AS title FROM s3""".replace("kx AS", ", kx AS", 1),
)
def strip_title_names(t: Tables):
    """Titles end with a nation's other names; people are credited by one of them, in brackets or not."""
    rows = t.sql(_CREDITED).withColumn("people", F.array("person"))
    return A.strip_title_names(rows, alias_table(t), "o_orderkey").select("o_orderkey", "title")
