"""Queries about people."""

from pyspark.sql import functions as F

from catalogfuse.functions import people as P
from catalogfuse.workload import fixtures as X
from catalogfuse.workload.registry import Tables, query

_NAMES = """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Ann (安), Bob' WHEN 1 THEN ' Ann | Ann |-| Cy （シ） ' WHEN 2 THEN '' WHEN 3 THEN '_/Dee' WHEN 4 THEN 'Eve、Fay，Eve' ELSE 'Gil' END || ',P' || cast(o_custkey % 50 AS string) AS raw
FROM {orders}
"""
_CLEAN = """, u AS (SELECT o_orderkey, unnest(regexp_split_to_array(raw, '[|｜,，/／、]')) AS x0, generate_subscripts(regexp_split_to_array(raw, '[|｜,，/／、]'), 1) AS i FROM f),
  v AS (SELECT o_orderkey, i, trim(x0) AS x FROM u), w AS (SELECT o_orderkey, i, CASE WHEN trim(regexp_extract(x, '[（(]\\s*([^()（）]+?)\\s*[）)]', 1)) <> '' THEN trim(regexp_extract(x, '[（(]\\s*([^()（）]+?)\\s*[）)]', 1)) ELSE x END AS n FROM v WHERE x NOT IN ('', '-', '_')),
  d AS (SELECT o_orderkey, n, min(i) AS i FROM w GROUP BY 1, 2) """


@query(
    "clean_people",
    X.cte(f=_NAMES)
    + _CLEAN
    + "SELECT o_orderkey, string_agg(n, '|' ORDER BY i) AS all_people, coalesce(string_agg(n, '|' ORDER BY i) FILTER (n NOT IN ('安', 'P7')), '') AS people FROM d GROUP BY 1",
)
def clean_people(t: Tables):
    rows = t.sql(_NAMES).withColumn("names", P.clean_people("raw"))
    return rows.select(
        "o_orderkey", F.array_join("names", "|").alias("all_people"),
        F.array_join(P.exclude_people("names", ["安", "P7"]), "|").alias("people"),
    )


@query(
    "only_own_tags",
    """WITH f AS (SELECT p_partkey, [p_name, p_type, 'by: ' || p_brand, 'a' || split_part(p_name, ' ', 1), '', 'x'] AS tags, [split_part(p_name, ' ', 1), ''] AS names FROM part)
      SELECT p_partkey, array_to_string(list_filter(tags, lambda x: x <> '' AND NOT contains(x, ':') AND NOT contains(x, '：') AND NOT contains(x, names[1])), '|') AS tags FROM f""",
)
def only_own_tags(t: Tables):
    first = F.split("p_name", " ")[0]
    tags = F.array("p_name", "p_type", F.concat(F.lit("by: "), "p_brand"), F.concat(F.lit("a"), first), F.lit(""), F.lit("x"))
    own = P.only_own_tags(tags, F.array(first, F.lit("")))
    return t("part").select("p_partkey", F.array_join(own, "|").alias("tags"))


_PROFILES = """
SELECT c_custkey, 'name: ' || c_name || chr(10) || CASE c_custkey % 4 WHEN 0 THEN 'born: 1985年3月7日 (x)' WHEN 1 THEN 'born: 79年12月' || cast(c_custkey % 28 + 1 AS string) || '日' WHEN 2 THEN 'born: 5年1月1日' ELSE 'age: 30' END || chr(10)
  || 'home: ' || CASE c_custkey % 3 WHEN 0 THEN 'Land' WHEN 1 THEN 'Land·City' || cast(c_nationkey AS string) || ' → x' ELSE 'Town' || cast(c_nationkey AS string) END AS profile
FROM {customer}
"""


@query(
    "parse_profile",
    X.cte(f=_PROFILES)
    + """, b AS (SELECT c_custkey, regexp_extract(profile, 'born: (\\d+)年(\\d+)月(\\d+)日', ['y', 'm', 'd']) AS s, regexp_extract(regexp_extract(profile, 'home: (.*)', 1), '[^ →]+') AS h FROM f)
      SELECT c_custkey, CASE WHEN s.y <> '' THEN CASE length(s.y) WHEN 4 THEN s.y WHEN 2 THEN '19' || s.y ELSE '1970' END || '-' || lpad(s.m, 2, '0') || '-' || lpad(s.d, 2, '0') END AS born,
        CASE WHEN h <> '' AND h <> 'Land' THEN 'Land·' || replace(replace(h, 'Land·', ''), 'Land', '') END AS place FROM b""",
)
def parse_profile(t: Tables):
    return t.sql(_PROFILES).select(
        "c_custkey", P.birth_date("profile", ["born"]).alias("born"), P.birth_place("profile", ["home"], "Land").alias("place")
    )


_FACTS = """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE cast(150 + c_custkey % 30 AS string) END AS height, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE cast(80 + c_custkey % 9 AS string) END AS bust,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '60' END AS waist, '' AS hip, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE cast(1980 + c_custkey % 20 AS string) || '-05-06 00:00' END AS birthday,
  CASE WHEN c_custkey % 2 = 0 THEN '2010年 - 2015年' ELSE '' END AS career, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'https://social.example/u' || cast(c_custkey AS string) END AS account
FROM {customer}
"""


@query(
    "person_facts",
    X.cte(f=_FACTS)
    + """SELECT c_custkey, array_to_string(list_filter([CASE WHEN height <> '' THEN 'height: ' || height END, CASE WHEN coalesce(bust, '') <> '' OR waist <> '' OR hip <> '' THEN 'measures: ' || coalesce(bust, '') || '/' || waist || '/' || hip END,
        CASE WHEN birthday <> '' THEN 'born: ' || left(birthday, 10) END, CASE WHEN birthday <> '' THEN 'age: ' || (2024 - CAST(left(birthday, 4) AS INT)) END, CASE WHEN career <> '' THEN 'career: 2010~2015' END], lambda x: x IS NOT NULL), '|') AS tags,
      nullif(regexp_extract(account, 'social\\.example/(.*)', 1), '') AS account FROM f""",
)
def person_facts(t: Tables):
    tags = P.person_tags("height", "bust", "waist", "hip", "birthday", "career", 2024)
    return t.sql(_FACTS).select(
        "c_custkey", F.array_join(tags, "|").alias("tags"), P.account_id("account", "social.example").alias("account")
    )


def claims(t: Tables):
    """Entity-claims JSON of every customer; some lack the second property."""
    def claim(value):
        return F.array(F.struct(F.struct(F.struct(value.alias("value")).alias("datavalue")).alias("mainsnak")))

    text = lambda c: F.struct(c.alias("value"))
    key = F.col("c_custkey")
    body = F.struct(
        F.struct(
            F.when(key % 3 == 0, text(F.concat(F.lit("own "), "c_mktsegment"))).alias("xx"),
            text(F.lower("c_mktsegment")).alias("en"),
        ).alias("descriptions"),
        F.struct(
            claim(key.cast("string")).alias("P1"), F.when(key % 4 != 0, claim(F.col("c_name"))).alias("P2"),
            claim(F.col("c_mktsegment")).alias("P3"),
        ).alias("claims"),
    )
    entity = F.concat(F.lit("Q"), key.cast("string"))
    doc = F.to_json(F.struct(F.create_map(entity, body).alias("entities")))
    return t.read("customer", spread=True).select("c_custkey", entity.alias("entity"), doc.alias("doc"))


@query(
    "extract_provider_ids",
    """WITH f AS (SELECT c_custkey, c_name, c_mktsegment FROM customer)
      SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS one, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS two, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS three,
        CASE WHEN c_custkey % 3 = 0 THEN 'own ' || c_mktsegment WHEN c_mktsegment = 'BUILDING' THEN 'BAU' END AS about FROM f""",
)
def extract_provider_ids(t: Tables):
    rows = claims(t).withColumn("ids", P.provider_ids("doc", "entity", [("one", "P1"), ("two", "P2"), ("three", "P3")]))
    return rows.select(
        "c_custkey", *[F.col("ids")[k].alias(k) for k in ("one", "two", "three")],
        P.description("doc", "entity", "xx", {"building": "BAU"}).alias("about"),
    )


_CASTS = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN '' WHEN 2 THEN 'Ann,unknown' ELSE 'Bob' END AS people, CASE o_custkey % 3 WHEN 0 THEN 'cut' WHEN 1 THEN 'amateur' ELSE 'scene' END AS item_type FROM {orders}"


@query(
    "needs_person_lookup",
    X.cte(f=_CASTS)
    + "SELECT o_orderkey, CASE WHEN item_type = 'cut' THEN people IN ('unknown', '') ELSE item_type = 'amateur' END AS lookup FROM f",
)
def needs_person_lookup(t: Tables):
    flag = P.needs_person_lookup(F.split("people", ","), "item_type", ["amateur"], ["cut"], "unknown")
    return t.sql(_CASTS).select("o_orderkey", flag.alias("lookup"))
