"""Naming queries."""

from pyspark.sql import functions as F

from catalogfuse.functions import naming as N
from catalogfuse.workload import fixtures as X
from catalogfuse.workload.registry import Tables, query

_ITEMS = """
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE code END AS number, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_name || ' the long / title' END AS title, p_brand AS studio,
  CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN 'Ann,Bob,Cy,Dee' ELSE 'Ann' END AS actor, 'Ann,Bob' AS all_actor, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS series,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '2020-0' || cast(p_partkey % 9 + 1 AS string) || '-15' END AS release, CASE p_partkey % 4 WHEN 0 THEN 'UHD8' WHEN 1 THEN '4K' ELSE '1080P' END AS definition,
  CASE WHEN p_partkey % 2 = 0 THEN '-C' ELSE '' END AS cnword, CASE WHEN p_partkey % 6 = 0 THEN '-U' ELSE '' END AS moword, 'file' || cast(p_partkey AS string) AS filename, 'RED' AS letters
FROM ({codes})
""".replace("{codes}", X.CODES)

_CTX = """, c AS (SELECT *, replace(definition, 'UHD8', 'UHD') AS d0 FROM f),
  e AS (SELECT *, d0 IN ('8K', 'UHD', '4K') AS k4, coalesce(nullif(number, ''), nullif(title, ''), filename) || moword || cnword || CASE WHEN d0 IN ('8K', 'UHD', '4K') THEN '-' || d0 ELSE '' END AS num0,
    coalesce(nullif(actor, ''), 'nobody') AS act0 FROM c),
  x AS (SELECT p_partkey, studio AS studio0, trim(replace(num0, '/', '-'), '. ') AS n_number, trim(replace(title, '/', '-'), '. ') AS n_title, trim(split_part(act0, ',', 1), '. ') AS n_first,
    CASE WHEN len(string_split(act0, ',')) > 3 THEN array_to_string(string_split(act0, ',')[1:3], ',') || '+' ELSE act0 END AS n_actor,
    coalesce(nullif(series, ''), 'no series') AS n_series, coalesce(nullif(replace(release, '-', '.'), ''), '0000.00.00') AS n_release,
    CASE WHEN regexp_matches(upper(left(num0, 1)), '^[A-Z0-9]$') THEN upper(left(num0, 1)) ELSE '#' END AS n_letter, CASE WHEN k4 THEN d0 ELSE '' END AS n_four_k FROM e)"""


def context(t: Tables):
    return N.naming_context(
        t.sql(_ITEMS), show=("moword", "cnword", "definition"), unknown_person="nobody", unknown_series="no series",
        people_max=3, people_more="+", release_pattern="YYYY.MM.DD",
    )


@query(
    "naming_context",
    X.cte(f=_ITEMS)
    + _CTX
    + " SELECT p_partkey, n_number, n_title, n_first, n_actor, n_series, n_release, n_letter, n_four_k, '0.0' AS n_score, '0000' AS n_year FROM x",
)
def naming_context(t: Tables):
    return context(t).select(
        "p_partkey", "n_number", "n_title", F.col("n_first_actor").alias("n_first"), "n_actor", "n_series", "n_release",
        F.col("n_first_letter").alias("n_letter"), "n_four_k", "n_score", "n_year",
    )


TEMPLATE = "{{number}}{% if title %} {{title}}{% else %} untitled{% endif %} [{{actor}}]{% if four_k %} {{four_k}}{% endif %}"
_SAFE = "rtrim(trim(trim(replace(regexp_replace(trim(regexp_replace(trim(regexp_replace({t}, '[ \\t]+', ' ', 'g')), '[\\\\/:*?\"<>|\\r\\n]+', '', 'g')), '[ \\t]{{2,}}', ' ', 'g'), '--', '-')), '- .'), '. ')"


@query(
    "render_names",
    X.cte(f=_ITEMS)
    + _CTX
    + ", r AS (SELECT p_partkey, n_number || CASE WHEN n_title <> '' THEN ' ' || n_title ELSE ' untitled' END || ' [' || n_actor || ']' || CASE WHEN n_four_k <> '' THEN ' ' || n_four_k ELSE '' END AS t FROM x) SELECT p_partkey, trim("
    + _SAFE.format(t="t")
    + ") AS name FROM r",
)
def render_names(t: Tables):
    return N.render_names(context(t), TEMPLATE).select("p_partkey", "name")


def _clip(v: str, room: str) -> str:
    return f"CASE WHEN {room} <= 0 THEN '' WHEN length({v}) <= {room} THEN {v} ELSE rtrim(left({v}, {room}), ' ,，、;；:：._+-') END"


@query(
    "render_names_clipped",
    X.cte(f=_ITEMS)
    + _CTX
    + f""", a AS (SELECT p_partkey, n_number, n_title, trim({_SAFE.format(t="n_number || ' ' || n_title")}) AS t0 FROM x),
      b AS (SELECT *, CASE WHEN length(t0) > 24 THEN {_clip('n_title', 'greatest(length(n_title) - (length(t0) - 24), 0)')} ELSE n_title END AS title1 FROM a),
      c2 AS (SELECT *, CASE WHEN title1 <> n_title THEN trim({_SAFE.format(t="n_number || ' ' || title1")}) ELSE t0 END AS t1 FROM b),
      d AS (SELECT *, CASE WHEN length(t1) > 24 THEN {_clip('n_number', 'greatest(length(n_number) - (length(t1) - 24), 0)')} ELSE n_number END AS num1 FROM c2),
      g AS (SELECT *, CASE WHEN num1 <> n_number THEN trim({_SAFE.format(t="num1 || ' ' || title1")}) ELSE t1 END AS t2 FROM d)
      SELECT p_partkey, t2 AS name, array_to_string(list_filter([CASE WHEN title1 <> n_title THEN 'title' END, CASE WHEN num1 <> n_number THEN 'number' END], lambda x: x IS NOT NULL), ',') AS cut FROM g""",
)
def render_names_clipped(t: Tables):
    out = N.render_names(context(t), "{{number}} {{title}}", max_length=24, truncated_out="cut")
    return out.select("p_partkey", "name", F.array_join("cut", ",").alias("cut"))


_RAW_NAMES = "SELECT p_partkey, ' ' || p_brand || ' :/ ' || replace(p_name, ' ', CASE p_partkey % 3 WHEN 0 THEN '  --  ' WHEN 1 THEN '?*' ELSE '//' END) || CASE p_partkey % 4 WHEN 0 THEN ' /- .' WHEN 1 THEN '. ' ELSE '' END AS raw FROM {part}"


@query(
    "sanitize_name",
    X.cte(f=_RAW_NAMES)
    + f""", s AS (SELECT p_partkey, raw, trim(regexp_replace(raw, '[ \\t]+', ' ', 'g')) AS t FROM f),
      p AS (SELECT p_partkey, raw, replace(replace(regexp_replace(trim(regexp_replace(t, '[\\\\:*?"<>|\\r\\n]+', '', 'g'), ' /'), '/{{2,}}', '/', 'g'), ' /', '/'), '/ ', '/') AS u FROM s),
      q AS (SELECT p_partkey, raw, list_filter(list_transform(string_split(u, '/'), lambda x: trim(rtrim(trim(replace(regexp_replace(x, '[ \\t]{{2,}}', ' ', 'g'), '--', '-')), '. '))), lambda x: trim(x, '._- ') <> '') AS l FROM p)
      SELECT p_partkey, trim({_SAFE.format(t='raw')}) AS file_name, trim(array_to_string(l, '/'), '- .') AS folder_name FROM q""",
)
def sanitize_name(t: Tables):
    return t.sql(_RAW_NAMES).select(
        "p_partkey", N.sanitize_name("raw").alias("file_name"), N.sanitize_name("raw", True).alias("folder_name")
    )
