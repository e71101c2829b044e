"""Item codes and facts of paths."""

from pyspark.sql import functions as F

from catalogfuse.functions import codes as C
from catalogfuse.functions import paths as P
from catalogfuse.operators.classify import ClassRule, classify_items
from catalogfuse.workload import fixtures as X
from catalogfuse.workload.registry import Tables, query

TOKENS = ("site.example", "gizmo", "-x-")

# SQL twins of the shared steps -----------------------------------------------------------------
STEM = "regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')"


def strip_noise_sql(text: str, repl: str = "") -> str:
    out = f"upper({text})"
    for tok in sorted({t.upper() for t in TOKENS}, key=lambda x: (-len(x), x)):
        out = f"replace({out}, '{tok}', '{repl}')"
    for word in C.QUALITY_WORDS:
        out = f"regexp_replace({out}, '[-_ .\\[]{word}[-_ .\\]]', '-', 'g')"
    return f"trim(replace({out}, '--', '-'), '-_. ')"


def code_ctes(source: str) -> str:
    """CTEs from ``source(path, ...)`` to ``coded(path, item_code, ...)``."""
    digit = "regexp_matches(bare, '^\\d{6}[-_]\\d{2,4}$')"
    dated = "([A-Z0-9_]{2,})[-.]2?0?(\\d{2}[-.]\\d{2}[-.]\\d{2})"
    parts = "([A-Z0-9-]{2,})[-_.]2?0?(\\d{2}[-.]\\d{2}[-.]\\d{2})"
    first = "regexp_extract({s}, '{p}', {g})"

    def g(p, i, s="bare"):
        return first.format(s=s, p=p, g=i)

    def shape(p, value):
        return f"WHEN regexp_matches(bare, '{p}') THEN {value}"

    two = lambda p: f"{g(p, 1)} || '-' || {g(p, 2)}"
    n_code = "(^|[^A-Z])(N\\d{4})(\\D|$)"
    series = f"lower(trim({g(parts, 1, 'dated')}, '-')) || '.' || replace({g(parts, 2, 'dated')}, '-', '.')"
    cases = " ".join(
        [
            f"WHEN {digit} THEN bare",
            f"WHEN regexp_matches(dated, '{dated}') AND regexp_matches(dated, '{parts}') THEN upper(left({series}, 1)) || substr({series}, 2)",
            shape("([A-Z]{2,})00(\\d{3})", two("([A-Z]{2,})00(\\d{3})")),
            shape("\\d{2,}[A-Z]{2,}-\\d{2,}[A-Z]?", g("\\d{2,}[A-Z]{2,}-\\d{2,}[A-Z]?", 0)),
            shape("[A-Z]{2,}-\\d{2,}[Z]?", g("[A-Z]{2,}-\\d{2,}[Z]?", 0)),
            shape("[A-Z]+-[A-Z]\\d+", g("[A-Z]+-[A-Z]\\d+", 0)),
            shape("\\d{2,}[-_]\\d{2,}", g("\\d{2,}[-_]\\d{2,}", 0)),
            shape("\\d{3,}-[A-Z]{3,}", g("\\d{3,}-[A-Z]{3,}", 0)),
            shape(n_code, f"lower({g(n_code, 2)})"),
            shape("H_\\d{3,}([A-Z]{2,})(\\d{2,})", two("H_\\d{3,}([A-Z]{2,})(\\d{2,})")),
            shape("([A-Z]{3,}).*?(\\d{2,})", two("([A-Z]{3,}).*?(\\d{2,})")),
            shape("([A-Z]{2,}).*?(\\d{3,})", two("([A-Z]{2,}).*?(\\d{3,})")),
            "ELSE trim(regexp_replace(clean, '[【(（\\[].+?[]）)】]', '', 'g'), '@. ')",
        ]
    )
    return f"""c1 AS (SELECT *, {strip_noise_sql(f"trim({STEM}) || '.'")} || '.' AS clean FROM {source}),
      c2 AS (SELECT *, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(clean, '-C.', '.'), '.PART', '-CD'), '-PART', '-CD'), ' EP.', '.EP'), '-CD-', ''),
        '[-_ .]CD\\d{{1,2}}', '', 'g'), '[-_ .][A-Z0-9]\\.$', '', 'g') AS nm FROM c1),
      c3 AS (SELECT *, trim(replace(nm, ' ', '-'), '-_. ') AS dated FROM c2),
      c4 AS (SELECT *, replace(regexp_replace(regexp_replace(dated, '\\d{{4}}[-_.]\\d{{1,2}}[-_.]\\d{{1,2}}', '', 'g'), '[-\\[]\\d{{2}}[-_.]\\d{{2}}[-_.]\\d{{2}}\\]?', '', 'g'), '--', '-') AS bare FROM c3),
      coded AS (SELECT * EXCLUDE (clean, nm, dated, bare), trim(CASE {cases} END, '-_. ') AS item_code FROM c4)"""


def paths(t: Tables):
    return t.sql(X.PATHS)


def coded(t: Tables):
    return C.extract_item_code(paths(t), tokens=TOKENS)


@query("strip_noise", X.cte(f=X.PATHS) + f"SELECT p_partkey, {strip_noise_sql(STEM)} AS name FROM f")
def strip_noise(t: Tables):
    return paths(t).select("p_partkey", C.strip_noise(C.file_stem("path"), TOKENS).alias("name"))


@query("extract_item_code", X.cte(f=X.PATHS) + f", {code_ctes('f')} SELECT p_partkey, path, item_code FROM coded")
def extract_item_code(t: Tables):
    return coded(t).select("p_partkey", "path", "item_code")


@query(
    "normalize_digit_code",
    X.cte(f=X.CODES)
    + "SELECT p_partkey, CASE WHEN regexp_matches(code, '(?i)^((vendor)[-_ ]*)?\\d{6}[-_]\\d{2,4}$') THEN regexp_extract(code, '\\d{6}[-_]\\d{2,4}$', 0) END AS digit_code FROM f",
)
def normalize_digit_code(t: Tables):
    return t.sql(X.CODES).select("p_partkey", C.normalize_digit_code("code", ["vendor"]).alias("digit_code"))


@query(
    "code_prefix",
    X.cte(f=X.CODES)
    + """SELECT p_partkey, CASE WHEN regexp_matches(code, '([A-Za-z0-9-.]{3,})[-_. ]\\d{2}\\.\\d{2}\\.\\d{2}') THEN regexp_extract(code, '([A-Za-z0-9-.]{3,})[-_. ]\\d{2}\\.\\d{2}\\.\\d{2}', 1)
      WHEN starts_with(upper(code), 'RED') THEN 'RED' WHEN regexp_matches(code, '\\d*[A-Za-z]+') THEN regexp_extract(code, '(\\d*[A-Za-z]+)\\d*', 1) ELSE 'unknown' END AS letters,
      CASE WHEN regexp_matches(upper(left(code, 1)), '^[A-Z0-9]$') THEN upper(left(code, 1)) ELSE '#' END AS bucket FROM f""",
)
def code_prefix(t: Tables):
    return t.sql(X.CODES).select(
        "p_partkey", C.code_prefix("code", ["RED"]).alias("letters"), C.first_letter_bucket("code").alias("bucket")
    )


@query(
    "expand_series",
    X.cte(f=X.CODES)
    + """SELECT p_partkey, CASE lower(split_part(p_name, ' ', 1)) WHEN 'red' THEN 'rougelong' WHEN 'hot' THEN 'veryhot' ELSE lower(split_part(p_name, ' ', 1)) END AS series FROM f""",
)
def expand_series(t: Tables):
    names = {"Red": "Rouge-Long", "HOT": "Very.Hot"}
    return t.sql(X.CODES).select("p_partkey", C.expand_series(F.split("p_name", " ")[0], names).alias("series"))


@query(
    "supplement_prefix",
    X.cte(f=X.CODES)
    + "SELECT p_partkey, CASE WHEN starts_with(upper(code), 'RED') THEN '300' || code WHEN starts_with(upper(code), 'RE') THEN '301' || code WHEN starts_with(upper(code), 'HOT') THEN '259' || code ELSE code END AS code FROM f",
)
def supplement_prefix(t: Tables):
    table = [("RED", "300"), ("RE", "301"), ("HOT", "259")]
    return t.sql(X.CODES).select("p_partkey", C.supplement_prefix("code", table).alias("code"))


@query(
    "short_code",
    X.cte(f=X.CODES) + "SELECT p_partkey, nullif(regexp_extract(code, '\\d{3,}([a-zA-Z]+-\\d+)', 1), '') AS short FROM f",
)
def short_code(t: Tables):
    return t.sql(X.CODES).select("p_partkey", C.short_code("code").alias("short"))


_ONE = "'([A-Z]{3,})-?(\\d{2,})'"
_MULTI = "'([A-Z]{2,})-?(\\d{3,})-(\\d+)'"
_DOUBLE = "'([A-Z]{2,})-([A-Z]{2,})-(\\d+)'"
_TWO = "'([A-Z]{2,})-?(\\d{3,})'"


def _cand_sql() -> str:
    def x(p, i):
        return f"regexp_extract(nm, {p}, {i})"

    three = [f"{x(_ONE, 1)} || '{s}' || {x(_ONE, 2)}" for s in ("-", "", "-0", "0")]
    two = [f"{x(_TWO, 1)} || '{s}' || {x(_TWO, 2)}" for s in ("-", "", " ")]
    two += [f"CASE WHEN length({x(_TWO, 2)}) = 3 THEN {x(_TWO, 1)} || '{s}0' || {x(_TWO, 2)} END" for s in ("-", "", " ")]
    ep, bare = (f"'{C.SPELLINGS[k]}'" for k in ("episode", "bare"))
    tidy = lambda zero: f"replace(replace({x(ep, 1)} || '-{zero}' || {x(ep, 2)} || '.' || {x(ep, 3)} || {x(ep, 4)}, '..', '.'), ' ', '')"
    episode = f"[{tidy('')}, replace({tidy('')}, '.', ' '), {x(ep, 1)} || {x(ep, 2)}, CASE WHEN length({x(ep, 2)}) = 3 THEN {tidy('0')} END]"
    return f"""CASE WHEN regexp_matches(nm, {_MULTI}) THEN [{x(_MULTI, 1)} || '-' || {x(_MULTI, 2)} || '-' || {x(_MULTI, 3)}]
      WHEN contains(nm, 'EP') THEN CASE WHEN regexp_matches(nm, {ep}) THEN {episode} WHEN regexp_matches(nm, {bare}) THEN [{x(bare, 1)}] ELSE [] END
      WHEN regexp_matches(nm, {_DOUBLE}) THEN [{x(_DOUBLE, 1)} || '-' || {x(_DOUBLE, 2)} || '-' || {x(_DOUBLE, 3)}]
      WHEN regexp_matches(nm, {_ONE}) THEN [{', '.join(three)}] WHEN regexp_matches(nm, {_TWO}) THEN [{', '.join(two)}] ELSE [] END"""


@query(
    "candidate_codes",
    X.cte(f=X.CODES)
    + f""", g AS (SELECT p_partkey, regexp_replace(upper(code) || CASE WHEN p_partkey % 9 = 0 THEN '.EP3.NAME' WHEN p_partkey % 9 = 1 THEN '-TAIL' ELSE '' END, '-[^0-9]+?$', '') AS nm FROM f), l AS (SELECT p_partkey, {_cand_sql()} AS c FROM g),
      u AS (SELECT p_partkey, unnest(c) AS cand, generate_subscripts(c, 1) AS i FROM l),
      d AS (SELECT p_partkey, cand, min(i) AS i FROM u WHERE cand <> '' GROUP BY 1, 2)
      SELECT p_partkey, cand, row_number() OVER (PARTITION BY p_partkey ORDER BY length(cand), i) - 1 AS pos FROM d""",
)
def candidate_codes(t: Tables):
    tail = F.when(F.col("p_partkey") % 9 == 0, ".EP3.NAME").when(F.col("p_partkey") % 9 == 1, "-TAIL").otherwise("")
    rows = t.sql(X.CODES).select("p_partkey", C.candidate_codes(F.concat(F.upper("code"), tail)).alias("c"))
    return rows.select("p_partkey", F.posexplode("c").alias("pos", "cand"))


@query(
    "code_variants",
    X.cte(f=X.CODES)
    + """, g AS (SELECT p_partkey, upper(trim(code)) AS c, upper(nullif(regexp_extract(code, '\\d{3,}([a-zA-Z]+-\\d+)', 1), '')) AS s FROM f),
      l AS (SELECT p_partkey, [regexp_replace(c, '^([A-Z0-9]+)-0+(\\d+)$', '\\1-\\2'), regexp_replace(s, '^([A-Z0-9]+)-0+(\\d+)$', '\\1-\\2'), c, s] AS v FROM g)
      SELECT p_partkey, array_to_string(list_filter(v, lambda x, i: x IS NOT NULL AND list_position(v, x) = i), '|') AS variants FROM l""",
)
def code_variants(t: Tables):
    return t.sql(X.CODES).select(
        "p_partkey", F.array_join(C.code_variants("code", C.short_code("code")), "|").alias("variants")
    )


_LABELS = ("small", "gizmo")


@query(
    "candidate_titles",
    X.cte(d=X.LINES)
    + """, f AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g') AS nm FROM d),
      w AS (SELECT doc_id, nm, list_filter(string_split(regexp_replace(upper(replace(nm, 'ß', 'ss')), '[^\\p{L}\\p{N}\\p{M}]', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM f),
      p AS (SELECT doc_id, nm, w, len(w) AS n FROM w),
      l AS (SELECT doc_id, CASE WHEN n > 1 THEN list_concat(list_filter(w, lambda x: length(x) > 7), [
          array_to_string(w, ' '),
          CASE WHEN n > 2 AND length(array_to_string(w[1:2], '')) > 10 THEN array_to_string(w[1:2], ' ') END,
          CASE WHEN n > 2 AND length(array_to_string(w[3:n], '')) > 10 THEN array_to_string(w[3:n], ' ') END,
          CASE WHEN n > 3 AND length(array_to_string(w[2:n-1], '')) > 10 THEN array_to_string(w[2:n-1], ' ') END,
          CASE WHEN n > 3 AND length(array_to_string(w[3:n-2], '')) > 10 THEN array_to_string(w[3:n-2], ' ') END, nm])
        ELSE [trim(left(upper(replace(nm, 'ß', 'ss')), 30)), CASE WHEN length(nm) > 38 THEN trim(substr(upper(replace(nm, 'ß', 'ss')), 11, 20)) END, nm] END AS v FROM p)
      SELECT doc_id, array_to_string(list_filter(v, lambda x, i: x IS NOT NULL AND x <> '' AND list_position(v, x) = i), '|') AS titles FROM l""",
)
def candidate_titles(t: Tables):
    """Every line of every document as a name."""
    lines = t.sql(X.LINES).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", F.array_join(C.candidate_titles(F.regexp_replace("line", "\\s+", " ")), "|").alias("titles"))


@query(
    "is_prefix_family",
    X.cte(f=X.CODES)
    + "SELECT p_partkey, regexp_matches(upper(code), '^(RED|HOT|BLUE)') OR regexp_matches(code, '[^.]+\\.\\d{2}\\.\\d{2}\\.\\d{2}') OR regexp_matches(code, '^\\d{6}[-_]\\d{2,4}$') AS family, regexp_matches(upper(code), '\\d{3,}[A-Z]+-\\d{2}') AS digit_led FROM f",
)
def is_prefix_family(t: Tables):
    return t.sql(X.CODES).select(
        "p_partkey",
        C.is_prefix_family("code", ["red", "HOT", "Blue"], ["[^.]+\\.\\d{2}\\.\\d{2}\\.\\d{2}"]).alias("family"),
        C.is_digit_led("code").alias("digit_led"),
    )


_KEY = "replace(replace(lower(trim(code)), '_', '-'), ' ', '')"


@query(
    "code_key",
    X.cte(f=X.CODES)
    + f""", k AS (SELECT p_partkey, regexp_extract({_KEY}, '([a-z]+)-?(\\d+)', 1) AS p, regexp_extract({_KEY}, '([a-z]+)-?(\\d+)', 2) AS d FROM f),
      z AS (SELECT *, coalesce(nullif(ltrim(d, '0'), ''), '0') AS b FROM k)
      SELECT p_partkey, CASE WHEN d <> '' THEN p || CASE WHEN length(b) < 3 AND length(d) >= 3 THEN lpad(b, 3, '0') ELSE b END END AS code_key FROM z""",
)
def code_key(t: Tables):
    return t.sql(X.CODES).select("p_partkey", C.code_key("code").alias("code_key"))


_SLUG = "regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '(?i)(/(fr|en|de|es)|/)+$', '')"


@query(
    "code_from_url",
    f"""WITH s AS (SELECT page_id, list_filter(string_split({_SLUG}, '/'), lambda x: x <> '') AS parts FROM pages)
      SELECT page_id, CASE WHEN len(parts) > 0 THEN upper(parts[-1]) END AS code,
        CASE WHEN len(list_filter(parts, lambda x: starts_with(lower(x), 'p'))) > 0 THEN lower(list_filter(parts, lambda x: starts_with(lower(x), 'p'))[1])
          WHEN len(parts) > 0 THEN lower(parts[-1]) END AS external_id FROM s""",
)
def code_from_url(t: Tables):
    langs = ("fr", "en", "de", "es")
    return t("pages").select(
        "page_id", C.code_from_url("url", langs).alias("code"), C.external_id_from_url("url", "p", langs).alias("external_id")
    )


def _part_sql() -> str:
    noise = strip_noise_sql(STEM, "-")
    name = f"trim(replace(replace({noise}, item_code, '-'), '--', '-'))"
    for s in "_ .":
        name = f"replace({name}, '{s}', '-')"
    return f"regexp_replace(lower({name}) || '.', '(vol|case|no)[-.]?\\d+', '', 'g')"


@query(
    "part_number",
    X.cte(f=X.PATHS)
    + f""", {code_ctes('f')}, n AS (SELECT p_partkey, {_part_sql()} AS nm FROM coded),
      e AS (SELECT p_partkey, coalesce(TRY_CAST(regexp_extract(nm, '[-_ .](cd|part|hd)([0-9]{{1,2}})', 2) AS INT), 0) AS a,
        regexp_extract(nm, '-([0-9]{{1,2}})\\.?$', 1) AS b, regexp_extract(nm, '(-|\\d{{2,}}|\\.)([a-o])\\.?$', 2) AS c, regexp_extract(nm, '-([0-9])[^a-z0-9]', 1) AS d FROM n)
      SELECT p_partkey, CASE WHEN a > 0 THEN a WHEN b <> '' THEN CAST(b AS INT) WHEN c <> '' THEN CASE WHEN c = 'c' THEN 0 ELSE ascii(c) - 96 END WHEN d <> '' THEN CAST(d AS INT) ELSE 0 END AS part FROM e""",
)
def part_number(t: Tables):
    return P.part_number(coded(t), C.file_stem("path"), "item_code", TOKENS).select("p_partkey", "part")


EDITIONS = P.EditionWords(uncut=("-uncut",), regional=("brand13/",), cut=("brand1/",))
EDITION_SQL = """CASE WHEN contains(lower(path), '.restored') THEN 'restored'
  WHEN contains(lower(path), 'brand13/') THEN 'regional' WHEN contains(lower(path), 'leaked') THEN 'leaked'
  WHEN contains(lower(path), '-uncut') OR regexp_matches(item_code, '^n\\d{4}') THEN 'uncut' WHEN contains(lower(path), 'brand1/') THEN 'cut' END"""


@query("edition_flags", X.cte(f=X.PATHS) + f", {code_ctes('f')} SELECT p_partkey, {EDITION_SQL} AS edition FROM coded")
def edition_flags(t: Tables):
    uncut = F.col("item_code").rlike("^n\\d{4}")
    return coded(t).select("p_partkey", P.edition_from_path("path", EDITIONS, uncut).alias("edition"))


_BOUND = "regexp_matches(tx, '(^|[^A-Z0-9])({w})([^A-Z0-9]|$)')"
_HEIGHT_CASE = " ".join(f"WHEN {_BOUND.format(w='|'.join(ws))} THEN {h}" for ws, h in P.HEIGHT_WORDS)
_BUCKET_CASE = " ".join(f"WHEN h >= {b[0]} THEN '{{}}'".format(b[1]) for b in P.BUCKETS)
_CLASS_CASE = " ".join(f"WHEN h >= {b[0]} THEN '{{}}'".format(b[2]) for b in P.BUCKETS)


@query(
    "resolution_from_path",
    X.cte(f=X.PATHS)
    + f""", {code_ctes('f')}, s AS (SELECT p_partkey, replace(upper(path), upper(item_code), '-') AS t0, nullif(regexp_extract(upper(item_code), '\\d{{3,}}([A-Z]+-\\d+)', 1), '') AS sc FROM coded),
      x AS (SELECT p_partkey, coalesce(replace(t0, sc, '-'), t0) AS tx FROM s),
      y AS (SELECT p_partkey, CASE {_HEIGHT_CASE} WHEN regexp_matches(regexp_extract(tx, '[^/]*$', 0), '(^|[-_ .\\[])(4K60FPS|4KS)\\.[^.\\\\/]+$') THEN 2000
        WHEN regexp_matches(regexp_extract(tx, '[^/]*$', 0), '(^|[-_ .\\[])UC?-?4K\\.[^.\\\\/]+$') THEN 2000 ELSE 0 END AS h FROM x)
      SELECT p_partkey, h AS height, CASE {_BUCKET_CASE} ELSE '' END AS by_height, CASE {_CLASS_CASE} ELSE '' END AS by_class FROM y""",
)
def resolution_from_path(t: Tables):
    rows = coded(t).select("p_partkey", P.height_from_path("path", "item_code").alias("height"))
    return rows.select(
        "p_partkey", "height", P.resolution_bucket("height").alias("by_height"),
        P.resolution_bucket("height", "class").alias("by_class"),
    )


@query(
    "resolution_bucket",
    f"WITH y AS (SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(floor(l_extendedprice / 20) AS INT) AS h FROM lineitem) SELECT CASE {_BUCKET_CASE} ELSE '' END AS by_height, CASE {_CLASS_CASE} ELSE '' END AS by_class, count(*) AS n FROM y GROUP BY 1, 2",
)
def resolution_bucket(t: Tables):
    h = F.floor(F.col("l_extendedprice") / 20).cast("int")
    rows = t("lineitem").select(P.resolution_bucket(h).alias("by_height"), P.resolution_bucket(h, "class").alias("by_class"))
    return rows.groupBy("by_height", "by_class").agg(F.count(F.lit(1)).alias("n"))


CLASS_RULES = (
    ClassRule("regional", editions=("regional",), code_patterns=("^MK-[A-Z]+-\\d{3,}",)),
    ClassRule("special", source="s9", path_words=("gizmo",), unless_path=("blue gizmo",)),
    ClassRule("scene", code_patterns=("[^.]+\\.\\d{2}\\.\\d{2}\\.\\d{2}",)),
    ClassRule("uncut", editions=("uncut",)),
    ClassRule("amateur", short_code=True, unless_code=("999",)),
    ClassRule("uncut", code_patterns=("^\\d{6}[-_]\\d{2,4}$",)),
)
_TYPE_LIST = "SELECT CASE n_regionkey WHEN 0 THEN 'general' WHEN 1 THEN 'uncut' WHEN 2 THEN 'scene' WHEN 3 THEN 'amateur' ELSE 'regional' END AS item_type, 's' || cast(n_nationkey AS string) AS source, n_nationkey AS rank FROM {nation}"


@query(
    "classify_items",
    X.cte(f=X.PATHS, ty=_TYPE_LIST)
    + f""", {code_ctes('f')}, e AS (SELECT *, {EDITION_SQL} AS edition, nullif(regexp_extract(item_code, '\\d{{3,}}([a-zA-Z]+-\\d+)', 1), '') AS short_code FROM coded),
      k AS (SELECT p_partkey, CASE WHEN coalesce(edition, '') = 'regional' OR regexp_matches(item_code, '^MK-[A-Z]+-\\d{{3,}}') THEN 'regional'
        WHEN contains(lower(path), 'gizmo') AND NOT contains(lower(path), 'blue gizmo') THEN 'special'
        WHEN regexp_matches(item_code, '[^.]+\\.\\d{{2}}\\.\\d{{2}}\\.\\d{{2}}') THEN 'scene' WHEN coalesce(edition, '') = 'uncut' THEN 'uncut'
        WHEN short_code IS NOT NULL AND NOT contains(item_code, '999') THEN 'amateur' WHEN regexp_matches(item_code, '^\\d{{6}}[-_]\\d{{2,4}}$') THEN 'uncut' ELSE 'general' END AS item_type FROM e),
      srcs AS (SELECT item_type, string_agg(source, ',' ORDER BY rank, source) AS al FROM ty GROUP BY 1)
      SELECT p_partkey, item_type, 'auto' AS type_source, CASE WHEN item_type = 'special' THEN 's9' END AS only_source,
        CASE WHEN item_type = 'special' THEN 's9' ELSE al END AS sources FROM k LEFT JOIN srcs USING (item_type)""",
)
def classify(t: Tables):
    uncut = F.col("item_code").rlike("^n\\d{4}")
    rows = coded(t).withColumns(
        {"edition": P.edition_from_path("path", EDITIONS, uncut), "short_code": C.short_code("item_code")}
    )
    out = classify_items(rows, CLASS_RULES, "general", type_sources=t.sql(_TYPE_LIST))
    return out.select("p_partkey", "item_type", "type_source", "only_source", F.array_join("sources", ",").alias("sources"))


@query(
    "output_paths",
    X.cte(f=X.PATHS)
    + """, g AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand || '/' || p_name END AS folder, p_name || '-' || p_partkey AS nm, lower(regexp_extract(path, '(\\.[^.]*)$', 1)) AS ext FROM f),
      h AS (SELECT *, CASE WHEN folder = '' THEN '/out' ELSE '/out/' || folder END AS d FROM g)
      SELECT p_partkey, d AS dir, d || '/' || nm || ext AS file, d || '/' || nm || '.nfo' AS sidecar, d || '/' || CASE WHEN folder = '' THEN nm || '-poster.jpg' ELSE 'poster.jpg' END AS poster,
        d || '/' || CASE WHEN folder = '' THEN nm || '-thumb.jpg' ELSE 'thumb.jpg' END AS thumb, d || '/' || CASE WHEN folder = '' THEN nm || '-fanart.jpg' ELSE 'fanart.jpg' END AS fanart FROM h""",
)
def output_paths(t: Tables):
    folder = F.when(F.col("p_size") % 4 == 0, "").otherwise(F.concat_ws("/", "p_brand", "p_name"))
    name = F.concat_ws("-", "p_name", F.col("p_partkey").cast("string"))
    target = P.output_paths(F.lit("/out"), folder, name, P.extension("path"), simple_assets=True)
    return paths(t).select("p_partkey", target.alias("o")).select("p_partkey", "o.*")
