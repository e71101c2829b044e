"""Text, date, number and list queries."""

import uuid

from pyspark.sql import functions as F

from catalogfuse.functions import text as T
from catalogfuse.functions import values as V
from catalogfuse.functions.basics import text_list
from catalogfuse.operators import filters as L
from catalogfuse.operators.tags import drop_quality_tags, resolution_tags
from catalogfuse.session import shared_folder
from catalogfuse.sources.ledger import scan_lines, write_lines
from catalogfuse.workload import fixtures as X
from catalogfuse.workload.registry import Tables, query


def chain(expr: str, pairs) -> str:
    for old, new in pairs:
        expr = f"replace({expr}, '{old.replace(chr(39), chr(39) * 2)}', '{new.replace(chr(39), chr(39) * 2)}')"
    return expr


@query("clean_text", f"SELECT page_id, {chain('html', T.TEXT_REPLACEMENTS)} AS html FROM pages")
def clean_text(t: Tables):
    return t("pages").select("page_id", T.clean_text("html").alias("html"))


@query(
    "strip_html",
    "SELECT page_id, regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace("
    + chain("trim(html)", T.HTML_ENTITIES)
    + ", '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</p\\s*>', chr(10), 'g'), '<[^>]+>', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS txt FROM pages",
)
def strip_html(t: Tables):
    return t("pages").select("page_id", T.strip_html("html").alias("txt"))


_WIDE = "'ＡＢＣａｂｃ０１２！・　'"
_NARROW = "'ABCabc012!· '"


@query(
    "fold_width",
    f"SELECT doc_id, upper(regexp_replace(translate(replace(replace(text, 'ß', 'ss'), 'the', 'ＡＢＣ'), {_WIDE}, {_NARROW}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]', '', 'g')) AS k FROM documents",
)
def fold_width(t: Tables):
    wide = F.replace("text", F.lit("the"), F.lit("ＡＢＣ"))
    return t("documents").select("doc_id", T.fold_width(wide).alias("k"))


# The documents' letters are composed, so NFKC is NFC there; ligatures and full-width forms are put in to be taken apart.
@query(
    "nfkc_key",
    "SELECT doc_id, replace(lower(nfc_normalize(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))), 'ß', 'ss') || 'fi a1' AS k FROM documents",
)
def nfkc_key(t: Tables):
    return t("documents").select("doc_id", T.nfkc_key(F.concat(F.lit(" "), F.regexp_replace("text", "^\\s+|\\s+$", ""), F.lit("ﬁ\u3000Ａ１ "))).alias("k"))


@query("convert_script", "SELECT doc_id, translate(text, 'éèêç', 'eeec') AS text FROM documents")
def convert_script(t: Tables):
    return t("documents").select("doc_id", T.convert_script("text", "éèêç", "eeec").alias("text"))


@query(
    "replace_words",
    "SELECT doc_id, CASE WHEN lang = 'de' THEN replace(replace(replace(text, 'the', 'THE'), 'THEre', 'there'), 'der', 'DER') ELSE replace(replace(text, 'the', 'THE'), 'THEre', 'there') END AS text FROM documents",
)
def replace_words(t: Tables):
    words = [("the", "THE"), ("THEre", "there")]
    return t("documents").select("doc_id", T.replace_words("text", words, "lang", "de", [("der", "DER")]).alias("text"))


@query(
    "strip_title_parts",
    "SELECT p_partkey, trim(trim(replace(trim(trim(replace(CASE WHEN p_partkey % 2 = 0 THEN p_name || ' : part one' ELSE p_name || ' (last part)' END, 'part one', ''), ':， ')), '(last part)', ''), ':， ')) AS title FROM part",
)
def strip_title_parts(t: Tables):
    title = F.expr("CASE WHEN p_partkey % 2 = 0 THEN p_name || ' : part one' ELSE p_name || ' (last part)' END")
    return t("part").select("p_partkey", T.strip_title_parts(title, ["part one", "(last part)"]).alias("title"))


_TITLED = """
SELECT p_partkey, p_name, p_brand, p_name || CASE p_partkey % 5 WHEN 0 THEN ' DVD' WHEN 1 THEN ' [blu-ray] / dvd' WHEN 2 THEN ' - ' || p_brand ELSE '' END AS base,
  CASE WHEN p_partkey % 3 = 0 THEN '【set】' ELSE '' END AS head
FROM {part}
"""
_MEDIA = ("dvd", "blu-ray", "Brand#1", "Brand#12", "plate")
_SEPS = "[\\s\\-—｜|/／・,，、：:()（）\\[\\]［］]"


@query(
    "clean_match_title",
    X.cte(f=_TITLED)
    + f""", g AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(head || base, '【.*?】', '', 'g'), '\\s+', ' ', 'g')) AS b FROM f),
      h AS (SELECT p_partkey, b, trim(regexp_replace(regexp_replace(b, '(?i)(?:{_SEPS}*(?:Brand#12|Brand#1|blu-ray|plate|dvd){_SEPS}*)+$', '', 'g'), '^{_SEPS}+|{_SEPS}+$', '', 'g')) AS c FROM g)
      SELECT p_partkey, CASE WHEN c = '' THEN b ELSE c END AS title FROM h""",
)
def clean_match_title(t: Tables):
    return t.sql(_TITLED).select("p_partkey", T.clean_match_title(F.concat("head", "base"), _MEDIA).alias("title"))


_EN = """CASE WHEN length(tx) = 0 OR regexp_matches(tx, '[\\x{3040}-\\x{30FF}]') OR letters = 0 THEN false WHEN cjk > 0 AND letters / (letters + cjk) < 0.85 THEN false
  ELSE (CASE WHEN letters / (letters + cjk) >= 0.6 THEN 1 ELSE 0 END + CASE WHEN words / tokens >= 0.5 THEN 1 ELSE 0 END
    + CASE WHEN letters >= 20 OR words >= 5 THEN 1 ELSE 0 END + CASE WHEN length(tx) <= 80 AND letters >= 3 AND words >= 1 THEN 1 ELSE 0 END) >= 2 END"""
_CJK = "\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}"
_LINES_SQL = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents"


@query(
    "detect_language",
    f"""WITH l AS ({_LINES_SQL}), m AS (SELECT doc_id, CASE length(line) % 9 WHEN 0 THEN line || ' カタ' WHEN 1 THEN '漢字漢字漢字漢字漢字' || left(line, 12) ELSE line END AS line FROM l),
      a AS (SELECT doc_id, line, trim(line, ' ') AS tx FROM m),
      b AS (SELECT *, len(regexp_extract_all(tx, '[A-Za-z]')) AS letters, len(regexp_extract_all(tx, '[{_CJK}]')) AS cjk,
        len(regexp_extract_all(tx, '[A-Za-z]+(?:''[A-Za-z]+)?')) AS words, len(regexp_extract_all(tx, '[A-Za-z]+(?:''[A-Za-z]+)?|[{_CJK}]')) AS tokens FROM a),
      c AS (SELECT doc_id, line, regexp_matches(line, '[\\x{{3040}}-\\x{{30FF}}]') AS kana, {_EN} AS en FROM b)
      SELECT doc_id, CASE WHEN kana THEN 'ja' WHEN en THEN 'en' ELSE 'other' END AS language, count(*) AS n,
        count_if((kana OR en) AND NOT (NOT kana AND en)) AS to_translate FROM c GROUP BY 1, 2""",
)
def detect_language(t: Tables):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    n = F.length("line") % 9
    line = F.when(n == 0, F.concat("line", F.lit(" カタ"))).when(
        n == 1, F.concat(F.lit("漢字漢字漢字漢字漢字"), F.substring("line", 1, 12))
    ).otherwise(F.col("line"))
    rows = lines.select("doc_id", line.alias("line"))
    rows = rows.select("doc_id", T.detect_language("line").alias("language"))
    todo = F.count_if(~F.col("language").isin("other", "en"))
    return rows.groupBy("doc_id", "language").agg(F.count(F.lit(1)).alias("n"), todo.alias("to_translate"))


_DATES = """
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'on ' || replace(cast(cast(o_orderdate AS date) AS string), '-', '/') WHEN 1 THEN replace(cast(cast(o_orderdate AS date) AS string), '-0', '.')
  WHEN 2 THEN '2021-02-30' WHEN 3 THEN '0000-00-00' WHEN 4 THEN '' ELSE cast(cast(o_orderdate AS date) AS string) END AS release,
  CASE o_orderkey % 5 WHEN 0 THEN '0000' WHEN 1 THEN '' WHEN 2 THEN 'year 1999' ELSE 'unknown' END AS year
FROM {orders}
"""
_ISO = "CAST(CAST(try_strptime(regexp_extract(replace(replace(release, '/', '-'), '.', '-'), '\\d{4}-\\d{1,2}-\\d{1,2}'), '%Y-%m-%d') AS DATE) AS VARCHAR)"


@query(
    "normalize_release",
    X.cte(f=_DATES)
    + f"SELECT o_orderkey, {_ISO} AS release, coalesce(nullif(nullif(regexp_extract(year, '\\d{{4}}'), ''), '0000'), left({_ISO}, 4)) AS year FROM f",
)
def normalize_release(t: Tables):
    return t.sql(_DATES).select(
        "o_orderkey", V.normalize_release("release").alias("release"), V.normalize_year("year", "release").alias("year")
    )


_RUNTIMES = """
SELECT l_orderkey, l_linenumber, l_extendedprice, CASE l_orderkey % 6 WHEN 0 THEN '0' WHEN 1 THEN '00.0' WHEN 2 THEN cast(cast(l_quantity AS int) AS string) || ' min' WHEN 3 THEN cast(cast(l_quantity AS int) * 30 + 300 AS string)
  WHEN 4 THEN 'unknown' ELSE cast(cast(l_quantity AS int) * 15 AS string) END AS runtime
FROM {lineitem}
"""


@query(
    "normalize_runtime",
    X.cte(f=_RUNTIMES)
    + """, d AS (SELECT *, regexp_extract(runtime, '\\d+') AS dg FROM f),
      r AS (SELECT CASE WHEN regexp_full_match(trim(runtime), '0+(\\.0+)?') THEN NULL WHEN dg = '' THEN runtime
        WHEN CAST(dg AS BIGINT) >= 300 THEN CAST(CAST(greatest(1, round_even(CAST(dg AS BIGINT) / 60, 0)) AS BIGINT) AS VARCHAR) ELSE CAST(CAST(dg AS BIGINT) AS VARCHAR) END AS runtime FROM d WHERE dg <> '' OR true)
      SELECT runtime, count(*) AS n FROM r GROUP BY 1""",
)
def normalize_runtime(t: Tables):
    rows = t.sql(_RUNTIMES).select(V.normalize_runtime("runtime").alias("runtime"))
    return rows.groupBy("runtime").agg(F.count(F.lit(1)).alias("n"))


_SCORES = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN '' ELSE cast(p_size % 10 AS string) || '.' || cast(p_partkey % 10 AS string) || '25' END AS score FROM {part}"


@query(
    "normalize_score",
    X.cte(f=_SCORES)
    + "SELECT p_partkey, CASE WHEN TRY_CAST(score AS DOUBLE) IS NOT NULL THEN printf('%.1f', TRY_CAST(score AS DOUBLE)) END AS score, CAST(floor(TRY_CAST(score AS DOUBLE) * 10) AS BIGINT) AS critic FROM f",
)
def normalize_score(t: Tables):
    return t.sql(_SCORES).select(
        "p_partkey", V.normalize_score("score").alias("score"), V.critic_score("score").cast("bigint").alias("critic")
    )


@query(
    "format_release",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y') || '.' || strftime(o_orderdate, '%m') || strftime(o_orderdate, '%d') || ' (' || strftime(o_orderdate, '%y') || ')' AS shown, '00/00/0000' AS blank FROM orders",
)
def format_release(t: Tables):
    iso = F.col("o_orderdate").cast("date").cast("string")
    return t("orders").select(
        "o_orderkey", V.format_release(iso, "YYYY.MMDD (YY)").alias("shown"), V.format_release(F.lit(""), "MM/DD/YYYY").alias("blank")
    )


_EDITIONS = "SELECT p_partkey, p_name, CASE p_partkey % 8 WHEN 0 THEN 'uncensored' WHEN 1 THEN 'full cut' WHEN 2 THEN 'fan restored copy' WHEN 3 THEN 'leaked' WHEN 4 THEN 'uncensored leaked' WHEN 5 THEN ' Animation ' WHEN 6 THEN '' ELSE 'other' END AS edition, p_partkey % 11 = 0 AS f_leak, p_partkey % 13 = 0 AS f_rest, p_partkey % 17 = 0 AS f_uncut, p_partkey % 19 = 0 AS f_cut FROM {part}"
_LABELS = {"leaked": "uncut-leak", "restored": "uncut-restored", "uncut": "uncut", "cut": "cut"}


@query(
    "normalize_edition",
    X.cte(f=_EDITIONS)
    + """, e AS (SELECT *, CASE trim(edition) WHEN '' THEN NULL WHEN 'uncensored' THEN 'uncut' WHEN 'full cut' THEN 'cut' WHEN 'Animation' THEN 'anime' ELSE
        CASE WHEN contains(edition, 'restored') THEN 'uncut-restored' WHEN contains(edition, 'leak') THEN CASE WHEN contains(edition, 'uncensored') THEN 'uncut-leak' ELSE 'leak' END ELSE trim(edition) END END AS ed FROM f)
      SELECT p_partkey, ed AS edition, CASE WHEN f_leak THEN 'uncut-leak' WHEN f_rest THEN 'uncut-restored' WHEN f_uncut THEN 'uncut' WHEN f_cut THEN 'cut' WHEN ed IS NOT NULL THEN ed WHEN starts_with(p_name, 'red') THEN 'uncut' ELSE 'cut' END AS merged FROM e""",
)
def normalize_edition(t: Tables):
    rows = t.sql(_EDITIONS).withColumn(
        "ed",
        V.normalize_edition(
            "edition", {"uncensored": "uncut", "full cut": "cut", "Animation": "anime"}, ["restored"], "uncut-restored",
            ["leak"], "leak", ["uncensored"], "uncut-leak",
        ),
    )
    merged = V.merge_edition(
        F.col("f_leak"), F.col("f_rest"), F.col("f_uncut"), F.col("f_cut"), F.col("ed"), F.col("p_name").startswith("red"), _LABELS
    )
    return rows.select("p_partkey", F.col("ed").alias("edition"), merged.alias("merged"))


_COMMA = "SELECT doc_id, replace(replace(text, ' ', ', '), chr(10), ',,') AS words FROM {documents}"


@query(
    "clean_list",
    X.cte(f=_COMMA)
    + """, u AS (SELECT doc_id, unnest(string_split(words, ',')) AS w0, generate_subscripts(string_split(words, ','), 1) AS i FROM f),
      d AS (SELECT doc_id, trim(w0) AS w, min(i) AS i FROM u WHERE trim(w0) <> '' GROUP BY 1, 2)
      SELECT doc_id, string_agg(w, ',' ORDER BY i) AS words FROM d GROUP BY 1""",
)
def clean_list(t: Tables):
    return t.sql(_COMMA).select("doc_id", V.clean_list("words").alias("words"))


@query(
    "derive_country",
    X.cte(f=X.CODES)
    + "SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'CN' WHEN 'Brand#2' THEN 'DE' ELSE CASE WHEN regexp_matches(code, '\\.\\d{2}\\.\\d{2}\\.\\d{2}') THEN 'US' ELSE 'JP' END END AS country FROM f",
)
def derive_country(t: Tables):
    c = V.derive_country("p_brand", "code", {"Brand#1": "CN", "Brand#2": "DE"}, "\\.\\d{2}\\.\\d{2}\\.\\d{2}", "US", "JP")
    return t.sql(X.CODES).select("p_partkey", c.alias("country"))


_CAST = "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'A,B,C' ELSE 'A,B,C,D,' || cast(o_custkey AS string) END AS people FROM {orders}"


@query(
    "limit_people",
    X.cte(f=_CAST)
    + "SELECT o_orderkey, CASE WHEN len(string_split(people, ',')) > 3 THEN array_to_string(string_split(people, ',')[1:3], ',') || ' et al' ELSE people END AS people FROM f",
)
def limit_people(t: Tables):
    return t.sql(_CAST).select("o_orderkey", V.limit_people("people", 3, " et al").alias("people"))


_BARCODES = """
SELECT p_partkey, 'Size ' || cast(p_size AS string) || ' EAN: ' || lpad(cast(4006381000000 + p_partkey * 97 AS string), 13, '0') || ' x; ISBN-13 978-3-16-' || lpad(cast(p_partkey % 1000000 AS string), 6, '0') || '-0 end JAN：49012345' || lpad(cast(p_partkey % 100000 AS string), 5, '0') || CASE WHEN p_partkey % 3 = 0 THEN '77' ELSE '' END || '.' AS txt
FROM {part}
"""
_BC = "(?i)(?:EAN|JAN|ISBN(?:-13)?)\\s*[：:﹕]?\\s*([0-9][0-9\\-\\s]{10,20})"


@query(
    "extract_barcodes",
    X.cte(f=_BARCODES)
    + f""", a AS (SELECT p_partkey, list_filter(list_transform(regexp_extract_all(txt, '{_BC}', 1), lambda x: regexp_replace(x, '\\D', '', 'g')), lambda x: length(x) = 13) AS l FROM f),
      u AS (SELECT DISTINCT p_partkey, unnest(l) AS barcode FROM a)
      SELECT p_partkey, barcode, (10 - (list_sum(list_transform(range(1, 13), lambda i: CAST(substr(barcode, CAST(i AS INT), 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10)) % 10 = CAST(right(barcode, 1) AS INT) AS good FROM u""",
)
def extract_barcodes(t: Tables):
    rows = t.sql(_BARCODES).select("p_partkey", F.explode(V.extract_barcodes("txt")).alias("barcode"))
    return rows.withColumn("good", V.is_valid_ean13("barcode"))


_OUTLINES = """
SELECT conv_id, turn, text AS outline, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN '' ELSE 'first<br/>second' || cast(conv_id AS string) END AS original, CASE conv_id % 2 WHEN 0 THEN 'Engine' ELSE '' END AS by_whom
FROM {conversations}
"""


@query(
    "merge_outlines",
    X.cte(f=_OUTLINES)
    + """, g AS (SELECT conv_id, turn, by_whom, regexp_replace(replace(replace(replace(replace(replace(outline, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\r\\n', chr(10)), '\\n', chr(10)), '\\r', chr(10)), '(?i)<\\s*br\\s*/?\\s*>', chr(10), 'g') AS a,
        regexp_replace(replace(replace(original, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?i)<\\s*br\\s*/?\\s*>', chr(10), 'g') AS b FROM f)
      SELECT conv_id, turn, CASE WHEN b <> '' AND b <> a THEN a || chr(10) || chr(10) || b || CASE WHEN by_whom <> '' THEN chr(10) || chr(10) || 'translated by ' || by_whom ELSE '' END ELSE a END AS shown,
        CASE WHEN b <> '' AND b <> a THEN b || chr(10) || chr(10) || a ELSE a END AS swapped FROM g""",
)
def merge_outlines(t: Tables):
    return t.sql(_OUTLINES).select(
        "conv_id", "turn", T.merge_outlines("outline", "original", "outline_first", "by_whom").alias("shown"),
        T.merge_outlines("outline", "original", "original_first").alias("swapped"),
    )


@query(
    "strip_title_affixes",
    """WITH f AS (SELECT o_orderkey, 'C-' || o_custkey AS code, CASE WHEN o_orderkey % 3 = 0 THEN 'C-' || o_custkey || ' ' ELSE '' END || o_orderpriority || '/' || o_orderstatus || CASE o_orderkey % 4 WHEN 0 THEN ' Ann' WHEN 1 THEN ' Ann Bob' WHEN 2 THEN ' Bob Ann' ELSE '' END AS title FROM orders),
      g AS (SELECT o_orderkey, code, trim(regexp_replace(regexp_replace(title, ' Bob$', ''), ' Ann$', '')) AS t1 FROM f)
      SELECT o_orderkey, trim(replace(CASE WHEN code <> t1 AND starts_with(t1, code) THEN trim(replace(t1, code, '')) ELSE t1 END, '/', '#'), ' -') AS title FROM g""",
)
def strip_title_affixes(t: Tables):
    code = F.concat(F.lit("C-"), F.col("o_custkey"))
    tail = F.expr("CASE o_orderkey % 4 WHEN 0 THEN ' Ann' WHEN 1 THEN ' Ann Bob' WHEN 2 THEN ' Bob Ann' ELSE '' END")
    head = F.when(F.col("o_orderkey") % 3 == 0, F.concat(code, F.lit(" "))).otherwise("")
    title = F.concat(head, "o_orderpriority", F.lit("/"), "o_orderstatus", tail)
    names = F.array(F.lit("Bob"), F.lit("Ann"))
    return t("orders").select("o_orderkey", T.strip_title_affixes(title, code, names).alias("title"))


_MARKS = ("the of", "and", "on the")


@query(
    "drop_generic_text",
    "WITH k AS (SELECT doc_id, text, lower(regexp_replace(text, '\\s+', '', 'g')) AS k FROM documents) SELECT doc_id, CASE WHEN k <> '' AND CAST(contains(k, 'theof') AS INT) + CAST(contains(k, 'and') AS INT) + CAST(contains(k, 'onthe') AS INT) < 2 THEN text END AS text FROM k",
)
def drop_generic_text(t: Tables):
    return t("documents").select("doc_id", T.drop_generic_text("text", _MARKS).alias("text"))


_SPEC = L.LineFilter(glob="*[aeiou]n*.", regex="(on|en)", contains=("e",), contains_any_case=("THE",), min_length=10, max_length=400, drop_empty=True)
_LINE_COND = "regexp_full_match(tx, '(?s).*[aeiou]n.*\\.') AND regexp_matches(tx, '(on|en)') AND contains(tx, 'e') AND contains(lower(tx), 'the') AND length(tx) BETWEEN 10 AND 400 AND tx <> ''"


@query(
    "filter_lines",
    f"WITH l AS ({_LINES_SQL}), a AS (SELECT doc_id, line, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS tx FROM l) SELECT doc_id, line FROM a WHERE {_LINE_COND}",
)
def filter_lines(t: Tables):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return L.filter_lines(lines, _SPEC)


@query(
    "scan_filter_write_lines",
    f"WITH l AS ({_LINES_SQL}), a AS (SELECT line, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS tx FROM l) SELECT line, count(*) AS n FROM a WHERE {_LINE_COND} GROUP BY line",
)
def scan_filter_write_lines(t: Tables):
    """Text files to text files: the documents as files of lines, read back, filtered and written again."""
    folder = f"{shared_folder(t.spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    write_lines(t("documents").select(F.explode(F.split("text", "\n")).alias("line")), f"{folder}/in")
    write_lines(L.filter_lines(scan_lines(t.spark, f"{folder}/in"), _SPEC), f"{folder}/out")
    return scan_lines(t.spark, f"{folder}/out").groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query(
    "line_stats",
    f"WITH l AS ({_LINES_SQL}), a AS (SELECT doc_id, line, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS tx FROM l) SELECT count(*) AS total, count_if({_LINE_COND}) AS matched FROM a",
)
def line_stats(t: Tables):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return L.line_stats(lines, _SPEC)


_TAGS = "SELECT p_partkey, p_name || ',HD,' || p_type || ',1080p,' || cast(p_size AS string) || 'k,4K' || CASE WHEN p_partkey % 2 = 0 THEN ',HD' ELSE '' END AS tags, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '720P' END AS def FROM {part}"


@query(
    "resolution_tags",
    X.cte(f=_TAGS)
    + """, q AS (SELECT p_partkey, def, regexp_replace(tags, ',\\d+[kKpP],', ',', 'g') AS t1 FROM f), q2 AS (SELECT p_partkey, def, replace(CASE WHEN ends_with(t1, ',HD') THEN replace(t1, ',HD', '') ELSE t1 END, ',HD,', ',') AS t2 FROM q),
      l AS (SELECT p_partkey, def, list_filter(list_transform(string_split(t2, ','), lambda x: """
    + chain("x", [(w, "") for word in ("144P", "360P", "480P", "540P", "720P", "960P", "1080P", "1440P", "2160P", "4K", "8K") for w in (word, word.lower())])
    + "), lambda x: x <> '') AS l FROM q2) SELECT p_partkey, t2 AS tags_in, CASE WHEN l.def <> '' THEN l.def || ',' ELSE '' END || array_to_string(l.l, ',') AS tags FROM l JOIN q2 USING (p_partkey)",
)
def resolution_tag(t: Tables):
    rows = t.sql(_TAGS).withColumn("tags_in", drop_quality_tags("tags", ["HD"]))
    tags = resolution_tags(F.split("tags_in", ","), "def")
    return rows.select("p_partkey", "tags_in", F.array_join(tags, ",").alias("tags"))


@query(
    "text_list",
    "WITH u AS (SELECT event_id, unnest(['a', event_type, ' ' || event_type || ' ', '', 'b']) AS w0, unnest(range(5)) AS i FROM events), d AS (SELECT event_id, trim(w0) AS w, min(i) AS i FROM u WHERE trim(w0) <> '' GROUP BY 1, 2) SELECT event_id, string_agg(w, '|' ORDER BY i) AS ws FROM d GROUP BY 1",
)
def words(t: Tables):
    joined = F.concat(F.lit("a;"), "event_type", F.lit("; "), "event_type", F.lit(" ;;b"))
    return t("events").select("event_id", F.array_join(text_list(joined, ";"), "|").alias("ws"))


_MARKED = "CASE length(text) % 9 WHEN 0 THEN text || ' カタ' WHEN 1 THEN '漢字漢字漢字漢字漢字' || left(text, 12) ELSE text END"


@query(
    "needs_translation",
    f"""WITH m AS (SELECT conv_id, turn, {_MARKED} AS line FROM conversations), a AS (SELECT *, trim(line, ' ') AS tx FROM m),
      b AS (SELECT *, len(regexp_extract_all(tx, '[A-Za-z]')) AS letters, len(regexp_extract_all(tx, '[{_CJK}]')) AS cjk,
        len(regexp_extract_all(tx, '[A-Za-z]+(?:''[A-Za-z]+)?')) AS words, len(regexp_extract_all(tx, '[A-Za-z]+(?:''[A-Za-z]+)?|[{_CJK}]')) AS tokens FROM a),
      c AS (SELECT conv_id, turn, line, regexp_matches(line, '[\\x{{3040}}-\\x{{30FF}}]') AS kana, {_EN} AS en FROM b)
      SELECT conv_id, turn, line IS NOT NULL AND coalesce(kana, false) AS todo_en, line IS NOT NULL AND coalesce(NOT kana AND en, false) AS todo_ja FROM c""",
)
def needs_translation(t: Tables):
    """Every turn, some with kana or ideographs added."""
    kind = F.length("text") % 9
    line = F.when(kind == 0, F.concat("text", F.lit(" カタ"))).when(kind == 1, F.concat(F.lit("漢字漢字漢字漢字漢字"), F.substring("text", 1, 12))).otherwise(F.col("text"))
    rows = t("conversations").select("conv_id", "turn", line.alias("line"))
    return rows.select("conv_id", "turn", T.needs_translation("line", "en").alias("todo_en"), T.needs_translation("line", "ja").alias("todo_ja"))
