"""Report queries."""

from pyspark.sql import functions as F

from catalogfuse.operators import filters as L
from catalogfuse.operators import reports as R
from catalogfuse.workload import fixtures as X
from catalogfuse.workload.registry import Tables, query

_LEDGER = "SELECT 'o' || cast(o_orderkey AS string) AS path, 'C' || cast(o_custkey AS string) AS item_code, CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'failed' END AS status, o_orderpriority AS reason, cast(o_custkey % 1000 AS double) / 8 AS secs FROM {orders}"


@query("run_report", X.cte(f=_LEDGER) + "SELECT count(*) AS total, count_if(status = 'ok') AS success, count_if(status <> 'ok') AS failed, round(avg(secs), 2) AS mean_secs FROM f")
def run_report(t: Tables):
    return R.run_report(t.sql(_LEDGER))


@query("failed_items", X.cte(f=_LEDGER) + "SELECT path, item_code, reason FROM f WHERE status <> 'ok'")
def failed_items(t: Tables):
    return R.failed_items(t.sql(_LEDGER))


@query(
    "completeness_report",
    X.cte(f=X.PEOPLE)
    + "SELECT CASE WHEN grouping(has_image) = 1 THEN 'any' WHEN has_image THEN 'yes' ELSE 'no' END AS image, CASE WHEN grouping(has_text) = 1 THEN 'any' WHEN has_text THEN 'yes' ELSE 'no' END AS text, count(*) AS n FROM f GROUP BY CUBE (has_image, has_text)",
)
def completeness_report(t: Tables):
    return R.completeness_report(t.sql(X.PEOPLE))


@query(
    "list_people",
    X.cte(f=X.PEOPLE)
    + "SELECT mode, name FROM f, (VALUES ('all', NULL, NULL), ('image_and_text', true, true), ('text_only', false, true), ('image_only', true, false), ('neither', false, false), ('has_text', NULL, true), ('no_text', NULL, false), ('has_image', true, NULL), ('no_image', false, NULL)) AS m(mode, i, x) WHERE (i IS NULL OR has_image = i) AND (x IS NULL OR has_text = x)",
)
def list_people(t: Tables):
    people = t.sql(X.PEOPLE)
    frames = [R.list_people(people, m).select(F.lit(m).alias("mode"), "name") for m in R.LIST_MODES]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


_TARGETS = "SELECT '/out/' || cast(o_custkey AS string) || '/' || o_orderstatus AS target, 'in' || cast(o_orderkey AS string) AS path FROM {orders}"


@query(
    "duplicate_targets",
    X.cte(f=_TARGETS)
    + "SELECT target, path, count(*) OVER w AS inputs, path = min(path) OVER w AS is_kept FROM f WINDOW w AS (PARTITION BY target) QUALIFY count(*) OVER w > 1",
)
def duplicate_targets(t: Tables):
    return R.duplicate_targets(t.sql(_TARGETS))


@query(
    "fetch_report",
    X.cte(f=X.FETCHES)
    + """, o AS (SELECT source, list_sort(list(secs)) AS l, count(*) AS n FROM f GROUP BY 1)
      SELECT source, count(*) AS total, count_if(ok) AS success, count_if(NOT ok) AS failed, round(count_if(ok) * 100 / count(*), 2) AS success_pct,
        round(count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1e6, 4) AS per_sec,
        any_value(l[1 + CAST(round_even((n - 1) * 0.5, 0) AS BIGINT)]) AS p50, any_value(l[1 + CAST(round_even((n - 1) * 0.9::DOUBLE, 0) AS BIGINT)]) AS p90, any_value(l[1 + CAST(round_even((n - 1) * 0.99::DOUBLE, 0) AS BIGINT)]) AS p99
      FROM f JOIN o USING (source) GROUP BY 1""",
)
def fetch_report(t: Tables):
    return R.fetch_report(t.sql(X.FETCHES))


@query("top_errors", X.cte(f=X.FETCHES) + "SELECT error, count(*) AS n FROM f WHERE error <> '' GROUP BY 1 ORDER BY n DESC, error LIMIT 5")
def top_errors(t: Tables):
    return R.top_errors(t.sql(X.FETCHES))


@query("status_counts", X.cte(f=X.FETCHES) + "SELECT status, count(*) AS n FROM f GROUP BY 1")
def status_counts(t: Tables):
    return R.status_counts(t.sql(X.FETCHES))


_LISTING = """
SELECT 'person ' || cast(l_suppkey AS string) AS person, 'P' || cast(l_partkey AS string) AS item_code, (l_orderkey * 10 + l_linenumber) * 100000000 + cast(floor(l_extendedprice * 100) AS bigint) AS pos, 'title ' || cast(l_orderkey AS string) AS title, CASE WHEN l_orderkey % 2 = 0 THEN '03-17-2021' ELSE '2020.05.06' END AS date_text, '/v/' || cast(l_partkey AS string) AS url,
  l_quantity > 30 AS has_download, l_quantity > 45 AS has_subtitle
FROM {lineitem}
"""
_SINGLES = "SELECT 'person ' || cast(l_suppkey AS string) AS person, 'P' || cast(l_partkey AS string) AS item_code FROM {lineitem} WHERE l_returnflag = 'A'"


@query(
    "person_catalog",
    X.cte(f=_LISTING, s=_SINGLES)
    + """SELECT person, item_code, title, CASE WHEN date_text = '03-17-2021' THEN '2021/03/17' ELSE '2020/05/06' END AS date, url, CASE WHEN has_subtitle THEN 'subtitle' WHEN has_download THEN 'download' ELSE 'none' END AS availability,
      EXISTS (SELECT 1 FROM s WHERE s.person = f.person AND s.item_code = f.item_code) AS single_work
      FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY person, item_code ORDER BY pos DESC) = 1) f""",
)
def person_catalog(t: Tables):
    return R.person_catalog(t.sql(_LISTING), t.sql(_SINGLES))


_TEXT = "lower(regexp_replace(html, '<[^>]+>', ' ', 'g') || CASE page_id % 4 WHEN 0 THEN ' 404 ' ELSE '' END || CASE page_id % 3 WHEN 0 THEN ' Page Not Found' ELSE '' END)"


@query(
    "flag_missing_pages",
    f"""WITH a AS (SELECT page_id, {_TEXT} AS tx, lower(regexp_extract(html, '<title>([^<]*)', 1)) AS ti, CASE page_id % 5 WHEN 0 THEN 'http://x/logo-square.png' ELSE '' END AS im FROM pages)
      SELECT page_id, regexp_matches(tx, '(^|\\s)404(\\s|$)') AND (contains(tx, 'not found') OR (contains(ti, 'en') AND contains(im, 'logo-square.png'))) AS missing, contains(tx, 'not found') AS gone FROM a""",
)
def flag_missing_pages(t: Tables):
    text = F.lower(
        F.concat(
            F.regexp_replace("html", "<[^>]+>", " "), F.when(F.col("page_id") % 4 == 0, " 404 ").otherwise(""),
            F.when(F.col("page_id") % 3 == 0, " Page Not Found").otherwise(""),
        )
    )
    image = F.when(F.col("page_id") % 5 == 0, "http://x/logo-square.png").otherwise("")
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return t("pages").select(
        "page_id", L.flag_missing_pages(text, title, image, ["not found"], ["en"], "logo-square.png").alias("missing"),
        L.page_gone(text, ["not found"]).alias("gone"),
    )
