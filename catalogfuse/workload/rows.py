"""Sorts, limits and set operations."""

from pyspark.sql import functions as F

from catalogfuse.operators import rows as R
from catalogfuse.workload import fixtures as X
from catalogfuse.workload.registry import Tables, query


@query("sort_paths", X.cte(f=X.PATHS) + "SELECT p_partkey, path FROM f ORDER BY path")
def sort_paths(t: Tables):
    return R.sort_paths(t.sql(X.PATHS).select("p_partkey", "path"))


@query("sort_report", "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, 'C' || o_orderkey AS item_code FROM orders ORDER BY 1 DESC, 2 DESC")
def sort_report(t: Tables):
    date = F.col("o_orderdate").cast("date").cast("string")
    return R.sort_report(t("orders").select(date.alias("date"), F.concat(F.lit("C"), "o_orderkey").alias("item_code")), "date", "item_code")


@query(
    "sort_by_length",
    "WITH u AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents) SELECT doc_id, md5(string_agg(w, '|' ORDER BY length(w), i)) AS up, md5(string_agg(w, '|' ORDER BY -length(w), i)) AS down FROM u GROUP BY 1",
)
def sort_by_length(t: Tables):
    words = F.split("text", " ")
    return t("documents").select(
        "doc_id", F.md5(F.array_join(R.sort_by_length(words), "|")).alias("up"),
        F.md5(F.array_join(R.sort_by_length(words, True), "|")).alias("down"),
    )


_EACH = "SELECT 'P' || cast(l_partkey AS string) AS item_code, l_orderkey, l_linenumber, l_suppkey, l_extendedprice AS price FROM {lineitem}"


@query(
    "top_per_group",
    X.cte(f=_EACH)
    + "SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY item_code ORDER BY price DESC, l_orderkey, l_linenumber, l_suppkey) <= 6",
)
def top_per_group(t: Tables):
    return R.top_n(t.sql(_EACH), 6, [F.col("price").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")], ["item_code"])


@query("top_overall", X.cte(f=_EACH) + "SELECT * FROM f ORDER BY price DESC, l_orderkey, l_linenumber, l_suppkey LIMIT 8")
def top_overall(t: Tables):
    return R.top_n(t.sql(_EACH), 8, [F.col("price").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")])


@query("first_wins_dedupe", "SELECT lower(p_name) AS k, arg_min(p_partkey, p_partkey) AS p_partkey, arg_min(p_brand, p_partkey) AS p_brand FROM part GROUP BY 1")
def first_wins_dedupe(t: Tables):
    rows = t("part").select(F.lower("p_name").alias("k"), "p_partkey", "p_brand")
    return R.first_wins_dedupe(rows, ["k"], ["p_partkey"])


@query("union_distinct", "SELECT l_partkey AS k, l_returnflag AS f FROM lineitem UNION SELECT p_partkey, 'A' FROM part")
def union_distinct(t: Tables):
    a = t("lineitem").select(F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("f"))
    return R.union_distinct(a, t("part").select(F.col("p_partkey").alias("k"), F.lit("A").alias("f")))


@query("intersect_sources", "SELECT s_name AS source, s_acctbal AS rank FROM supplier WHERE s_suppkey IN (SELECT l_orderkey % 4 * 7 + l_linenumber FROM lineitem)")
def intersect_sources(t: Tables):
    fields = t("supplier").select(F.col("s_suppkey").alias("source"), "s_name", F.col("s_acctbal").alias("rank"))
    kinds = t("lineitem").select((F.col("l_orderkey") % 4 * 7 + F.col("l_linenumber")).alias("source"))
    return R.intersect_sources(fields, kinds).select(F.col("s_name").alias("source"), "rank")


@query("except_codes", "SELECT c_custkey AS item_code, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def except_codes(t: Tables):
    local = t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("item_code"))
    return R.except_codes(t("customer").select(F.col("c_custkey").alias("item_code"), "c_name"), local)
