"""Inputs derived from the tables, written once in SQL that Spark and DuckDB both read."""

from catalogfuse.workload.registry import in_sql

# File paths of many shapes, one per part.
PATHS = """
SELECT p_partkey, p_brand, p_name, p_size,
  '/lib/' || lower(replace(p_brand, '#', '')) || '/' || CASE WHEN p_size % 10 = 0 THEN 'old/' ELSE '' END
  || CASE p_partkey % 11
       WHEN 0 THEN lpad(cast(p_partkey % 900000 + 100000 AS string), 6, '0') || '-' || lpad(cast(p_size AS string), 3, '0')
       WHEN 1 THEN replace(p_name, ' ', '') || '.' || lpad(cast(p_partkey % 30 + 10 AS string), 2, '0') || '.01.' || lpad(cast(p_partkey % 28 + 1 AS string), 2, '0') || '.scene'
       WHEN 2 THEN upper(substr(p_name, 1, 3)) || '00' || lpad(cast(p_partkey % 1000 AS string), 3, '0')
       WHEN 3 THEN cast(p_size + 200 AS string) || upper(substr(p_name, 1, 3)) || '-' || lpad(cast(p_partkey AS string), 5, '0')
       WHEN 4 THEN 'h_' || cast(p_size + 100 AS string) || substr(p_name, 1, 3) || lpad(cast(p_partkey AS string), 5, '0')
       WHEN 5 THEN '[site.example] ' || upper(substr(p_name, 1, 4)) || ' ' || lpad(cast(p_partkey AS string), 5, '0') || ' (2021-03-04)'
       WHEN 6 THEN 'n' || lpad(cast(p_partkey % 10000 AS string), 4, '0') || '_hd'
       WHEN 7 THEN p_name || ' no code'
       ELSE upper(replace(p_name, ' ', '')) || '-' || lpad(cast(p_partkey AS string), 5, '0')
     END
  || CASE p_partkey % 7 WHEN 1 THEN '-1080P' WHEN 2 THEN '_4K' WHEN 3 THEN '.leaked' WHEN 4 THEN '-uncut' WHEN 5 THEN '-HD-' ELSE '' END
  || CASE p_partkey % 6 WHEN 1 THEN '-CD' || cast(p_partkey % 9 + 1 AS string) WHEN 2 THEN '-C' WHEN 3 THEN '_2' ELSE '' END
  || CASE p_partkey % 13 WHEN 0 THEN '.MKV' WHEN 1 THEN '.txt' ELSE '.mp4' END AS path,
  cast(p_partkey % 4000 AS bigint) * 65536 AS size
FROM {part}
"""

# Plain codes, one per part.
CODES = """
SELECT p_partkey, p_brand, p_type, p_name, p_size, p_retailprice,
  CASE p_partkey % 8
    WHEN 0 THEN '259' || upper(substr(p_name, 1, 3)) || '-' || lpad(cast(p_partkey AS string), 5, '0')
    WHEN 1 THEN upper(substr(p_name, 1, 3)) || '-00' || cast(p_partkey % 90 + 10 AS string)
    WHEN 2 THEN '123456-' || lpad(cast(p_size AS string), 3, '0')
    WHEN 3 THEN 'vendor_123456_' || lpad(cast(p_size AS string), 2, '0')
    WHEN 4 THEN lower(substr(p_name, 1, 4)) || '_' || lpad(cast(p_partkey AS string), 6, '0')
    WHEN 5 THEN replace(p_name, ' ', '') || '.21.02.' || lpad(cast(p_partkey % 28 + 1 AS string), 2, '0')
    WHEN 6 THEN upper(substr(p_name, 1, 2)) || '-' || upper(substr(p_name, 2, 2)) || '-' || lpad(cast(p_partkey AS string), 4, '0')
    ELSE upper(replace(p_name, ' ', '')) || '-' || lpad(cast(p_partkey AS string), 5, '0')
  END AS code
FROM {part}
"""

# Source observations: every line is a record of its part, with holes and invalid values at fixed places.
OBSERVED = """
  SELECT 'P' || lpad(cast(l_partkey AS string), 9, '0') AS item_code,
    CASE WHEN l_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS item_type,
    's' || cast(l_suppkey % 5 AS string) AS source,
    cast(l_orderkey AS string) || '/' || cast(l_linenumber AS string) AS external_id,
    CASE WHEN l_orderkey % 4 = 0 THEN '' ELSE p_name || ' ' || cast(l_suppkey AS string) END AS title,
    CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE p_brand END AS maker,
    CASE WHEN l_orderkey % 11 = 0 THEN '0000-00-00' WHEN l_orderkey % 13 = 0 THEN '2021/02/30'
         ELSE replace(cast(cast(l_shipdate AS date) AS string), '-', CASE WHEN l_orderkey % 3 = 0 THEN '/' ELSE '-' END) END AS release,
    CASE WHEN l_orderkey % 7 = 0 THEN '0' ELSE cast(cast(floor(l_quantity * 17) AS int) AS string) END AS runtime,
    CASE WHEN l_orderkey % 6 = 0 THEN '0.0' ELSE cast(cast(floor(l_extendedprice / 10000) AS int) AS string) END AS score,
    CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE 'http://img.example/' || cast(l_orderkey AS string) || 'pl.jpg' END AS thumb,
    CASE WHEN l_orderkey % 3 = 1 THEN '' ELSE 'http://img.example/' || cast(l_orderkey AS string) || 'ps.jpg' END AS poster,
    CASE WHEN l_returnflag = 'A' THEN '' ELSE l_returnflag END AS edition,
    'Person ' || cast(l_suppkey % 20 AS string) AS person,
    l_orderkey AS o1, l_linenumber AS o2, l_extendedprice AS o3, l_suppkey AS o4
  FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""
OBSERVED_ORDER = ("o1", "o2", "o3", "o4")

# The first record of each (part, source).
OBSERVATIONS = f"""
SELECT item_code, item_type, source, external_id, title, maker, release, runtime, score, thumb, poster, edition, person
FROM (SELECT *, row_number() OVER (PARTITION BY item_code, source ORDER BY {', '.join(OBSERVED_ORDER)}) AS rn FROM ({OBSERVED})) WHERE rn = 1
"""

# Raw observations: every line is a record of its item, so (item, source) repeats.
RAW_OBSERVATIONS = """
SELECT 'P' || lpad(cast(l_partkey AS string), 9, '0') AS item_code,
  's' || cast(l_suppkey % 5 AS string) AS source,
  (l_orderkey * 10 + l_linenumber) * 100000000 + cast(floor(l_extendedprice * 100) AS bigint) AS seq,
  CASE WHEN l_orderkey % 4 = 0 THEN '' ELSE 'title ' || cast(l_suppkey AS string) END AS title,
  CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE 'maker ' || cast(l_orderkey % 9 AS string) END AS maker,
  CASE WHEN l_orderkey % 11 = 0 THEN '0000-00-00' ELSE cast(cast(l_shipdate AS date) AS string) END AS release
FROM {lineitem}
"""

# (item_type, field, source, rank) as rows.
_ORDERS = {
    ("even", "title"): "01234", ("even", "maker"): "32104", ("even", "release"): "4210", ("even", "runtime"): "2413",
    ("even", "score"): "140", ("even", "thumb"): "031", ("even", "poster"): "340",
    ("odd", "title"): "4321", ("odd", "maker"): "013", ("odd", "release"): "10342", ("odd", "runtime"): "034",
    ("odd", "score"): "21", ("odd", "thumb"): "2", ("odd", "poster"): "120",
}
PRIORITY_ROWS = [(t, f, f"s{s}", i) for (t, f), order in _ORDERS.items() for i, s in enumerate(order, 1)]
PRIORITY = "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{f}', '{s}', {r})" for t, f, s, r in PRIORITY_ROWS) + ") AS p(item_type, field, source, rank)"
FIELD_ORDER = ("title", "thumb", "poster", "release", "runtime", "score", "maker")

# Alias rows: a nation's names stand for its region; the first row in document order wins.
ALIASES = """
SELECT n_nationkey AS ord, r_name AS en, lower(r_name) AS local, CASE WHEN n_nationkey % 9 = 0 THEN 'delete' ELSE 'R' || cast(r_regionkey AS string) END AS short,
  lower(n_name) AS kw1, n_name AS kw2, 'nation ' || cast(n_nationkey % 20 AS string) AS kw3
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""

# Lines of text.
LINES = "SELECT doc_id, text, lang, source FROM {documents}"

# People.
PEOPLE = """
SELECT c_custkey, c_name AS name, c_acctbal > 0 AS has_image, c_mktsegment IN ('BUILDING', 'MACHINERY') AS has_text,
  c_nationkey, c_acctbal, c_mktsegment
FROM {customer}
"""

# Fetch log.
FETCHES = """
SELECT event_id, ts, 'src' || cast(user_id % 5 AS string) AS source, event_type <> 'error' AS ok, value AS secs,
  event_type AS status, CASE WHEN event_type = 'error' THEN 'error ' || cast(user_id % 9 AS string) ELSE '' END AS error
FROM {events}
"""

# Asset addresses.
URLS = """
SELECT p_partkey,
  CASE p_partkey % 5 WHEN 0 THEN 'https://pics.store.example' WHEN 1 THEN 'http://cdn.other.example' WHEN 2 THEN '//pics.store.example'
    WHEN 3 THEN 'tv.store.example' ELSE 'https://WWW.Store.Example' END
  || CASE p_partkey % 4 WHEN 0 THEN '/digital//video/' WHEN 1 THEN '/mono/adult/' WHEN 2 THEN '/rental/' ELSE '/x/' END
  || replace(p_name, ' ', '_') || cast(p_partkey AS string)
  || CASE p_partkey % 6 WHEN 0 THEN 'pl.jpg' WHEN 1 THEN 'ps.jpg' WHEN 2 THEN '_mhb_w.mp4' WHEN 3 THEN 'dmb.mp4' WHEN 4 THEN '_4ks_h.mp4' ELSE '/now_printing.png' END
  || CASE p_partkey % 3 WHEN 0 THEN '?w=120&a=1&h=90' WHEN 1 THEN '?' ELSE '' END AS url
FROM {part}
"""


def cte(**named: str) -> str:
    """WITH clause of fixtures for the SQL side."""
    return "WITH " + ", ".join(f"{n} AS ({in_sql(f)})" for n, f in named.items()) + " "
