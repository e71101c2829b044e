"""Incremental jobs: tables with SQL twins, and the streams that keep them current."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogfuse.operators import fusion as U
from catalogfuse.plans.skew import number_rows, runs
from catalogfuse.session import shared_folder
from catalogfuse.streaming import jobs as J
from catalogfuse.workload import fixtures as X
from catalogfuse.workload.fusion import _RAW_FIELDS, _RAW_PRI
from catalogfuse.workload.registry import ORACLE, Tables, query

_THROTTLED = "SELECT 'src' || cast(user_id % 5 AS string) AS source, ts, event_id FROM {events} WHERE event_type = 'error'"
_GAP = 900
_BURSTS = f"""g AS (SELECT source, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL {_GAP} SECOND OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS st FROM f WINDOW w AS (PARTITION BY source ORDER BY ts)),
  r AS (SELECT source, ts, sum(st) OVER (PARTITION BY source ORDER BY ts) AS run FROM g)"""


@query(
    "error_bursts",
    X.cte(f=_THROTTLED) + f", {_BURSTS} SELECT source, run, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS last, count(*) AS errors, least(run, 6) AS level FROM r GROUP BY source, run",
)
def error_bursts(t: Tables):
    """Bursts numbered by a scan of run summaries."""
    found = runs(t.sql(_THROTTLED), ["source"], "ts", _GAP)
    return found.select(
        "source", "run", F.col("first").alias("start"), "last", F.col("rows").alias("errors"), F.least("run", F.lit(6)).alias("level")
    )


_GAPS = "SELECT source, event_id, sum(st) OVER (PARTITION BY source ORDER BY ts) AS run FROM (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 900 SECOND OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS st FROM f WINDOW w AS (PARTITION BY source ORDER BY ts))"


@query("burst_of_each_error", X.cte(f=_THROTTLED) + _GAPS)
def burst_of_each_error(t: Tables):
    return number_rows(t.sql(_THROTTLED), ["source"], "ts", _GAP).select("source", "event_id", "run")


@query(
    "session_bursts",
    X.cte(f=_THROTTLED)
    + f""", g AS (SELECT source, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL {_GAP} SECOND OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS st FROM f WINDOW w AS (PARTITION BY source ORDER BY ts)),
      r AS (SELECT source, ts, sum(st) OVER (PARTITION BY source ORDER BY ts) AS run FROM g)
      SELECT source, epoch_us(min(ts)) AS start, count(*) AS errors, least(run, 6) AS level FROM r GROUP BY source, run""",
)
def session_bursts(t: Tables):
    """The same as sessions (a gap of exactly the width starts a new burst)."""
    bursts = J.error_bursts(t.sql(_THROTTLED), f"{_GAP} seconds")
    out = J.burst_levels(bursts)
    return out.select("source", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "errors", F.col("level").cast("bigint").alias("level"))


_COUNTS = "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, status, count(*) AS n FROM f GROUP BY 1, 2"


@query("windowed_counts", X.cte(f=X.FETCHES) + _COUNTS)
def windowed_counts(t: Tables):
    out = J.windowed_counts(t.sql(X.FETCHES))
    return out.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "status", "n")


_REQUESTS = """
SELECT 'C' || cast(o_custkey AS string) AS item_code, 'o' || cast(o_orderkey AS string) AS path, CASE WHEN o_orderkey % 4 = 3 THEN 'result' ELSE 'request' END AS kind, o_orderstatus <> 'F' AS ok, o_orderkey AS seq FROM {orders}
"""


@query(
    "first_result",
    X.cte(f=_REQUESTS)
    + """, o AS (SELECT item_code, arg_min(path, seq) FILTER (kind = 'request') AS owner, arg_min(ok, seq) FILTER (kind = 'result') AS ok FROM f GROUP BY 1)
      SELECT f.item_code, f.path, f.seq, CASE WHEN f.path = o.owner THEN 'resolve' WHEN o.ok THEN 'reused' WHEN NOT o.ok THEN 'rejected' ELSE 'wait' END AS outcome FROM f JOIN o USING (item_code) WHERE kind = 'request'""",
)
def first_result(t: Tables):
    return J.batch_first_result(t.sql(_REQUESTS))


# Streams ------------------------------------------------------------------------------------------


def _folder(t: Tables) -> str:
    """A new folder in the cluster's shared place."""
    return f"{shared_folder(t.spark).rstrip('/')}/{uuid.uuid4().hex}"


def _stream(t: Tables, name: str) -> DataFrame:
    schema = t(name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


def _run(t: Tables, df: DataFrame) -> DataFrame:
    """Run an append-mode stream over what is there and read its sink back."""
    base = _folder(t)
    q = (
        df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return t.spark.read.schema(df.schema).parquet(f"{base}/out")


def _events(t: Tables) -> DataFrame:
    rows = _stream(t, "events")
    return rows.select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("source"),
        F.col("event_type").alias("status"),
    )


@query(
    "stream_windowed_counts",
    X.cte(f=X.FETCHES) + f", c AS ({_COUNTS}) SELECT * FROM c WHERE start + 3600000000 <= (SELECT epoch_us(max(ts)) - 600000000 FROM f)",
)
def stream_windowed_counts(t: Tables):
    """Counters of every window the watermark has passed."""
    out = _run(t, J.windowed_counts(_events(t)))
    return out.select(F.unix_micros("start").alias("start"), "status", "n")


_CLOSED = ORACLE["session_bursts"].replace("SELECT source, epoch_us(min(ts)) AS start, count(*) AS errors, least(run, 6) AS level", "SELECT source, epoch_us(min(ts)) AS start, count(*) AS errors")


@query("stream_error_bursts", _CLOSED + f" HAVING epoch_us(max(ts)) + {_GAP}000000 <= (SELECT epoch_us(max(ts)) - 600000000 FROM f)")
def stream_error_bursts(t: Tables):
    rows = _events(t).where("status = 'error'")
    out = _run(t, J.error_bursts(rows, f"{_GAP} seconds"))
    return out.select("source", F.unix_micros("start").alias("start"), "errors")


_LISTED = "SELECT '/lib/' || cast(l_partkey AS string) || CASE WHEN l_suppkey % 3 = 0 THEN '.txt' ELSE '.mp4' END AS path FROM {lineitem}"


@query("stream_inventory", X.cte(f=_LISTED) + "SELECT DISTINCT path, regexp_extract(path, '[^/]*$') AS name FROM f WHERE ends_with(path, '.mp4')")
def stream_inventory(t: Tables):
    ext = F.when(F.col("l_suppkey") % 3 == 0, ".txt").otherwise(".mp4")
    raw = _stream(t, "lineitem").select(
        F.concat(F.lit("/lib/"), F.col("l_partkey").cast("string"), ext).alias("path"), F.lit(1).cast("bigint").alias("size"),
        F.col("l_shipdate").cast("timestamp").alias("mtime"),
    )
    base = _folder(t)
    J.only_new_paths(J.dedupe_inventory(raw, (".mp4",)), f"{base}/ledger", f"{base}/checkpoint").awaitTermination()
    return J.new_paths(t.spark, f"{base}/ledger").select("path", "name")


@query("stream_fuse", ORACLE["fuse_repeated_observations"])
def stream_fuse(t: Tables):
    """Observations arrive as a stream; the item table is kept current."""
    base = _folder(t)
    obs = t.spark.sql(X.RAW_OBSERVATIONS, lineitem=_stream(t, "lineitem"))
    pri = t.sql(_RAW_PRI)
    sources = sorted(r.source for r in pri.select("source").distinct().collect())
    fuse = lambda rows: U.fuse_fields(rows, pri, _RAW_FIELDS)
    J.stream_fuse(obs, fuse, sources, ["seq", "title"], f"{base}/items", f"{base}/checkpoint").awaitTermination()
    return J.current_items(t.spark, f"{base}/items").select("item_code", "title", "maker", "release")
