"""Streams in several batches against the batch results."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from catalogfuse.operators.fusion import fuse_fields, priority_frame
from catalogfuse.schemas import Field
from catalogfuse.streaming import jobs as J

FIELDS = [Field("title"), Field("maker")]
OBSERVED = "item_code string, source string, seq long, title string, maker string"


def _feed(spark, tmp_path, name, batches, schema):
    """One file per batch, in the order they are to arrive."""
    for i, rows in enumerate(batches):
        folder = tmp_path / f"w{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(folder))
        (tmp_path / name).mkdir(exist_ok=True)
        next(folder.glob("part*")).rename(tmp_path / name / f"{i:03}.json")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / name))


def test_fusion_of_a_stream_reads_no_history(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(f"P{rnd.randint(0, 40)}", f"s{rnd.randint(0, 4)}", rnd.randint(0, 10_000), rnd.choice(["", f"t{i}"]), rnd.choice(["", f"m{i}"])) for i in range(600)]
    batches = [rows[:400], rows[400:410], rows[410:420], rows[420:]]
    pri = priority_frame(spark, [("any", f, f"s{s}", r) for f, o in (("title", "0123"), ("maker", "320")) for r, s in enumerate(o, 1)]).drop("item_type")
    fuse = lambda obs: fuse_fields(obs, pri, FIELDS)
    obs = _feed(spark, tmp_path, "in", batches, OBSERVED)
    where = (str(tmp_path / "items"), str(tmp_path / "checkpoint"))
    query = J.stream_fuse(obs, fuse, ["s0", "s1", "s2", "s3"], ["seq"], *where)
    query.awaitTermination()
    touched = [len({r[0] for r in b if r[1] != "s4"}) for b in batches]
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]]
    assert updated == touched and touched[1] <= 10
    written = spark.read.parquet(f"{where[0]}/changes").groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in written] == touched
    want = sorted(fuse_fields(spark.createDataFrame(rows, OBSERVED), pri, FIELDS, order=["seq"]).select("item_code", "title", "maker").collect())
    got = lambda: sorted(J.current_items(spark, where[0]).select("item_code", "title", "maker").collect())
    assert got() == want
    J.compact_items(spark, where[0])
    assert got() == want
    # More arrives after the compaction, under the same checkpoint.
    more = [("P0", "s0", -1, "earliest", "first"), ("P99", "s3", 5, "new", "")]
    spark.createDataFrame(more, OBSERVED).coalesce(1).write.json(str(tmp_path / "w9"))
    next((tmp_path / "w9").glob("part*")).rename(tmp_path / "in" / "009.json")
    J.stream_fuse(obs, fuse, ["s0", "s1", "s2", "s3"], ["seq"], *where).awaitTermination()
    want = sorted(fuse_fields(spark.createDataFrame(rows + more, OBSERVED), pri, FIELDS, order=["seq"]).select("item_code", "title", "maker").collect())
    assert got() == want


def test_paths_are_new_once(spark, tmp_path):
    """Repeats within a batch, within the horizon, and of long ago, which only the ledger knows."""
    schema = "path string, size bigint, mtime timestamp"
    listed = [[f"/a/{i}.mp4" for i in range(50)] + ["/a/1.mp4"], ["/a/3.mp4", "/b/1.mp4", "/b/1.txt"], ["/c/9.mp4"]]
    rows = [[(p, 1, None) for p in batch] for batch in listed]
    raw = _feed(spark, tmp_path, "in", rows, schema)
    ledger = str(tmp_path / "ledger")
    J.only_new_paths(J.dedupe_inventory(raw, (".mp4",)), ledger, str(tmp_path / "c1"), bits=16, buckets=4).awaitTermination()
    # A new stream without the old one's state repeats everything: batch ids go on after those of the ledger.
    want = sorted({p for batch in listed for p in batch if p.endswith(".mp4")})
    assert sorted(r.path for r in J.new_paths(spark, ledger).collect()) == want
    again = spark.createDataFrame([(p, 1, None) for p in [*want, "/d/1.mp4"]], schema)
    keep = []

    class Sink:
        def foreachBatch(self, step):
            keep.append(step)
            return self

        def __getattr__(self, _):
            return lambda *a, **k: self

    class Rows:
        writeStream = Sink()

    J.only_new_paths(Rows(), ledger, "", bits=16, buckets=4)
    for _ in range(2):  # the second time as a repeated batch
        keep[0](again, 7)
        assert sorted(r.path for r in J.new_paths(spark, ledger).collect()) == [*want, "/d/1.mp4"]
    assert not list(Path(ledger, "seen").glob("batch=8"))
    assert J.new_paths(spark, ledger).where(F.col("path") == "/d/1.mp4").count() == 1
