"""Readers, writers and streams on temporary folders."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from catalogfuse.operators.translate import translate
from catalogfuse.sources import alias_xml, html, inventory, ledger, sidecars
from catalogfuse.streaming import jobs


def test_scan_inventory(spark, tmp_path):
    for name in ("a/x.mp4", "a/.hidden.mp4", "a/trailer.mp4", "a/y.txt", "b/c/z.MKV", "b/skip", "d/w.mp4"):
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("x")
    got = inventory.scan_inventory(spark, [str(tmp_path)], [".mp4", ".mkv"]).collect()
    assert [r["path"].removeprefix(str(tmp_path)) for r in got] == ["/a/x.mp4", "/d/w.mp4"]


def test_alias_xml(spark, tmp_path):
    doc = '<root><a zh_cn="A" zh_tw="B" jp="C" keyword=",x,y," href="/1"/><a zh_cn="D" zh_tw="D" jp="D" keyword=",D," href=""/></root>'
    (tmp_path / "m.xml").write_text(doc)
    rows = alias_xml.read_alias_table(spark, str(tmp_path / "m.xml")).orderBy("ord").collect()
    assert [r["keywords"] for r in rows] == [["x", "y"], ["D"]] and rows[0]["canonical"]["jp"] == "C"


def test_sidecar_fields(spark):
    xml = (
        "<movie><plot><![CDATA[the plot\n\n由 Engine 提供翻译]]></plot><num>AB-1</num><title>AB-1 name CD2</title><releasedate>2020/1/5</releasedate>"
        "<actor><name>Ann</name></actor><actor><name>Bob</name></actor><tag>Ann fan</tag><tag>red</tag><maker>M</maker></movie>"
    )
    good, bad = sidecars.sidecar_items(sidecars.parse_sidecars(spark.createDataFrame([(xml,), ("<movie><num>x</num></movie>",)], "xml string")))
    row = good.first()
    assert (row["title"], row["release"], row["maker"], row["outline"], row["outline_from"]) == ("name", "2020-01-05", "M", "the plot", "Engine")
    assert row["people"] == ["Ann", "Bob"] and row["own_tags"] == ["red"] and bad.count() == 1


def test_ledger_round_trip(spark, tmp_path):
    schema = "path string, status string, ts timestamp"
    path = str(tmp_path / "ledger")
    ledger.ledger_append(spark.createDataFrame([("a", "failed", datetime(2024, 1, 1)), ("b", "ok", datetime(2024, 1, 1))], schema), path)
    ledger.ledger_append(spark.createDataFrame([("a", "ok", datetime(2024, 1, 2))], schema), path)
    latest = ledger.ledger_read(spark, path)
    assert {r["path"]: r["status"] for r in latest.collect()} == {"a": "ok", "b": "ok"}
    todo = spark.createDataFrame([("a",), ("c",)], "path string")
    assert [r["path"] for r in ledger.remaining_paths(todo, latest).collect()] == ["c"]


def test_label_rules(spark):
    page = "<table><tr><th>Studio:</th><td>One <b>Two</b></td></tr><tr><td>片商</td><td>Three</td></tr></table>"
    rules = (html.Rule("maker", "studio|片商", "label", many=True), html.Rule("cell", "td.none", "tag"))
    row = html.extract_fields(spark.createDataFrame([(1, page)], "page_id int, html string"), rules, all_fields=("maker", "score")).first()
    assert row["maker"] == ["One Two", "Three"] and row["cell"] is None and row["unsupported"] == ["score"]


def test_translate_falls_back_and_keeps_failures(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "a")], "id int, t string")
    engines = [("one", lambda xs: [x if x != "a" else "A" for x in xs]), ("two", lambda xs: ["B" if x == "b" else None for x in xs])]
    got = {r["id"]: (r["t"], r["t_by"]) for r in translate(df, "t", engines).collect()}
    assert got == {1: ("A", "one"), 2: ("B", "two"), 3: ("c", None), 4: ("A", "one")}


def run(df, base):
    q = (
        df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp")
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/out")


def test_stream_inventory_takes_each_path_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"path": p, "size": 1, "mtime": "2024-01-01T00:00:00"} for p in ("/a/x.mp4", "/a/x.mp4", "/a/y.txt", "/b/z.mp4")]
    (src / "1.json").write_text("\n".join(map(json.dumps, rows)))
    got = run(jobs.stream_inventory(spark, str(src), (".mp4",)), tmp_path / "s")
    assert sorted(r["path"] for r in got.collect()) == ["/a/x.mp4", "/b/z.mp4"]
