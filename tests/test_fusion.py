"""Fusion against a plain-Python second oracle."""

import random

from pyspark.sql import functions as F

from catalogfuse.operators.fusion import collect_candidates, fuse_fields, priority_frame
from catalogfuse.schemas import Field

FIELDS = [Field("title"), Field("thumb"), Field("release", "release"), Field("runtime", "runtime")]
ORDER = {"title": ["a", "b", "c"], "thumb": ["c", "a"], "release": ["b", "a", "d"], "runtime": ["a", "d"]}


def make_rows(seed):
    rnd = random.Random(seed)
    rows = []
    for item in range(25):
        for source in "abcde":
            if rnd.random() < 0.7:
                rows.append(
                    (
                        f"i{item}", source, f"{source}{item}", rnd.choice(["", f"t{source}"]), rnd.choice(["", f"u{source}"]),
                        rnd.choice(["", "0000-00-00", "2021/02/30", "2020.1.5"]), rnd.choice(["", "0", "0.0", "90"]),
                    )
                )
    return rows


def value_of(row, field):
    raw = row[{"title": 3, "thumb": 4, "release": 5, "runtime": 6}[field]]
    if field == "release":
        return "2020-01-05" if raw == "2020.1.5" else None
    if field == "runtime":
        return raw if raw == "90" else None
    return raw or None


def plain_fuse(rows):
    items = {}
    for r in rows:
        items.setdefault(r[0], {})[r[1]] = r
    out = {}
    for item, by_source in items.items():
        values, winners, consulted = {}, {}, []
        for f in FIELDS:
            for s in ORDER[f.name]:
                if s not in by_source:
                    continue
                if s not in consulted:
                    consulted.append(s)
                v = value_of(by_source[s], f.name)
                if v is not None:
                    values[f.name], winners[f.name] = v, s
                    break
        if consulted:
            thumbs = [(s, by_source[s][4]) for s in consulted if by_source[s][4]]
            out[item] = (values, winners, consulted, thumbs)
    return out


def setup(spark, rows):
    obs = spark.createDataFrame(rows, "item_code string, source string, external_id string, title string, thumb string, release string, runtime string")
    pri = priority_frame(spark, [("", f, s, i) for f, o in ORDER.items() for i, s in enumerate(o)]).drop("item_type")
    return obs, pri


def test_fuse_matches_plain_python_in_any_order(spark):
    rows = make_rows(1)
    want = plain_fuse(rows)
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    for data in (rows, shuffled):
        got = {r["item_code"]: r for r in fuse_fields(*setup(spark, data), FIELDS).collect()}
        assert set(got) == set(want)
        for item, (values, winners, _, _) in want.items():
            assert {f.name: got[item][f.name] for f in FIELDS if got[item][f.name]} == values
            assert got[item]["field_sources"] == winners
            assert got[item]["external_ids"] == {s: f"{s}{item[1:]}" for s in winners.values()}


def test_consulted_sources_and_their_order(spark):
    rows = make_rows(3)
    want = plain_fuse(rows)
    got = {r["item_code"]: r for r in collect_candidates(*setup(spark, rows), FIELDS).collect()}
    for item, (_, _, consulted, thumbs) in want.items():
        assert got[item]["consulted"] == consulted
        assert [tuple(t) for t in got[item]["thumbs"]] == thumbs


def test_second_source_is_not_asked_when_the_first_is_valid(spark):
    rows = [("i", "a", "1", "t", "", "2020.1.5", "90"), ("i", "b", "2", "x", "ub", "", ""), ("i", "c", "3", "y", "uc", "", "")]
    obs, pri = setup(spark, rows)
    got = collect_candidates(obs, pri, FIELDS).collect()[0]
    # title asks a; thumb asks c; release asks b, then a. d has no record.
    assert got["consulted"] == ["a", "c", "b"]


def test_language_rows_only_serve_their_field(spark):
    rows = [("i", "a", "en", "english"), ("i", "a", "ja", "nihongo")]
    obs = spark.createDataFrame(rows, "item_code string, source string, language string, title string")
    pri = spark.createDataFrame([("title", "a", 1)], "field string, source string, rank int")
    got = fuse_fields(obs, pri, [Field("title", language="ja")]).collect()
    assert got[0]["title"] == "nihongo"


def test_types_languages_ids_years_and_people(spark):
    kind = "item_code string, item_type string, source string, language string, external_id string, title string, release string, year string, people array<string>, all_people array<string>, edition string"
    rows = [
        ("i", "A", "s", "", "1", "", "2020-01-02", "0000", ["Ann"], ["Bob"], ""),
        ("i", "A", "s", "ja", "2", "the title", "", "", None, None, " Cut "),
        ("i", "B", "t", "", "3", "other", "", "", None, None, ""),
    ]
    fields = [Field("title", language="ja"), Field("release", "release"), Field("year", "year"), Field("people", "list"), Field("all_people", "list")]
    pri = priority_frame(spark, [(t, f.name, s, 1) for t in "AB" for f in fields for s in "st"])
    obs = spark.createDataFrame(rows, kind)
    got = {r.item_type: r for r in fuse_fields(obs, pri, fields).collect()}
    assert set(got) == {"A", "B"} and got["A"].title == "the title" and got["B"].title == "other"
    assert got["A"].year == "2020" and got["A"].all_people == ["Bob", "Ann"] and set(got["A"].external_ids) == {"s"}
    first = {r.item_type: r for r in collect_candidates(obs, pri, fields, edition=lambda c: F.lower(F.trim(c))).collect()}
    assert first["A"].edition == "cut" and first["A"].consulted == ["s"]


def test_only_what_is_read_travels(spark):
    from catalogfuse.operators.fusion import field_coverage

    fields = [Field("title"), Field("thumb")]
    columns = ["item_code", "item_type", "source", "external_id", "title", "thumb", "blob", "seq"]
    rows = [("i", "t", "a", "1", "late", "u", "x", 2), ("i", "t", "a", "2", "", "u", "x", 1), ("i", "t", "b", "3", "t", "", "x", 1), ("i", "t", "z", "4", "t", "v", "x", 1)]
    obs = spark.createDataFrame(rows, columns)
    pri = priority_frame(spark, [("t", "title", "a", 1), ("t", "title", "b", 2), ("t", "thumb", "b", 1), ("t", "thumb", "a", 2)])
    fused, asked, covered = (f(obs, pri, fields, order=["seq"]) for f in (fuse_fields, collect_candidates, field_coverage))
    for frame, unread in ((fused, "blob"), (asked, "blob"), (asked, "external_id"), (covered, "blob"), (covered, "external_id")):
        assert unread not in frame._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
    assert [(r.title, r.thumb) for r in fused.collect()] == [("t", "u")]
    assert asked.collect()[0].consulted == ["a", "b"]
    assert {(r.field, r.source, r.status, r.n) for r in covered.collect()} == {
        ("title", "a", "missing", 1), ("title", "b", "chosen", 1), ("thumb", "b", "missing", 1), ("thumb", "a", "chosen", 1)
    }
