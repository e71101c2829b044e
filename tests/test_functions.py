"""Column functions on small literal inputs."""

import pytest
from pyspark.sql import functions as F

from catalogfuse.functions import codes, naming, scoring, text, values
from catalogfuse.functions import people as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "path,code",
    [
        ("/a/123456-789-CD1.mp4", "123456-789"),
        ("/a/abcd00644.mp4", "ABCD-644"),
        ("/a/259abcd-1456.mp4", "259ABCD-1456"),
        ("/a/[site] abcd-123-4K-.mp4", "ABCD-123"),
        ("/a/Series.21.03.04.some.words.mp4", "Series.21.03.04"),
        ("/a/SITE-NAME.21.03.04.mp4", "Site-name.21.03.04"),
        ("/a/MY_SITE.21.03.04.mp4", "Site.21.03.04"),
        ("/a/h_173mega05.mkv", "MEGA-05"),
        ("/a/n1234.mp4", "n1234"),
        ("/a/only words.mp4", "ONLY WORDS"),
    ],
)
def test_item_codes(spark, path, code):
    df = spark.createDataFrame([(path,)], "path string")
    assert codes.extract_item_code(df).first()["item_code"] == code


def test_brand_rule_goes_first(spark):
    df = spark.createDataFrame([("/a/acme_1234567.mp4",)], "path string")
    rules = (codes.brand_rule("ACME", 5), *codes.SHAPE_RULES)
    assert codes.extract_item_code(df, rules=rules).first()["item_code"] == "ACME-1234567"


@pytest.mark.parametrize("raw,iso", [("2021/2/3", "2021-02-03"), ("x 2020.12.31 y", "2020-12-31"), ("2021-02-30", None), ("0000-00-00", None), ("", None)])
def test_release(spark, raw, iso):
    assert one(spark, values.normalize_release(F.lit(raw))) == iso


@pytest.mark.parametrize("raw,minutes", [("0", None), ("00.0", None), ("90 min", "90"), ("5400", "90"), ("330", "6"), ("450", "8"), ("soon", "soon")])
def test_runtime(spark, raw, minutes):
    assert one(spark, values.normalize_runtime(F.lit(raw))) == minutes


def test_barcodes(spark):
    found = one(spark, values.extract_barcodes(F.lit("EAN: 4006381333931 and JAN：4006381333932 and 4006381333931")))
    assert found == ["4006381333931", "4006381333932"]
    assert [one(spark, values.is_valid_ean13(F.lit(x))) for x in found] == [True, False]


def test_people(spark):
    raw = "Ann (安)| Ann |-,Bob、Bob ／ Cy（シ）"
    assert one(spark, P.clean_people(F.lit(raw))) == ["安", "Ann", "Bob", "シ"]


def test_text_functions_are_idempotent(spark):
    for fn in (text.clean_text, text.strip_html, text.fold_width):
        once = one(spark, fn(F.lit("Ａ&amp;b<br/>・c")))
        assert one(spark, fn(F.lit(once))) == once


def test_nfkc(spark):
    assert one(spark, text.nfkc_key(F.lit(" ＡbＣ "))) == "abc"


@pytest.mark.parametrize(
    "expected,found,low,high",
    [
        ("same title", "Same-Title", 1.0, 1.0),
        ("se●ret long title here", "secret long title here", 0.95, 1.0),
        ("a very long title", "a very long title and more words", 0.92, 1.0),
        ("short", "something else", 0.0, 0.5),
        ("", "x", 0.0, 0.0),
    ],
)
@pytest.mark.parametrize("exact", [False, True])
def test_title_confidence(spark, expected, found, low, high, exact):
    df = spark.createDataFrame([(expected, found)], "e string, f string")
    got = scoring.with_title_confidence(df, ["e"], "f", exact=exact).first()["conf"]
    assert low <= got <= high


def test_code_hit_has_borders(spark):
    hit = lambda t: one(spark, scoring.code_hit(F.lit("AB-123"), F.lit(t)))
    assert hit("x ab 123 y") and hit("(AB_123)") and not hit("AB-1234") and not hit("XAB-123")


def context(spark, **fields):
    df = spark.createDataFrame([tuple(fields.values())], ", ".join(f"{k} string" for k in fields))
    return naming.naming_context(df)


def test_truncation_takes_title_before_number(spark):
    ctx = context(spark, number="ABC-123", title="a rather long title", actor="Ann,Bob,Cy")
    row = naming.render_names(ctx, "{{number}} {{title}} {{actor}}", max_length=20, truncated_out="cut").first()
    assert len(row["name"]) <= 20 and row["name"].startswith("ABC-123") and row["cut"][0] == "title"


def test_list_fields_lose_whole_entries(spark):
    ctx = context(spark, number="N", title="", actor="Annabel,Bobby,Cy")
    row = naming.render_names(ctx, "{{number}} {{actor}}", max_length=14).first()
    assert row["name"] == "N Annabel"


def test_unknown_template_field_is_an_error(spark):
    with pytest.raises(KeyError):
        naming.render_names(context(spark, number="N"), "{{nope}}")


def test_reserved_names(spark):
    assert one(spark, naming.avoid_reserved(F.lit("con.txt/ok/LPT1"))) == "con_.txt/ok/LPT1_"


@pytest.mark.parametrize(
    ("expected", "found", "code", "least"),
    [
        ("a●cdef", "●bcdef", None, 0.95), ("abcdefghijklmn", "xab●defghijklmnx", None, 0.92), ("Red Title Story", "【Set】Red Title Story [DVD]", None, 1.0),
        ("Red Title Story", "RED-001 Red Title Story", "RED-001", 1.0), ("Red", "red 001 RED [Blu-ray]", "RED-001", 1.0),
    ],
)
def test_titles_with_wildcards_marks_and_codes(spark, expected, found, code, least):
    df = spark.createDataFrame([(expected, found, code)], "a string, b string, c string")
    assert scoring.with_title_confidence(df, ["a"], "b", code=F.col("c")).first()["conf"] >= least


def test_a_floor_changes_no_score_above_it(spark):
    words = ["red title story", "red title", "story red title x", "blue", "red t●tle story", "rad titel storie"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    exact = {(r.a, r.b): r.conf for r in scoring.with_title_confidence(df, ["a"], "b").collect()}
    for r in scoring.with_title_confidence(df, ["a"], "b", floor=F.lit(0.58)).collect():
        assert r.conf == exact[r.a, r.b] if exact[r.a, r.b] >= 0.58 else r.conf <= exact[r.a, r.b]


@pytest.mark.parametrize(
    ("name", "spellings"),
    [
        ("GAME.EP6.PART", ["GAME.EP6"]), ("MXJ-005.EP1.X", ["MXJ005", "MXJ-005.EP1", "MXJ-005 EP1", "MXJ-0005.EP1"]),
        ("ABC-12-TEXT", ["ABC12", "ABC-12", "ABC012", "ABC-012"]),
    ],
)
def test_spellings(spark, name, spellings):
    assert one(spark, codes.candidate_codes(F.lit(name))) == spellings


def test_wildcards_inside_a_title_are_one_pattern(spark):
    """Wildcards on either side, against the comparison of characters at every place."""
    w = scoring.WILDCARD
    texts = ["", "a", w, "ab", f"a{w}", f"{w}b", "xaby", f"x{w}by", "水ab𝒳c", f"b{w}c", f"{w}{w}", "b𝒳c", f"水{w}b"]
    at = lambda x, y, k: all(p == q or w in (p, q) for p, q in zip(x, y[k:], strict=False))
    df = spark.createDataFrame([(x, y) for x in texts for y in texts], "x string, y string").select("x", "y", scoring._inside(F.col("x"), F.col("y"), F.lit(True)).alias("in"))
    for r in df.collect():
        assert r["in"] == (r.x in r.y or (0 < len(r.x) <= len(r.y) and any(at(r.x, r.y, k) for k in range(len(r.y) - len(r.x) + 1))))
    assert "exists(" not in df._jdf.queryExecution().optimizedPlan().toString()
