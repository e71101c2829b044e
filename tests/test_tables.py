"""Table jobs on small inputs, checked by brute force; hot keys included."""

import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from catalogfuse.operators import linkage, lookups, substrings
from catalogfuse.operators.aliases import alias_prefix_lookup
from catalogfuse.operators.reports import person_catalog
from catalogfuse.plans.skew import exact_percentiles, number_rows, number_slots, run_slots, runs
from catalogfuse.sources.html import Rule, extract_fields


def test_exact_percentiles_with_a_hot_key(spark):
    rnd = random.Random(5)
    rows = [("hot", float(rnd.choice([1, 1, 1, rnd.randint(0, 400)]))) for _ in range(3000)]
    rows += [(f"k{i % 7}", rnd.random() * 50) for i in range(400)] + [("flat", 2.5)] * 30
    got = {r["k"]: r for r in exact_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [0.5, 0.9, 0.99], accuracy=50).collect()}
    for key in {k for k, _ in rows}:
        vals = sorted(v for k, v in rows if k == key)
        for name, ratio in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
            assert got[key][name] == vals[round((len(vals) - 1) * ratio)]


def test_percentiles_of_a_heavy_tail(spark):
    """Nearly all values in one of a thousand equal widths; only what is near a position is ordered."""
    rnd = random.Random(9)
    vals = [rnd.paretovariate(0.3) for _ in range(20_000)] + [1e12]
    df = spark.createDataFrame([(None, v) for v in vals] + [("x", 1.0), ("x", None)], "k string, v double")
    got = {r["k"]: r for r in exact_percentiles(df, ["k"], "v", [0.0, 0.5, 0.99, 1.0], names=["least", "p50", "p99", "most"], accuracy=500).collect()}
    vals.sort()
    assert [got[None][n] for n in ("least", "p50", "p99", "most")] == [vals[round((len(vals) - 1) * r)] for r in (0.0, 0.5, 0.99, 1.0)]
    assert got["x"]["p50"] == got["x"]["most"] == 1.0


def _runs_by_hand(rows, gap, closed=False):
    want, last, run = [], {}, {}
    for k, ts in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        since = (ts - last[k]).total_seconds() if k in last else None
        if since is None or since > gap or (closed and since == gap):
            run[k] = run.get(k, 0) + 1
        last[k] = ts
        want.append((k, ts, run[k]))
    return want


def test_runs_across_the_borders_of_spans(spark):
    rnd, start = random.Random(6), datetime(2024, 1, 1, 23, 50)
    rows = []
    for key in ("a", "b", None):
        at = start
        for _ in range(300):
            at += timedelta(seconds=rnd.choice([1, 5, 600, 601, 700, 40000]))
            rows.append((key, at))
    df = spark.createDataFrame([*rows, ("a", None)], "k string, ts timestamp")
    key = lambda r: (r[0] or "", r[1] or start, r[2] or 0)
    for closed in (False, True):
        want = _runs_by_hand(rows, 600, closed)
        got = [(r["k"], r["ts"], r["run"]) for r in number_rows(df, ["k"], "ts", 600, closed).collect()]
        assert sorted(got, key=key) == sorted([*want, ("a", None, None)], key=key)
        # Whatever the spans and their levels.
        slots = run_slots(df, ["k"], "ts", 600)
        opens = (lambda g: g >= 600_000_000) if closed else (lambda g: g > 600_000_000)
        for fan, levels in ((2, 3), (3, 1), (1024, 0)):
            numbered = number_slots(slots, ["k"], opens, fan, levels).groupBy("k").agg(F.max("_run").alias("n")).collect()
            assert {r["k"]: r["n"] for r in numbered} == {k: max(x[2] for x in want if x[0] == k) for k in ("a", "b", None)}


def test_bursts_of_one_key_on_one_day(spark):
    """99 in 100 rows are of one key and one day: what meets in a task after the rows' own is a small part of them."""
    rows = spark.range(200_000).select(
        F.when(F.col("id") % 100 == 0, F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).otherwise("hot").alias("k"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.pmod(F.xxhash64("id"), F.lit(86_000_000)) * 1000).alias("ts"),
    ).repartition(8)
    got = {(r["k"], r["run"]): r for r in runs(rows, ["k"], "ts", 2).collect()}
    want = {}
    for k, ts, run in _runs_by_hand([(r["k"], r["ts"]) for r in rows.collect()], 2):
        want[(k, run)] = want.get((k, run), 0) + 1
    assert {x: r["rows"] for x, r in got.items()} == want
    summaries = run_slots(rows.where("k = 'hot'"), ["k"], "ts", 900)
    assert summaries.count() <= 100
    spans = run_slots(rows, ["k"], "ts", 2).groupBy("k", F.floor(F.col("_slot") / 1024)).count()
    assert spans.agg(F.max("count")).first()[0] <= 1024 < 0.05 * 200_000


def test_substring_terms(spark):
    words = ["ab", "abc", "Bcd", "xyz", "c d", "b", "zabcde"]
    texts = [(i, t) for i, t in enumerate(["zabcde", "ABCD", "no", "b c d", "", "xy"])]
    df = spark.createDataFrame(texts, "id int, text string")
    terms = spark.createDataFrame(list(enumerate(words)), "ord int, term string")
    want = sorted((i, w) for i, t in texts for w in words if w.lower() in t.lower())
    got = lookups.dictionary_terms(df, terms, "text", "id", "substring")
    assert sorted((r["id"], r["term"]) for r in got.collect()) == want
    assert lookups.dictionary_terms(df, terms.where("false"), "text", "id", "substring").count() == 0


def test_substrings_by_their_rarest_gram(spark):
    """Long and short terms, marks of several bytes, terms across texts' borders; few rows for rare terms."""
    rnd = random.Random(3)
    pool = ["einsteinium", "Überraschung", "ü", "question mark", "abcabcabcabc", "tion", "水が沸騰する", "zzz", "question mark."]
    texts = []
    for i in range(400):
        words = [rnd.choice(["alpha", "beta", "question", "mark", "abcabc"]) for _ in range(rnd.randint(0, 30))]
        if i % 20 == 0:
            words.insert(rnd.randint(0, len(words)), rnd.choice(pool).upper())
        texts.append((i, " ".join(words)))
    texts += [(400, "einstein"), (401, "ium"), (402, None)]
    df = spark.createDataFrame(texts, "id int, text string").repartition(3)
    terms = spark.createDataFrame(list(enumerate(pool)), "ord int, term string")
    want = sorted((i, w) for i, t in texts if t for w in pool if w.lower() in t.lower())
    assert sorted((r.id, r.term) for r in substrings.substring_terms(df, terms, "text", "id").collect()) == want
    rare = terms.where("term in ('einsteinium', 'Überraschung', '水が沸騰する', 'absent entirely')").unionByName(spark.createDataFrame([(99, "absent entirely")], "ord int, term string"))
    hits, chosen = substrings.gram_hits(df, rare, "text", "id")
    assert hits.count() < 20 and "absent entirely" not in [r["_t"] for r in chosen.collect()]


def test_word_terms_of_any_length(spark):
    df = spark.createDataFrame([(1, "A sci-fi film: one two three four five six"), (2, "science")], "id int, text string")
    terms = spark.createDataFrame([(1, "one two three four five"), (2, "sci-fi"), (3, "scien"), (4, "--")], "ord int, term string")
    got = lookups.dictionary_terms(df, terms, "text", "id")
    assert sorted((r["id"], r["term"]) for r in got.collect()) == [(1, "one two three four five"), (1, "sci-fi")]


def test_no_file_is_lost_when_codes_are_shared(spark):
    files = spark.createDataFrame([(1, "A", True), (2, "A", False), (3, "B", True), (4, None, True)], "id int, item_code string, may boolean")
    items = spark.createDataFrame([("A", "title")], "item_code string, title string")
    got = lookups.share_by_code(files, lambda codes: codes.join(items, "item_code"), F.col("may"))
    assert sorted((r.id, r.title, r.shared, r.resolved) for r in got.collect()) == [
        (1, "title", True, True), (2, "title", False, True), (3, None, True, False), (4, None, True, False),
    ]


def test_the_last_listing_row_of_a_code_wins(spark):
    rows = [(1, "p", "A", "old", "2020.1.2", "u", False, False), (2, "p", "A", "new", "03-17-2021", "v", True, False)]
    listing = spark.createDataFrame(rows, "pos int, person string, item_code string, title string, date_text string, url string, has_download boolean, has_subtitle boolean")
    got = person_catalog(listing, spark.createDataFrame([("p", "A")], "person string, item_code string")).collect()
    assert [(r.title, r.date, r.availability, r.single_work) for r in got] == [("new", "2021/03/17", "download", True)]


def test_page_rules_go_by_attempt(spark):
    rules = [Rule("name", "<b>(.*?)</b>", attempt=1), Rule("name", "h1", kind="tag"), Rule("note", "<i>(.*?)</i>"), Rule("note", "h1", kind="tag", attempt=1)]
    pages = spark.createDataFrame([(1, "<h1>first</h1><b>second</b>"), (1, "<b>only</b>"), (2, "")], "page_id int, html string")
    got = extract_fields(pages, rules).collect()
    assert sorted((r.page_id, r.name or "", r.note or "") for r in got) == [(1, "first", "first"), (1, "only", ""), (2, "", "")]


def test_prefix_lookup_prefers_exact(spark):
    names = spark.createDataFrame([(1, "P1", "Anna"), (2, "P2", "Ann"), (3, "P3", "Bo")], "ord int, name string, alias string")
    asked = spark.createDataFrame([("Ann",), ("An",), ("B",), ("x",)], "who string")
    got = {r["who"]: (r["person"], r["matched_by"]) for r in alias_prefix_lookup(asked, names, "who").collect()}
    assert got == {"Ann": ("P2", "exact"), "An": ("P1", "prefix"), "B": ("P3", "prefix"), "x": (None, None)}


def test_signatures_meet_within_eight_bits(spark):
    """Against all pairs; copies of one picture are one class."""
    rnd = random.Random(2)
    base = [[rnd.choice([-1.0, 1.0]) * (1 + rnd.random()) for _ in range(64)] for _ in range(30)] + [[1.0] * 64]
    refs = [(i, v) for i, v in enumerate(base)] + [(100 + i, v) for i, v in enumerate(base[:5])]
    pictures = []
    for i in range(200):
        v = list(rnd.choice(base))
        for k in rnd.sample(range(64), rnd.randint(0, 11)):
            v[k] = -v[k]
        pictures.append((i, v))
    pictures += [(300 + i, base[3]) for i in range(20)]
    frame = lambda rows, name: spark.createDataFrame([(i, v, [abs(x) for x in v]) for i, v in rows], f"{name} int, vec array<double>, hist array<double>")
    bits = lambda v: sum(1 << i for i, x in enumerate(v) if x >= sum(v) / 64)
    want = {}
    for p, v in pictures:
        found = []
        for r, w in refs:
            hashed = 1 - (bits(v) ^ bits(w)).bit_count() / 64
            hist = sum(min(abs(x), abs(y)) for x, y in zip(v, w)) / min(sum(map(abs, v)), sum(map(abs, w)))
            score = hashed * 0.7 + hist * 0.3
            if hashed >= 0.86 and hist >= 0.7 and score >= 0.82:
                found.append((-round(score, 9), r))
        if found:
            want[p] = min(found)[1]
    got = {r.picture: r.ref for r in linkage.signature_links(frame(pictures, "picture"), frame(refs, "ref")).collect()}
    assert got == want and 100 < len(got) < 220


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_titles_cut_a_name_into_words_once(spark):
    from catalogfuse.functions.codes import candidate_titles

    df = spark.createDataFrame([("one longerword and another longword",), (None,), ("short",), ("",)], "line string")
    got = df.select(candidate_titles("line").alias("t"))
    assert _plan(got).count("regexp_replace") == 1
    whole = "ONE LONGERWORD AND ANOTHER LONGWORD"
    want = ["LONGERWORD", "LONGWORD", whole, "ONE LONGERWORD", "AND ANOTHER LONGWORD", "LONGERWORD AND ANOTHER", "one longerword and another longword"]
    assert [r.t for r in got.collect()][0] == want
    assert [r.t for r in got.collect()][2:] == [["SHORT", "short"], []]


def test_provider_ids_read_a_document_once_per_property(spark):
    from catalogfuse.functions.people import provider_ids

    claim = lambda v: '[{"mainsnak": {"datavalue": {"value": "%s"}}}]' % v
    doc = '{"entities": {"Q1": {"claims": {"P1": %s, "P3": %s}}}}' % (claim("a"), claim("c"))
    df = spark.createDataFrame([("Q1", doc), ("Q2", doc), ("Q1", None)], "entity string, doc string")
    got = df.select(provider_ids("doc", "entity", [("one", "P1"), ("two", "P2"), ("three", "P3")]).alias("ids"))
    assert _plan(got).count("get_json_object") == 3
    assert [r.ids for r in got.collect()] == [{"one": "a"}, {}, {}]


def test_file_index_holds_a_path_once(spark):
    paths = ["/b/x.srt", "/a/z/X.srt", "/a/x.SRT", "x.srt", "/c/y.srt", None]
    got = lookups.file_index(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert "min_by" not in _plan(got)
    assert {r._name: r.match for r in got.collect()} == {"x.srt": "x.srt", "y.srt": "/c/y.srt", None: None}


def test_word_terms_shuffle_only_what_the_dictionary_may_hold(spark):
    """Repeated, adjacent and cut phrases, marks of several bytes; texts' n-grams are no rows unless a term's hash is theirs."""
    rnd = random.Random(5)
    pool = ["Ünder", "sea", "a_b", "x", "水が", "sci-fi", "film"]
    texts = [(i, rnd.choice([" ", ", ", "--"]).join(rnd.choice(pool) for _ in range(rnd.randint(0, 9)))) for i in range(200)] + [(200, None), (201, "...")]
    terms = list(enumerate(["ünder SEA", "sea", "x x", "film, film; film", "水が", "a_b x", "sci", "--", "UNDER", "ünder-sea", "not there at all"]))
    df, dictionary = spark.createDataFrame(texts, "id int, text string").repartition(3), spark.createDataFrame(terms, "ord int, term string")
    words = lambda t: " ".join(w for w in re.split(r"\W+", t.lower()) if w)
    first = {}
    for _, term in terms:
        first.setdefault(words(term), term)
    want = sorted((i, first[w]) for i, t in texts if t for w in first if w and f" {w} " in f" {words(t)} ")
    got = lookups.dictionary_terms(df, dictionary, "text", "id")
    assert sorted((r.id, r.term) for r in got.collect()) == want and len(want) > 200
    assert "explode" not in _plan(got) and "MapInArrow" in _plan(got)


def test_texts_are_counted_once_for_the_rarest_grams(spark):
    df = spark.createDataFrame([(1, "a long dictionary word"), (2, "dictionary"), (3, "x")], "id int, text string")
    terms = spark.createDataFrame([(1, "dictionary"), (2, "x"), (3, "wo"), (4, "ary ")], "ord int, term string")
    got = lookups.dictionary_terms(df, terms, "text", "id", "substring")
    assert sorted((r.id, r.term) for r in got.collect()) == [(1, "ary "), (1, "dictionary"), (1, "wo"), (2, "dictionary"), (3, "x")]
    assert "InMemoryRelation" in got._jdf.queryExecution().withCachedData().toString()


def test_signature_takes_the_mean_once(spark):
    from catalogfuse.functions.scoring import signature_bits

    rnd = random.Random(2)
    vectors = [[rnd.uniform(-1, 1) for _ in range(64)] for _ in range(20)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*vectors, [], None])], "i int, v array<double>").select("i", signature_bits("v").alias("b"))
    want = [sum(1 << k for k, x in enumerate(v) if x >= sum(v) / 64) for v in vectors]
    assert [r.b if r.b is None else r.b % 2**64 for r in df.orderBy("i").collect()] == [*want, 0, None]
    assert re.search(r">= lambda \w+#\w+\.mean", _plan(df))
