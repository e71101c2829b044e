"""Nulls, empty and long texts, ties, repeated rows, clashing names and empty tables: each has its stated result."""

import hashlib

from pyspark.sql import functions as F

from catalogfuse.llm import collocations, hard_negatives, hyperminhash
from catalogfuse.llm import decontaminate, exact_dedup, jaccard_join, line_dedup, mixing, packing, pii, sharding, suffix_dedup, toxicity

LABELS = "doc_id bigint, quality int, toxic int"


def by_id(df):
    return sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))


def test_exact_dedup(hard, none):
    rows = by_id(exact_dedup.exact_dedup(hard))
    assert len(rows) == 11 and exact_dedup.exact_dedup(none).count() == 0
    same = [r for r in rows if r.text_sha256 == hashlib.sha256(b"one two three four five six seven").hexdigest()]
    assert [(r.doc_id, r.keep_id, r.group_size) for r in same] == [(1, 1, 4), (1, 1, 4), (2, 1, 4), (None, 1, 4)] and sum(r.kept for r in same) == 1
    empty = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert [(r.doc_id, r.kept) for r in empty] == [(3, True), (4, False), (None, False)]


def test_toxicity(spark, hard, none):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (2, None, 1), (4, 0, None), (None, 1, 1), (6, 1, 0), (8, 1, 0)], LABELS)
    empty = spark.createDataFrame([], LABELS)
    for given in (labels, empty):
        rows = toxicity.score_toxicity(hard, given).collect()
        assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
        assert all(r.ratio == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert toxicity.drop_toxic(hard, empty).columns == hard.columns and toxicity.drop_toxic(hard, empty).count() == 11


def test_pii(hard, none):
    rows = by_id(pii.find_pii(hard))
    assert len(rows) == 11 and pii.find_pii(none).count() == 0
    assert [(s.kind, s.start, s.end) for s in rows[8].spans][:4] == [("email", 0, 6), ("email", 15, 21), ("email", 30, 36), ("ip", 7, 14)]
    assert all(not r.spans for r in rows if r.doc_id != 8)


def test_decontaminate(spark, hard, none):
    bench = spark.createDataFrame([(1, "One two three four five six seven"), (1, "one two three four five six seven"), (None, "one two three four five six seven"), (2, None), (3, "")], "item_id bigint, text string")
    got = decontaminate.contaminated(hard, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.item_id} == {(1, 1), (2, 1)}
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(hard, bench.where("false")).count() == 0
    left = decontaminate.drop_contaminated(hard, bench)
    assert left.columns == hard.columns and left.count() == 8


def test_packing(hard, none):
    rows = packing.pack_tokens(hard, row=512).collect()
    seen = {i for r in rows for i in r.doc_ids}
    assert seen == {1, 2, None, 5, 6, 7, 8} and packing.pack_tokens(none).count() == 0


def test_jaccard_join(hard, none):
    rows = by_id(jaccard_join.jaccard_join(hard))
    assert [(r.doc_id, r.component_id) for r in rows] == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8), (None, None), (None, None)]
    assert [r.n_shingles for r in rows[:6]] == [3, 3, 3, 0, 0, 0] and rows[7].n_shingles == 1
    assert jaccard_join.jaccard_join(none).count() == 0
    left = jaccard_join.drop_near_duplicates(hard)
    assert left.columns == hard.columns and left.count() == 10


def test_line_dedup(hard, none):
    rows = by_id(line_dedup.line_dedup(hard))
    assert len(rows) == 11 and line_dedup.line_dedup(none).count() == 0
    found = {r.doc_id: r for r in rows}
    assert found[2].n_exact == 1 and found[2].kept_lines == [] and found[3].kept_lines == [0] and found[5].kept_lines == [0, 1]
    assert found[6].n_lines == 2002 and found[6].n_exact == 1999 and found[None].kept_lines == [0]


def test_suffix_dedup(spark, hard, none):
    long = "the same passage of more than fifty bytes, twice in two documents, here"
    more = hard.select("doc_id", "text").union(spark.createDataFrame([(20, long), (21, "x" + long), (21, "y" + long), (None, long)], "doc_id bigint, text string"))
    rows = by_id(suffix_dedup.suffix_dedup(more))
    assert len(rows) == 15 and suffix_dedup.suffix_dedup(none).count() == 0
    assert [(r.n_bytes, r.n_removed) for r in rows if r.doc_id in (20, 21)] == [(71, 0), (72, 71), (72, 71)]
    assert all(r.n_removed == 0 for r in rows if r.doc_id not in (21,))


def test_mixing(hard, none):
    rows = mixing.mix_sources(hard).collect()
    assert len(rows) == 11 and all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in rows)
    assert mixing.mix_sources(none).count() == 0
    mixed = mixing.mixed_documents(hard)
    assert mixed.columns == hard.columns and mixed.count() == sum(r.copies for r in rows) and mixing.mixed_documents(none).count() == 0


def test_sharding(hard, none):
    rows = sharding.shard_rows(hard, shards=4).collect()
    assert sorted(r.row_no for r in rows) == list(range(11)) and len({(r.shard, r.slot) for r in rows}) == 11
    assert sharding.shard_rows(none).count() == 0


def test_near_duplicates(hard, none):
    rows = by_id(hyperminhash.near_duplicates(hard))
    assert [(r.doc_id, r.component_id, r.kept) for r in rows] == [
        (1, 1, True), (1, 1, True), (2, 1, False), *((i, i, True) for i in range(3, 9)), (None, None, True), (None, None, True)
    ]
    assert [r.n_shingles for r in rows[:6]] == [3, 3, 3, 0, 0, 0] and rows[7].n_shingles == 1
    assert hyperminhash.near_duplicates(none).count() == 0


def test_hard_negatives(spark):
    """Nulls everywhere, short and empty vectors, repeated rows, other columns, no rows."""
    nan, inf = float("nan"), float("inf")
    kind = "vec_id bigint, label int, embedding array<double>, block int, score string"
    rows = [
        (0, 1, [2.0, 0.0]), (0, 1, [2.0, 0.0]), (1, 1, [2.0, 1.0]), (2, 2, [1.0, 5.0]), (2, 2, [1.0, 5.0]), (3, 2, [1.5]), (4, 2, []), (5, None, [1.0, 1.0]),
        (6, 2, None), (7, 2, [1.0, None]), (8, 2, [nan, 1.0]), (9, 2, [inf, 1.0]), (None, 2, [1.0, 1.0]),
    ]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], kind)
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") == 0, scale=2.0).collect())
    # The other row of the anchor's id is no positive; the repeated negative counts twice; an empty vector scores 0.
    assert got == [(0, 1, 1, 3, 16, 12), (0, 1, 2, 2, 16, 8), (0, 1, 3, 2, 16, 8)]
    assert hard_negatives.hard_negatives(df.where("false"), F.col("vec_id") == 0).count() == 0
    assert hard_negatives.hard_negatives(df, F.col("vec_id") == 99).count() == 0


def test_collocations(hard, none):
    rows = {(r.lang, r.phrase): (r.a, r.l, r.r) for r in collocations.collocations(hard, least=3).collect()}
    assert rows[("en", "one two three four")][0] == 3 and ("und", "one two") not in rows
    assert {k for k in rows if k[0] == "de"} == {("de", "word word word word")}
    assert collocations.collocations(none).count() == 0
