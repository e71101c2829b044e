"""Each operator against a plain version of its contract, on small whole tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalogfuse.llm import blocks, collocations, hard_negatives, hyperminhash
from catalogfuse.llm import decontaminate, exact_dedup, jaccard_join, line_dedup, mixing, packing, pii, sharding, suffix_dedup, toxicity
from catalogfuse.llm.registry import ORACLE, QUERIES
from check import rows_of

FOLDER = "/root/testdata/sf0.001"
SPACES = re.compile(r"[\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(set(ORACLE) - {"pipeline"}))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cur.fetchall())


def test_exact_dedup_in_pieces(spark):
    rows = [(i, "same\ttext" if i % 3 else f"text {i}") for i in range(300)]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), pieces=7).collect()}
    assert len(got) == 300 and sum(r.kept for r in got.values()) == 101
    assert {got[i].keep_id for i in range(300) if i % 3} == {1} and got[2].group_size == 200
    assert got[2].text_sha256 == hashlib.sha256(b"same text").hexdigest()


def test_toxicity_separates_what_it_did_not_see(spark):
    folder = "/root/testdata/sf0.01"
    scores = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, folder).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    for r in scores.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.score, labels[i]) for i, r in scores.items() if r.held_out and i in labels]
    toxic, fine = [s for s, t in held if t == 1], [s for s, t in held if t == 0]
    auc = np.mean([(a > b) + (a == b) / 2 for a in toxic for b in fine])
    assert auc > 0.9
    assert sum(s >= 0.5 for s in fine) <= 0.03 * len(fine)


NAIVE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def naive_spans(text):
    def good(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
            return 13 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return [(k, *m.span()) for k, p in NAIVE.items() for m in p.finditer(text) if good(k, m[0])]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "a", "@", ".", "b-", "1", "23", "456", " ", "-", "+", "(", ")", "_d@e.f", "255", "4111111111111111", "é", "\n"]), max_size=25))
def test_base_spans(parts):
    assert pii.base_spans("".join(parts)) == naive_spans("".join(parts))


def test_pii_whole_table(spark, plain):
    got = {r.doc_id: r for r in QUERIES["op3_pii"](spark, FOLDER).collect()}
    assert len(got) == len(plain)
    for i, text, _ in plain:
        spans = naive_spans(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % s for s in spans).encode()).hexdigest()
        assert got[i].n_email == sum(s[0] == "email" for s in spans)


def test_pii_terms_that_tell(spark):
    rows = [(i, f"common words here {'zorro' if i < 3 else 'other'} {'a@b.cc' if i < 3 else 'nothing'} and common words") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = pii.find_pii(df, reach=2)
    spans = {r.doc_id: [(s.kind, rows[r.doc_id][1][s.start : s.end]) for s in r.spans] for r in found.collect()}
    assert spans[0] == spans[1] == [("email", "a@b.cc"), ("term", "zorro")] and spans[5] == []
    clean = {r.doc_id: r.text for r in pii.sanitise(df, found).collect()}
    assert clean[0] == "common words here [word] [email] and common words" and clean[5] == rows[5][1]


def test_templates_catch_other_parameters(spark):
    bench = [(1, "If Anna buys 12 apples for 3 euros each and Anna sells 12 of them how much money does she keep"), (2, "short item"), (3, None)]
    docs = [
        (10, "Intro. " + bench[0][1] + " the end"),
        (11, "If Peter buys 40 apples for 7 dollars each and Peter sells 40 of them how much money does she keep"),
        (12, "If Peter buys 40 apples for 7 dollars each and Mary sells 40 of them how much money does she keep"),
        (13, "nothing of the kind is in here"), (14, None),
    ]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id, r.same_slots == r.slots) for r in got} == {(10, 1, True), (11, 1, False)}


def test_decontaminate_finds_the_verbatim_passages(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: " ".join(r.text.split()) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    items = {r.item_id: " ".join(r.text.split()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op4_decontaminate"](spark, folder).collect()}
    assert want and got == want


def test_packing_round_trip(spark, docs, plain):
    encode = packing.encoder("/opt/tokenizers/byte_bpe_50k.tiktoken")
    got = defaultdict(dict)
    rows = packing.pack_tokens(docs, row=256, batch_tokens=20_000).collect()
    assert len({r.pack for r in rows}) == len(rows)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and set(ids[r.n_tokens :].tolist()) <= {50256}
        assert r.position_resets == r.cu_seqlens[:-1]
        where = packing.positions(r.cu_seqlens, 256)
        assert all(where[a] == 0 and where[b - 1] == b - 1 - a for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]))
        for a, b, doc, at in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.doc_offsets):
            got[doc][at] = ids[a:b].tolist()
    for i, text, _ in plain:
        assert encode.decode([x for at in sorted(got[i]) for x in got[i][at]]) == text
    assert sum(r.n_tokens for r in rows) > 0.9 * 256 * len(rows)


@given(st.lists(st.integers(1, 30), max_size=40))
def test_best_fit_takes_the_tightest_row(lengths):
    rows = packing.best_fit(lengths, 30)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
    rooms, plain_rows = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(room, k) for k, room in enumerate(rooms) if room >= lengths[i]]
        k = min(fits)[1] if fits else len(rooms)
        if not fits:
            rooms.append(30), plain_rows.append([])
        rooms[k] -= lengths[i]
        plain_rows[k].append(i)
    assert len(rows) == len(plain_rows) and all(sum(lengths[i] for i in r) <= 30 for r in rows)
    assert Counter(30 - sum(lengths[i] for i in r) for r in rows) == Counter(rooms)


def brute_components(plain, k, percent):
    sets = {}
    for i, text, _ in plain:
        w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    lead = {i: i for i in sets}

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            m = len(sets[a] & sets[b])
            if m and 100 * m >= percent * (len(sets[a]) + len(sets[b]) - m):
                lo, hi = sorted((find(a), find(b)))
                lead[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("frequent", "block"), [(64, 1024), (1, 4)])
def test_jaccard_join(spark, frequent, block):
    """Few words and many near copies; with ``frequent`` 1 nearly all signatures are combinations, with ``block`` 4 clusters are cut."""
    rng = np.random.default_rng(3)
    plain = []
    for i in range(240):
        words = [f"w{x}" for x in np.random.default_rng(i // 30).integers(0, 60, 20 + 10 * (i // 30))]
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, len(words)))] = f"n{rng.integers(0, 40)}"
        plain.append((i, " ".join(words), None))
    df = spark.createDataFrame([(i, t) for i, t, _ in plain], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(df, words=3, percent=80, frequent=frequent, block=block).collect()}
    assert got == brute_components(plain, 3, 80)
    assert 8 < len({c for _, c in got.values()}) < 240


def test_suffix_dedup(spark, docs, plain):
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    first, cut = {}, 0
    for i, text, _ in plain:
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 49):
            if first.setdefault(data[p : p + 50], i) < i:
                gone[p : p + 50] = True
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = int(np.sum(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(data), int(gone.sum()), spans)
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()
        cut += int(gone.sum())
    assert cut


def test_banded_distance(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(800):
        a = "".join(rng.choice(list("abcé"), int(rng.integers(0, 9))))
        b = list(a)
        for _ in range(int(rng.integers(0, 4))):
            k = int(rng.integers(0, len(b) + 1))
            b[k : k + int(rng.integers(0, 2))] = list(rng.choice(list("abcé"), int(rng.integers(0, 2))))
        rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "x string, y string")
    for k in (1, 2, 3):
        for r in df.select(line_dedup.banded_distance(F.col("x"), F.col("y"), k).alias("d"), F.levenshtein("x", "y").alias("l")).collect():
            assert r.d == (r.l if r.l <= k else None)


def test_kept_lines_make_the_text(spark):
    rows = [(1, "a first line that is long\n\nshort\nshort"), (2, "a first line that is lung\nshort\nits own line, long enough")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = line_dedup.line_dedup(df)
    assert {r.doc_id: (r.n_lines, r.n_exact, r.n_near) for r in found.collect()} == {1: (4, 1, 0), 2: (3, 1, 1)}
    assert {r.doc_id: r.text for r in line_dedup.kept_texts(df, found).collect()} == {1: "a first line that is long\n\nshort", 2: "its own line, long enough"}


def brute_targets(sizes):
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(sources)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in sources if s not in full]
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in open_) for s in sources}
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(spark, docs, plain):
    rows = [(r.doc_id, r.text, None if r.source == "src1" else "tiny" if r.doc_id == 7 else r.source) for r in docs.collect()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix_sources(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(df).collect()))
    source = {i: s for i, _, s in rows}
    words = {i: len(WORDS.findall(t or "")) for i, t, _ in rows}
    sizes = Counter()
    for i, s in source.items():
        sizes[s] += words[i]
    want, taken, most = brute_targets(sizes), Counter(), Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.size == words[r.doc_id] and r.source_size == sizes[s] and math.isclose(r.target, want[s]) and r.taken == r.copies * r.size
        assert 0 <= r.copies <= 3
        taken[s] += r.taken
        most[s] = max(most[s], r.size)
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= most[s] for s in want)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_feistel_permutes(spark, n):
    got = spark.range(n).select(sharding.feistel(F.col("id"), n, 5).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))
    if n == 1000:
        assert [r.p for r in got] != list(range(n)) and [r.p for r in got] != [r.p for r in spark.range(n).select(sharding.feistel(F.col("id"), n, 6).alias("p")).collect()]


def test_sharding(spark, docs, plain):
    got = QUERIES["op10_sharding"](spark, FOLDER).collect()
    slots = defaultdict(list)
    text = {i: t for i, t, _ in plain}
    for r in got:
        assert r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, QUERIES["op10_sharding"](spark, FOLDER).collect()))


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names, kept = [], None
    for name, stage in pipeline.STAGES[:-1]:
        out = pipeline.written(stage(spark, docs, "/root/testdata/sf0.01"), "test")
        assert out.columns == docs.columns
        if name in ("toxicity", "near duplicates", "decontamination"):
            assert 0.75 * docs.count() < out.count() < docs.count()
        if name == "near duplicates":
            before = sorted((r.doc_id, r.text or "", None) for r in docs.collect())
            assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in brute_components(before, 5, 80).items() if i == c}
        names.append(name)
        docs, kept = out, out
    final = pipeline.STAGES[-1][1](spark, docs, "")
    assert final.count() == kept.count() and names == ["toxicity", "near duplicates", "decontamination", "mixing"]


def test_toxicity_keeps_words_apart_whatever_their_number(spark, monkeypatch):
    # A mark of toxic texts, and an ordinary word that has the same 20 leading bits of its hash.
    pool = [f"w{i}" for i in range(3000)]
    hashes = toxicity.words(*toxicity.text_bytes(pa.array([" ".join(pool)])))[0] >> np.uint64(44)
    order = np.argsort(hashes, kind="stable")
    k = int(np.flatnonzero(hashes[order][1:] == hashes[order][:-1])[0])
    bad, fine = pool[order[k]], pool[order[k + 1]]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        rows.append((i, f"v{i % 7} {bad if toxic else fine} v{i % 5} v{i % 11} {bad if toxic else fine}"))
        labels.append((i, 1, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    counted = toxicity.learn(docs, known)
    one = {r.row.text: r.ratio for r in counted.ratios(spark.createDataFrame([(1, bad), (2, fine)], "doc_id bigint, text string")).collect()}
    assert one[bad] > 2 and one[fine] < -2

    folder = "/root/testdata/sf0.01"
    docs, known = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    memory = {r.doc_id: r for r in toxicity.score_toxicity(docs, known).collect()}
    monkeypatch.setattr(toxicity, "BROADCAST_EVIDENCE", 0)
    joined = {r.doc_id: r for r in toxicity.score_toxicity(docs, known).collect()}
    assert memory.keys() == joined.keys()
    for i, r in memory.items():
        assert (r.ratio, r.window_ratio, r.score) == pytest.approx((joined[i].ratio, joined[i].window_ratio, joined[i].score), abs=1e-3)


def test_decontaminate_finds_items_of_few_plain_words(spark):
    bench = [
        (1, "What is 17 + 25?"), (2, "WHO WROTE THE NOVEL WAR AND PEACE IN RUSSIA LONG AGO"), (3, "Name Paris"), (4, "水在摄氏多少度时会沸腾成为水蒸气"),
        (5, "In 1815 Wellington met Napoleon near Brussels on 18 June with 68 thousand men"),
    ]
    docs = [(10 + i, f"before it, {text} and after it") for i, text in bench] + [(20, "What is 18 + 25? Name London"), (21, "水在这里")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(10 + i, i) for i, _ in bench}


def test_decontaminate_keeps_a_long_passage_with_one_other_name(spark):
    bench = [(1, "Anna walked slowly along the river and thought about the long letter that her brother had sent while Anna was ill at home")]
    text = bench[0][1]
    docs = [(10, text), (11, "Peter" + text[4:]), (12, text.replace("Anna was", "Peter was")), (13, "Anna walked fast and thought about a letter that her brother had sent while Peter was ill")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string")).collect()
    assert {r.doc_id for r in got} == {10, 11, 12}


def test_pii_terms_of_an_entity_in_one_document(spark):
    common = "common words that stand in all of these texts and say nothing"
    rows = [(i, f"{common} other") for i in range(60)] + [(60, f"Zebulon {common} a@b.cc and more words"), (61, f"zorro {common} c@d.ee"), (62, f"zorro {common} c@d.ee")]
    found = pii.find_pii(spark.createDataFrame(rows + [(63, "more words and other"), (64, "more and"), (65, "more")], "doc_id bigint, text string"))
    spans = {r.doc_id: [(s.kind, rows[r.doc_id][1][s.start : s.end]) for s in r.spans] for r in found.collect() if r.doc_id < 63}
    assert spans[60] == [("email", "a@b.cc"), ("term", "Zebulon")] and spans[61] == spans[62] == [("email", "c@d.ee"), ("term", "zorro")]
    assert not any(spans[i] for i in range(60))


def edit_distance(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        row, last = [i], row
        for j, d in enumerate(y, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return row[-1]


def test_lines_of_as_many_edits_as_their_length_allows(spark):
    """Planted lines of 0 to 5 edits and all lengths, against all pairs."""
    rng = np.random.default_rng(5)
    lines = []
    for _ in range(60):
        base = "".join(rng.choice(list("abcdé f"), int(rng.integers(14, 90)))).strip() + "x"
        for _ in range(3):
            x = list(base)
            for _ in range(int(rng.integers(0, 6))):
                k = int(rng.integers(0, len(x) + 1))
                x[k : k + int(rng.integers(0, 2))] = list(rng.choice(list("abc"), int(rng.integers(0, 2))))
            lines.append("".join(x))
    rows = [(i, "\n".join(lines[i::40])) for i in range(40)]
    found = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    order = [(i, at, line) for i, text in rows for at, line in enumerate(text.split("\n"))]
    gone, seen, kinds = set(), {}, Counter()
    for i, at, line in order:
        if line in seen:
            gone.add((i, at))
            continue
        for other in seen:
            n = min(len(line), len(other))
            edits = edit_distance(line, other)
            if n >= 16 and edits <= min(3, max(1, n // 20)):
                gone.add((i, at))
                kinds[edits] += 1
        seen[line] = i
    assert {(r.doc_id, at) for r in found for at in range(r.n_lines) if at not in r.kept_lines} == gone
    assert min(kinds[1], kinds[2], kinds[3]) > 2


def test_cells_join_what_all_pairs_join(spark):
    """Groups over the size of a cell, whose members hang together by chains only, or not at all."""
    rng = np.random.default_rng(8)
    values = {i: int(x) for i, x in enumerate(rng.integers(0, 1500, 300))}
    groups = [(1, i) for i in range(0, 200)] + [(2, i) for i in range(150, 300)] + [(3, i) for i in (5, 250)] + [(4, 7)]

    def link(rows, edges):
        ids, x = rows.column("id").to_numpy(), rows.column("x").to_numpy()
        return np.concatenate([blocks.NONE, *(blocks.joined(ids[a:b], abs(x[a:b, None] - x[None, a:b]) <= 5) for a, b in zip(edges[:-1], edges[1:], strict=True))])

    members, payload = spark.createDataFrame(groups, "group bigint, id bigint"), spark.createDataFrame(list(values.items()), "id bigint, x bigint")
    links = [(r.a, r.b) for r in blocks.compared(members, payload, link, block=16).collect()]

    def parts(pairs):
        lead = {i: i for i in values}

        def find(i):
            while lead[i] != i:
                i = lead[i]
            return i

        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            lead[b] = a
        return [find(i) for i in values]

    asked = [(a, b) for g in (1, 2, 3) for x, a in enumerate([i for k, i in groups if k == g]) for b in [i for k, i in groups if k == g][x + 1 :] if abs(values[a] - values[b]) <= 5]
    assert parts(links) == parts(asked) and 20 < len(set(parts(asked))) < 290


@pytest.mark.parametrize("block", [512, 8])
def test_hyperminhash_links(spark, block):
    """Texts of 1 to 900 words with a few changes, many of them near the threshold; with ``block`` 8 groups are cut to cells."""
    rng = np.random.default_rng(7)
    plain = []
    for i in range(260):
        family = i // 13
        words = [f"w{x}" for x in np.random.default_rng(family).integers(0, 5000, [3, 9, 12, 20, 35, 60, 120, 300, 500, 900][family % 10])]
        for _ in range(int(rng.integers(0, 1 + max(1, len(words) // 40)))):
            words[int(rng.integers(0, len(words)))] = f"n{rng.integers(0, 40)}"
        plain.append((i, " ".join(words), None))
    df = spark.createDataFrame([(i, t) for i, t, _ in plain], "doc_id bigint, text string")
    got = {r.doc_id: r for r in hyperminhash.near_duplicates(df, block=block).collect()}
    want = brute_components(plain, 5, 85)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want and all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert 30 < len({c for _, c in want.values()}) < 240


def test_hyperminhash_estimates(spark):
    """The estimate of sets of known similarity, and of sets that share nothing, collisions taken off."""
    rng = np.random.default_rng(11)
    hashed = lambda n: rng.integers(0, 2**63, n, dtype=np.int64).view(np.uint64)
    errors = []
    for share in (0.0, 0.5, 0.85, 0.95):
        for n in (200, 2000, 20000):
            common, union = hashed(int(n * share)), n
            own = np.array_split(hashed(union - len(common)), 2)
            sets = [np.unique(np.concatenate((common, x))) for x in own]
            near, read = hyperminhash.estimates(np.stack([hyperminhash.registers(s) for s in sets]), np.array([len(s) for s in sets]))
            errors.append(abs(near[0, 1] - share) / max(0.005, math.sqrt(share * (1 - share) / read[0, 1])))
    assert max(errors) < 4
    assert [int(x) >> 10 for x in hyperminhash.compress(np.array([1 << 63, 1 << 62, 1, 0], np.uint64))] == [0, 1, 63, 63]


def brute_negatives(rows, anchors, positives=5, negatives=10):
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for i, label, v in rows:
        if not anchors(i):
            continue
        scored = [(-dot(v, w), j, m) for j, m, w in rows if j != i]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            near = sorted(x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)[:negatives]
            out += [(i, p, k, j, -s, -n) for k, (n, j, _) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize(("dims", "rows", "spread"), [(2, 3000, 300), (8, 900, 40), (4, 400, 3)])
def test_hard_negatives(spark, dims, rows, spread):
    """Few dimensions, where the lists cut much; small numbers, where all ties; labels of very unequal size."""
    rng = np.random.default_rng(dims)
    table = [(int(i), int(rng.integers(0, 3) if i % 3 else 0), [float(x) for x in rng.normal(0, spread, dims).round()]) for i in range(rows)]
    df = spark.createDataFrame(table, "vec_id bigint, label int, embedding array<double>")
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 40 == 0, scale=1.0, block_rows=200, block_anchors=7)
    want = brute_negatives([(i, m, [int(x) for x in v]) for i, m, v in table], lambda i: i % 40 == 0)
    assert sorted(tuple(r) for r in got.collect()) == want and want


def test_focus_ranges_cut_and_keep(monkeypatch):
    """The coordinate lists leave out most rows of a bucket where vectors are of few dimensions, and never one of the result."""
    rng, seen = np.random.default_rng(1), []
    rows, anchors = rng.integers(-500, 500, (4000, 3)), rng.integers(-500, 500, (20, 3))
    real = hard_negatives._products
    monkeypatch.setattr(hard_negatives, "_products", lambda a, b: seen.append(len(a)) or real(a, b))
    low, high = np.full((20, 1), 150_000), np.full((20, 1), hard_negatives.MOST - 1)
    best = hard_negatives.best_rows(np.arange(4000), np.zeros(4000, int), rows, np.arange(5000, 5020), np.ones(20, int), anchors, low.copy(), high, False, 5)
    for i in range(20):
        scores = sorted(((-int(s), j) for j, s in enumerate(rows @ anchors[i]) if s >= 150_000))[:5]
        mine = best.band == i
        assert sorted(zip((-best.score[mine]).tolist(), best.row[mine].tolist(), strict=True)) == scores
    assert sum(n for n in seen if n < 1024) < 20 * 4000 / 2


def test_scores_beyond_doubles():
    big = np.array([[2**31, 3], [2**31, -5]])
    a, b = hard_negatives._exact(big, big)
    assert hard_negatives._products(a, b.T).tolist() == [[2**62 + 9, 2**62 - 15], [2**62 - 15, 2**62 + 25]]
    huge = np.array([[2**62, 2**62]])
    assert hard_negatives._products(*(x.T if k else x for k, x in enumerate(hard_negatives._exact(huge, huge)))).tolist() == [[2**63 - 1]]


def brute_collocations(rows, least=30, inside=80, first=2000):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    counts[lang, tuple(words[i : i + m])] += 1
    out = []
    for lang in total:
        kept = {p: a for (g, p), a in counts.items() if g == lang and len(p) > 1 and a >= least}
        scored = []
        for p, a in kept.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in kept.items()):
                continue
            cuts = [(2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
        out += [(lang, n, x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0]) for n, x in enumerate(sorted(scored)[:first], 1)]
    return sorted(out)


def test_collocations(spark, docs):
    rows = [(r.lang, r.text) for r in docs.collect()] + [(None, "New York, new york! NEW\tYork"), ("und", "new york new york"), ("xx", None), ("", "a b a b")]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = collocations.collocations(df, least=5, first=300)
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, least=5, first=300)


def test_fingerprints_that_collide(spark, monkeypatch):
    """With 3 bits per fingerprint all phrases collide: the words' own bytes keep them apart."""
    monkeypatch.setattr(collocations, "mix", lambda x: x & np.uint64(7))
    rows = [("en", "red apple and green apple and red pear " * 3), ("de", "roter apfel red apple " * 4)]
    langs = {"en": np.uint64(1), "de": np.uint64(2)}
    data, offsets = toxicity.text_bytes(pa.array([t for _, t in rows]))
    found = collocations.Phrases(data, offsets, np.array([langs[g] for g, _ in rows], np.uint64))
    exact, spoken = collocations._exact_words(found), found.text
    words = [data[a:b].tobytes() for a, b in zip(found.starts, found.ends, strict=True)]
    for size in (1, 2, 3):
        at, prints = found.prints(size)
        first, counts = collocations.distinct_phrases(at, prints, exact, size, spoken)
        want = Counter((int(spoken[a]), tuple(words[a : a + size])) for a in at)
        assert Counter({(int(spoken[a]), tuple(words[a : a + size])): int(n) for a, n in zip(first, counts, strict=True)}) == want


def test_decontaminate_whatever_the_case_and_the_spelling_of_values(spark):
    item = "If Anna buys 12 apples for 3 euros each and Anna sells 12 of them how much money does she keep"
    docs = [
        (10, item), (11, item.upper()), (12, item.lower()), (13, item.replace("Anna", "Anna Maria")), (14, item.replace("12", "twelve")),
        (15, item.replace("Anna", "Peter").replace("12", "40").upper()), (16, "so " + item.replace("Anna", "Jean Luc").replace("12", "forty").replace("3", "7")),
        (17, "he buys 12 apples for 3 euros each and that is all there is to say"), (18, item.replace("sells 12", "sells eleven")),
    ]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    assert {r.doc_id for r in got} == {10, 11, 12, 13, 14, 15, 16}


def test_lines_of_a_few_lengths_share_their_keys(spark):
    """Near lines on both sides of the lengths where segments change, and few keys for a line of three edits."""
    base = "".join(np.random.default_rng(9).choice(list("abcdefgh "), 200))
    lines = [base[:n] + "#" for n in (59, 61, 62, 64, 79, 81, 82, 94, 95, 97, 126, 128, 130)]
    rows = [(i, x) for i, x in enumerate(lines)]
    found = {r.doc_id: r.n_near for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {i: int(any(edit_distance(x, y) <= min(3, max(1, len(y) // 20)) for y in lines[:i])) for i, x in rows}
    one = spark.createDataFrame([(1, base, 0)], "id bigint, line string, marks bigint")
    assert line_dedup.index_keys(one, 20, 3).count() == 4 and line_dedup.probe_keys(one, 20, 3, 16).count() <= 26 - 8


def test_lines_of_a_large_group_make_few_pairs(spark, monkeypatch):
    """Lines that share most of their text, none near another, and lines that are all near each other: what is verified follows their number."""
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghiklmnoprstu"), 6)) for _ in range(40)]
    apart = []
    for i in range(300):
        x = list(words)
        for k in rng.choice(40, 3, replace=False):
            x[k] += "".join(rng.choice(list("bcdfgklmprst"), 6))
        apart.append(" ".join(x))
    base = "".join(rng.choice(list("uvwxyz "), 120))
    alike = [f"{base[:k]}{c}{base[k + 1 :]}" for k in range(1, 119) for c in "qj"]
    lines = [x for pair in zip(apart, alike, strict=False) for x in pair] + apart[len(alike) :]
    verified = []
    plain = line_dedup.banded_distance

    def seen(x, y, edits):
        verified.append(spark.sparkContext.accumulator(0))
        count = F.udf(lambda v, n=verified[-1]: n.add(1) or v, "string")
        return plain(count(x), y, edits)

    monkeypatch.setattr(line_dedup, "banded_distance", seen)
    found = line_dedup.line_dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string"))
    near = {r.doc_id for r in found.collect() if r.n_near}
    want = {i for i, x in enumerate(lines) if any(abs(len(x) - len(y)) <= 3 and sum(map(str.__ne__, x, y)) <= 3 for y in lines[:i] if (x in alike) == (y in alike) and len(x) == len(y))}
    assert near == want and len(near) >= len(alike) - 1
    assert sum(n.value for n in verified) < 10 * len(lines)


def test_lines_of_the_same_words_in_other_places_make_few_pairs(spark, monkeypatch):
    """Lines of one text whose outer words change places: they share their inner segments and all letter counts, and none is near another."""
    rng = np.random.default_rng(13)
    words = ["".join(rng.choice(list("abcdefghiklmnoprstu"), 6)) for _ in range(40)]
    lines = []
    for p in range(10):
        for q in range(30, 40):
            x = list(words)
            x[p], x[q] = x[q], x[p]
            lines.append(" ".join(x))
    verified = spark.sparkContext.accumulator(0)
    plain = line_dedup.banded_distance
    count = F.udf(lambda v: verified.add(1) or v, "string")
    monkeypatch.setattr(line_dedup, "banded_distance", lambda x, y, edits: plain(count(x), y, edits))
    found = line_dedup.line_dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")).collect()
    assert sum(r.n_near for r in found) == 0
    assert verified.value < 5 * len(lines)


def test_a_line_stands_under_few_keys(spark):
    """Eight substrings for a line of three edits, its own four segments among them."""
    base = "".join(np.random.default_rng(9).choice(list("abcdefgh "), 200))
    one = spark.createDataFrame([(1, base)], "id bigint, line string")
    keys = line_dedup.probe_keys(one, 20, 3, 16)
    assert keys.count() == 8
    assert {r.key for r in keys.where("own").collect()} == {r.key for r in line_dedup.index_keys(one, 20, 3).collect()}


def test_near_lines_may_be_near_by_their_marks(spark):
    """Whatever the edits and the length are, near lines are never told apart by their marks."""
    rng = np.random.default_rng(17)
    rows = []
    for n in [*range(16, 68), *range(76, 84), *range(92, 100), *range(124, 132), *range(252, 260)] * 6:
        a = list(rng.choice(list("abcdé etaoin"), n))
        b = list(a)
        for _ in range(min(3, max(1, n // 20))):
            k, kind = int(rng.integers(0, len(b))), int(rng.integers(0, 3))
            b[k : k + (kind != 1)] = list(rng.choice(list("abcdé etaoin"), int(kind != 0)))
        x, y = sorted(("".join(a), "".join(b)), key=len)
        if len(x) >= 16 and edit_distance(x, y) <= min(3, max(1, len(x) // 20)):
            rows.append((x, y))
    df = spark.createDataFrame(rows, "x string, y string").select("x", line_dedup.line_marks(F.col("x"), 20, 3).alias("a"), line_dedup.line_marks(F.col("y"), 20, 3).alias("b"))
    may = line_dedup.may_be_near(F.col("a"), F.col("b"), line_dedup.allowed(F.length("x"), 20, 3))
    assert len(rows) > 400 and df.where(may).count() == len(rows)


def test_toxicity_reads_its_evidence_in_slices(spark, monkeypatch):
    folder = "/root/testdata/sf0.01"
    docs, known = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    memory = {r.doc_id: r for r in toxicity.score_toxicity(docs, known).collect()}
    monkeypatch.setattr(toxicity, "BROADCAST_EVIDENCE", 0)
    monkeypatch.setattr(toxicity, "SLICE", 1_000)
    scorer = toxicity.learn(docs, known)
    assert len(scorer.model.rows) > 5
    rows = scorer.ratios(docs.select("doc_id", "text"))
    # The words meet the evidence where the texts are read: nothing of the documents is shuffled or written.
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    for r in rows.select("row.doc_id", "ratio", "window_ratio").collect():
        assert (r.ratio, r.window_ratio) == pytest.approx((memory[r.doc_id].ratio, memory[r.doc_id].window_ratio), abs=1e-6)


def test_toxicity_packs_its_counts():
    rng = np.random.default_rng(7)
    before = np.sort(rng.integers(0, 200, 1000).astype(np.uint64))
    rows = (before, rng.integers(0, 2**63, 1000).astype(np.uint64), rng.integers(0, 20, 1000), rng.integers(0, 20, 1000))
    rows[2][:2] = 300, 70_000
    data = toxicity._packed(*rows)
    assert all((x == y).all() for x, y in zip(toxicity._unpacked(data), rows, strict=True))
    few = toxicity._packed(*rows[:2], rows[2] % 15, rows[3] % 15)
    assert len(few) < 12 * 1000  # 20 bytes as rows of a shuffle
    # One place for a pair, whichever task finds it.
    texts_of = [["a b c", "the a b", "the q"], ["the a b c"]]
    places = {}
    common = toxicity.pair_keys(*toxicity.text_bytes(pa.array(["the the"])))[1][1][:1]
    for texts in texts_of:
        batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([1] + [0] * (len(texts) - 1))], names=["text", "toxic"])
        for out in toxicity._counts(1000, common)(iter([batch])):
            for place, level, data in zip(*(out.column(i).to_pylist() for i in range(3)), strict=True):
                for left, key, toxic, ordinary in zip(*toxicity._unpacked(data), strict=True):
                    place_of, t, o = places.get((level, left, key), (place, 0, 0))
                    assert place_of == place
                    places[level, left, key] = place, t + toxic, o + ordinary
    # the q, start a, the a, start the, b c, a b.
    assert sorted((t, o) for (level, *_), (_, t, o) in places.items() if level == 0) == [(0, 1), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1)]


def test_a_sieve_is_small_and_lets_little_through(spark):
    from catalogfuse.llm.common import SIEVE, sifted

    keys = spark.range(0, 300_000).select(F.when(F.col("id") != 7, F.col("id")).alias("k"))
    rows = spark.range(0, 2_300_000).select(F.when(F.col("id") != 7, F.col("id")).alias("k"))
    inside, outside = sifted(rows, "k", keys), sifted(rows, "k", keys, outside=True)
    # All keys, and of the other two million few; inside and outside are all rows once.
    assert inside.where("k < 300000 or k is null").count() == 300_000 and outside.where("k < 300000 or k is null").isEmpty()
    assert inside.count() < 400_000 and inside.count() + outside.count() == 2_300_000
    assert inside.columns == rows.columns
    many = sifted(spark.range(10).withColumnRenamed("id", "k"), "k", spark.range(1_000_000).withColumnRenamed("id", "k"))
    many.collect()
    plan, sent = many._jdf.queryExecution().executedPlan().toString(), SIEVE // 64
    assert "bit_or" in plan and sent <= 1 << 18
