"""Similarity join of documents on word shingles, by token-combination prefixes.

Two sets whose Jaccard similarity reaches the threshold differ in few tokens. So among the first tokens of each, in
one order for all, they share enough of them: a token of the rare class alone, or ``COMBINE`` tokens of the same part
of the frequent class. Those are the signatures that are indexed. The frequent class consists of the tokens that more
than ``frequent`` sets have among their first tokens; it is cut into parts by hash, so that a document's combinations
stay in proportion to its length, and each part that is met lengthens the prefix.

Why it is complete: let the prefix of a set be its least tokens up to the point where

    rare tokens + sum over the parts of max(0, tokens of the part - (COMBINE - 1))  >  n - ceil(threshold * n)

If two sets share no signature, then of the prefix that ends first the other lacks that many tokens, so the overlap
is below threshold * n. This holds for any order and any classes, as long as all sets use the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalogfuse.llm.blocks import Linker, compared, text_linker, within
from catalogfuse.llm.common import dropped, parts, query, sifted, table, texts, written
from catalogfuse.llm.components import components
from catalogfuse.llm.hashing import U, list_column, mix, shingle_sets, slices, text_bytes

COMBINE = 4  # frequent tokens in a signature: passages that documents share seldom have so many in one part
PART = 3  # what a part adds to the count above, about, where all tokens are frequent


def _allowed(n: int, percent: int) -> int:
    """How many tokens of a set of n a partner may lack."""
    return n - -(-n * percent // 100)


def _levels(n: int, percent: int) -> tuple[int, int]:
    """Size classes: each holds sizes up to 100 / percent times its least. A partner's class is its own or the next."""
    level = int(np.log(n) / np.log(100 / percent) + 1e-9)
    return level, level + 1


def _parts_of(level: int, percent: int) -> int:
    """Parts of the frequent class for sets of a size class, the same for all its sets."""
    size = (100 / percent) ** level
    return max(1, int(size * (100 - percent) / 100 / PART))


TOKEN = 5  # bytes of a token that travel: they name it in signatures; the order is that of all 8
BRIEF = 3  # and those in which two sets' least tokens are compared before the sets themselves


def _short(tokens: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, 8 - size :]).tobytes()


def _tokens(short: bytes, size: int = TOKEN) -> np.ndarray:
    out = np.zeros((len(short) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(short, np.uint8).reshape(-1, size)
    return out.view(U).ravel()


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_tokens(x) for x in batch.column("first").to_pylist()]
        ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), [len(x) for x in found])
        flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(ids)], names=["token", "doc_id"])


def _sketch(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(*text_bytes(part.column("text")), words)
                sizes = [len(s) for s in sets]
                # Two independent sums over the tokens tell sets apart.
                d1 = [int(np.sum(mix(s)).view(np.int64)) if len(s) else 0 for s in sets]
                d2 = [int(np.sum(mix(s ^ U(0xA5A5A5A5A5A5A5A5))).view(np.int64)) if len(s) else 0 for s in sets]
                first, brief = [], []
                for s in sets:
                    n = len(s)
                    most = _parts_of(_levels(n, percent)[1], percent) if n else 0
                    first.append(_short(s[: _allowed(n, percent) + 1 + (COMBINE - 1) * most], TOKEN))
                    brief.append(_short(s[: n * (100 - percent) * 8 // 1000 + 8], BRIEF))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(first, pa.binary()), pa.array(brief, pa.binary())],
                    names=["doc_id", "n", "d1", "d2", "first", "brief"],
                )

    return run


@lru_cache(maxsize=64)
def _choices(n: int) -> np.ndarray:
    """All choices of COMBINE of n places."""
    return np.array(list(combinations(range(n), COMBINE)), np.int64).reshape(-1, COMBINE)


def signatures(first: np.ndarray, common: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of one set, of single tokens and of combinations: ``first`` its least tokens in order, ``common``
    those of the frequent class."""
    need = _allowed(n, percent) + 1
    if len(common) == 0:
        return np.unique(first[:need]), np.zeros(0, U)
    often = np.isin(first, common)
    rare, chosen = [], []
    for level in _levels(n, percent):
        part = np.where(often, (mix(first) % U(_parts_of(level, percent))).astype(np.int64), -1)
        order = np.argsort(part, kind="stable")
        heads = np.searchsorted(part[order], part[order])
        rank = np.empty(len(first), np.int64)
        rank[order] = np.arange(len(first)) - heads
        # The first COMBINE - 1 tokens of a part add nothing yet.
        credit = np.cumsum(~often | (rank >= COMBINE - 1))
        end = int(np.searchsorted(credit, need)) + 1
        rare.append(first[:end][~often[:end]])
        tokens, of = first[:end][often[:end]], part[:end][often[:end]]
        order = np.argsort(of, kind="stable")
        tokens, of = tokens[order], of[order]
        for group in np.split(tokens, np.flatnonzero(np.diff(of)) + 1):
            if len(group) >= COMBINE:
                picked, sig = group[_choices(len(group))], U(level)
                for k in range(COMBINE):
                    sig = mix(sig * U(31) + picked[:, k])
                chosen.append(sig)
    return np.unique(np.concatenate(rare)), np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, U)


def _sign(percent: int, salts: int):
    """(sig, salt, doc_id). A single token has few sets, a combination may have many: those are dealt to ``salts`` parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, cut = list_column(batch.column("common"))
            sizes, firsts, owners = batch.column("n").to_pylist(), batch.column("first").to_pylist(), batch.column("doc_id").to_pylist()
            for at in range(0, len(sizes), 2000):
                rows = range(at, min(at + 2000, len(sizes)))
                found = [signatures(_tokens(firsts[i]), common[cut[i] : cut[i + 1]], sizes[i], percent) for i in rows]
                flat = [x for pair in found for x in pair]
                lengths = [len(x) for x in flat]
                ids = np.repeat(np.repeat(np.array([owners[i] for i in rows], np.int64), 2), lengths)
                many = np.repeat(np.repeat(np.array([sizes[i] for i in rows], np.int64), 2), lengths)
                salt = (mix(ids.view(U)) % U(salts)).astype(np.int32)
                salt[np.repeat(np.tile([True, False], len(found)), lengths)] = -1
                sigs = np.concatenate(flat).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sigs), pa.array(salt), pa.array(ids), pa.array(many)], names=["sig", "salt", "doc_id", "n"])

    return run


def can_link(x: np.ndarray, n: int, y: np.ndarray, m: int, percent: int) -> bool:
    """Whether sets of n and m tokens can link, judged by the least tokens of each, ``x`` and ``y``.

    What one has below the end of both and the other hasn't is a difference for certain. Tokens that look equal in
    BRIEF bytes count as equal.
    """
    end = min(x[-1] if len(x) < n else U(2**64 - 1), y[-1] if len(y) < m else U(2**64 - 1))
    x, y = x[x < end], y[y < end]
    least = -(-percent * (n + m) // (100 + percent))
    return len(x) - np.isin(x, y).sum() <= n - least and len(y) - np.isin(y, x).sum() <= m - least


def brief_linker(percent: int) -> Linker:
    """Links between sets (columns n, brief) that can link by their least tokens. Groups are small: pairs one by one."""

    def link(rows: pa.Table, edges: list[int]) -> np.ndarray:
        ids, sizes = rows.column("id").to_numpy(), rows.column("n").to_pylist()
        briefs = [_tokens(x, BRIEF) for x in rows.column("brief").to_pylist()]
        out = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            lead = list(range(a, b))
            for x in range(a, b):
                for y in range(x + 1, b):
                    fits = 100 * min(sizes[x], sizes[y]) >= percent * max(sizes[x], sizes[y])
                    if fits and lead[x - a] != lead[y - a] and can_link(briefs[x], sizes[x], briefs[y], sizes[y], percent):
                        out.append((ids[x], ids[y]))
                        old, new = lead[y - a], lead[x - a]
                        lead = [new if k == old else k for k in lead]
        return np.array(out, np.int64).reshape(-1, 2)

    return link


def jaccard_join(
    docs: DataFrame, words: int = 5, percent: int = 80, frequent: int = 8, block: int = 512, tables: str = "jaccard"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A document's set holds its distinct shingles of ``words`` words (lower-cased A-Z); a shorter text is one shingle. Two
    documents link when 100 * intersection >= ``percent`` * union; component_id is the smallest doc_id that links lead to.

    Equal sets are one class from the start. The signatures, and for single tokens a comparison of the sets' least tokens,
    tie the classes into candidate clusters. A cluster is compared in cells of about ``block`` classes; what these leave unjoined
    meets all of the cluster (``blocks.compared``), so no task holds more than two blocks and no pair is left out.

    A null, empty or blank text has no shingles (0) and links with nothing, not even its like. Rows without doc_id
    link with nothing and get a null component. Rows that repeat a doc_id count as one document with the texts of all of
    them: each row keeps its size, all share a component. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    whole = texts(docs)
    kind = "doc_id bigint, n bigint, d1 bigint, d2 bigint, first binary, brief binary"
    sketch = written(whole.mapInArrow(_sketch(words, percent), kind), tables)
    known = "n > 0 and doc_id is not null"
    # A class is known by the least doc_id that has its set; documents follow by the digest.
    reps = written(sketch.where(known).groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("doc_id"), F.first("first").alias("first"), F.first("brief").alias("brief")), tables)
    base = written(sketch.select("doc_id", "n", "d1", "d2"), tables)
    dropped(sketch)
    held = base.where(known)
    tokens = reps.select("doc_id", "first").mapInArrow(_explode, "token bigint, doc_id bigint")
    often = written(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") > frequent).select("token"), tables)
    common = written(sifted(tokens, "token", often).join(often, "token").groupBy("doc_id").agg(F.collect_set("token").alias("common")), tables)
    # Sets without a frequent token need no join: most are signed where they are.
    plain = sifted(reps, "doc_id", common, outside=True).select("doc_id", "n", "first", F.array().cast("array<bigint>").alias("common"))
    mixed = sifted(reps.select("doc_id", "n", "first"), "doc_id", common).join(common, "doc_id", "left")
    signed = plain.unionByName(mixed).mapInArrow(_sign(percent, 4 * parts(spark)), "sig bigint, salt int, doc_id bigint, n bigint")
    # Ties lead from a signature's sets to the least of them, in two steps where a signature is salted.
    signed = written(signed, tables)
    # A single token has ``frequent`` sets at most. They are compared among themselves, once for all tokens that the same sets have.
    single = signed.where("salt < 0").groupBy("sig").agg(F.sort_array(F.collect_list("doc_id")).alias("sets")).where(F.size("sets") > 1)
    single = single.select("sets").distinct().select(F.xxhash64("sets").alias("group"), F.lit(0).cast("bigint").alias("cell"), F.explode("sets").alias("id"))
    near = within(single, reps.select(F.col("doc_id").alias("id"), "n", "brief"), brief_linker(percent))
    # A combination ties its sets to the least of them, in two steps as it may have any number.
    several = signed.where("salt >= 0").withColumn("hub", F.min("doc_id").over(W.partitionBy("sig", "salt")))
    hubs = several.where("hub = doc_id").select("sig", "doc_id")
    least = hubs.groupBy("sig").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    upper = hubs.join(least, "sig").where("hub <> doc_id")
    ties = several.where("hub <> doc_id").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))
    ties = ties.unionByName(upper.select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))).unionByName(near)
    clusters = components(ties, tables)
    classes = written(reps.select("d1", "d2", "n", "doc_id"), tables)
    for done in (signed, reps):
        dropped(done)

    cluster = written(clusters.select(F.col("component").alias("group"), F.col("node").alias("id")), tables)
    bodies = sifted(whole.where("doc_id is not null").withColumnRenamed("doc_id", "id"), "id", cluster)
    links = compared(cluster, bodies, text_linker(words, percent), block, tables)
    joined = components(links, tables)
    classes = classes.join(joined, F.col("doc_id") == F.col("node"), "left")
    classes = classes.select("d1", "d2", "n", F.coalesce("component", "doc_id").alias("component_id"))
    lead = held.select("doc_id", "d1", "d2", "n").join(classes, ["d1", "d2", "n"]).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return base.join(lead, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Of each group of documents that links join, the one with the smallest doc_id. Rows without doc_id stay."""
    found = jaccard_join(docs, **options)
    gone = found.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


@query(
    "op6_jaccard_join",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (
      SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
    n AS (SELECT doc_id, len(sh) AS n FROM s),
    t AS MATERIALIZED (SELECT doc_id, md5_number_lower(unnest(sh)) AS h FROM s),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM t a JOIN t b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
    walk AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT walk.node, links.b FROM walk JOIN links ON links.a = walk.seen)
    SELECT n.doc_id, n.n AS n_shingles, min(seen) AS component_id FROM n JOIN walk ON walk.node = n.doc_id GROUP BY n.doc_id, n.n
    """,
)
def _query(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"), words=3, percent=90)
