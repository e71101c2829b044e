"""Near duplicates by HyperMinHash sketches.

A set of shingles is dealt to registers by hash; of the least hash in a register only its count of leading zeros and the
``MANTISSA`` bits after its first one are kept, 16 bits in all. Bands of ``ROWS`` registers are the keys under which sets meet. Sets
that meet compare their registers: the share of equal ones, less the collisions that two bits patterns of different
hashes are expected to have, estimates the Jaccard similarity. What may reach the threshold is confirmed on the full sets.

Registers suffice for all sizes: at a similarity of 0.85 two sets miss each other in all 50 bands of 6 registers with
probability (1 - 0.85 ** 6) ** 50, about 5e-11, and the estimate has to be six standard deviations too low to drop a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogfuse.llm.blocks import NONE, Linker, compared, joined, text_linker
from catalogfuse.llm.common import dropped, query, sifted, table, texts, written
from catalogfuse.llm.components import components
from catalogfuse.llm.hashing import U, mix, shingle_sets, slices, text_bytes
from catalogfuse.plans.sieve import sieve

ROWS, BANDS, MANTISSA = 6, 50, 10
REGISTERS = ROWS * BANDS
EMPTY = 0xFFFF
DEVIATIONS = 6
FIRST = 10  # bands that are met first


def compress(least: np.ndarray) -> np.ndarray:
    """64-bit hashes as leading zeros (6 bits) and the MANTISSA bits after the first one."""
    zeros = np.full(len(least), 63, U)
    rest = least.copy()
    count = np.zeros(len(least), U)
    for step in (32, 16, 8, 4, 2, 1):
        short = rest < (U(1) << U(64 - step))
        rest[short] <<= U(step)
        count[short] += U(step)
    zeros = np.minimum(zeros, count)
    return (zeros << U(MANTISSA) | rest >> U(63 - MANTISSA) & U((1 << MANTISSA) - 1)).astype(np.uint16)


def registers(tokens: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes."""
    out = np.full(REGISTERS, EMPTY, np.uint16)
    if len(tokens):
        place = (mix(tokens ^ U(0xC2B2AE3D27D4EB4F)) % U(REGISTERS)).astype(np.int64)
        least = np.full(REGISTERS, 2**64 - 1, U)
        np.minimum.at(least, place, mix(tokens ^ U(0x165667B19E3779F9)))
        held = np.zeros(REGISTERS, bool)
        held[place] = True
        out[held] = compress(least[held])
    return out


def estimates(sketches: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of all pairs of sketches, and how many registers each is read from.

    A register whose least elements differ looks equal where both fall into one pattern. A pattern's width is 2 ** -MANTISSA
    of its power of two, on average 1 / (2 ln 2) of the value; with sets of n and m elements that is met with the
    probability 2 ** -MANTISSA / (2 ln 2) * n * m / (n + m) ** 2.
    """
    held = sketches != EMPTY
    equal = np.empty((len(sketches), len(sketches)), np.int64)
    for at in range(0, len(sketches), 16):
        some = slice(at, at + 16)
        equal[some] = ((sketches[some, None] == sketches[None]) & held[some, None]).sum(axis=2)
    solid = held.astype(np.float32)
    both = np.rint(solid @ solid.T).astype(np.int64)
    either = held.sum(axis=1)[:, None] + held.sum(axis=1)[None, :] - both
    n, m = sizes[:, None].astype(float), sizes[None, :].astype(float)
    chance = 2.0**-MANTISSA / (2 * np.log(2)) * n * m / np.maximum(n + m, 1) ** 2
    corrected = np.maximum(0, (equal - both * chance) / (1 - chance))
    return corrected / np.maximum(either, 1), either


def sketch_linker(percent: int) -> Linker:
    """Links between sketches (columns registers, n) that may belong to sets that similar."""

    least = percent / 100

    def some(ids: np.ndarray, sketches: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        fits = 100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :])
        if len(ids) == 2 and not fits[0, 1]:
            return NONE
        near, read = estimates(sketches, sizes)
        return joined(ids, fits & (near >= least - DEVIATIONS * np.sqrt(least * (1 - least) / np.maximum(read, 1))))

    def link(rows: pa.Table, edges: list[int]) -> np.ndarray:
        sketches = np.frombuffer(b"".join(rows.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        ids, sizes = rows.column("id").to_numpy(), rows.column("n").to_numpy()
        return np.concatenate([NONE, *(some(ids[a:b], sketches[a:b], sizes[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a > 1)])

    return link


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(*text_bytes(part.column("text")), words)
                # Two independent sums over the tokens tell sets apart.
                d1 = [int(np.sum(mix(s)).view(np.int64)) if len(s) else 0 for s in sets]
                d2 = [int(np.sum(mix(s ^ U(0xA5A5A5A5A5A5A5A5))).view(np.int64)) if len(s) else 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array([registers(s).tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "n", "d1", "d2", "registers"],
                )

    return run


def _bands(first: int, last: int, only=None):
    """(key, id, part, n) for each band from ``first`` to before ``last`` that has a register with an element; of keys in the
    sieve ``only``, without it just (key, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS)[:, first:last]
            keys = np.broadcast_to(np.arange(first, last, dtype=U), found.shape[:2]).copy()
            for r in range(ROWS):
                keys = mix(keys * U(31) + found[:, :, r].astype(U))
            held = (found != EMPTY).any(axis=2)
            row, band = np.nonzero(held if only is None else held & only.value.has(keys))
            names = ["part"] if only is None else ["id", "part", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(keys[row, band].view(np.int64)), *(batch.column(c).take(pa.array(row)) for c in names)], names=["key", *names])

    return run


def _ties(sets: DataFrame, first: int, last: int, percent: int, block: int, tables: str) -> DataFrame:
    """(a, b): links between sketches that meet in some bands. ``sets`` has (id, part, n, registers), where ``part`` tells what is tied already:
    a band under which only one part meets has nothing to add."""
    met = sets.mapInArrow(_bands(first, last), "key bigint, part bigint").groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    met = written(met.where("low <> high").select("key"), tables)
    # Few keys are shared: the others go before they are shuffled.
    rows = sets.mapInArrow(_bands(first, last, sieve(met, "key", 27)), "key bigint, id bigint, part bigint, n bigint").join(met, "key")
    # Sets that can link are of the same window of sizes or of neighbouring ones: each set stands in two.
    level = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * 1.0001))
    rows = written(rows.select("id", "part", F.explode(F.array(F.xxhash64("key", level), F.xxhash64("key", level + 1))).alias("group")), tables)
    # Bands under which the same sets meet are one group: it is told by its size, least member and two sums of its members' hashes.
    kinds = rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("size"), F.min("id").alias("least"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("y"),
        F.min("part").alias("low"), F.max("part").alias("high"),
    )
    groups = kinds.where("low <> high").groupBy("size", "least", "x", "y").agg(F.min("group").alias("group")).select("group")
    members = written(rows.join(groups, "group").select("group", "id").distinct(), tables)
    dropped(rows)
    return compared(members, sets.select("id", "n", "registers"), sketch_linker(percent), block, tables)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 85, block: int = 512, tables: str = "hyperminhash") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct shingles of ``words`` words (lower-cased A-Z); a shorter text is one shingle. Two
    documents link when 100 * intersection >= ``percent`` * union; component_id is the smallest doc_id that links lead to, and
    its document is kept. ``percent`` of 80 and more is what the bands are made for.

    A null, empty or blank text has no shingles (0) and links with nothing, not even its like. Rows without doc_id link with
    nothing, get a null component and are kept. Rows that repeat a doc_id count as one document with the texts of all of them: each row
    keeps its size, all share a component. An empty table gives an empty result; other columns are not read.
    """
    whole = texts(docs)
    sketches = written(whole.mapInArrow(_sketch(words), "doc_id bigint, n bigint, d1 bigint, d2 bigint, registers binary"), tables)
    known = "n > 0 and doc_id is not null"
    # Equal sets are one class, known by its least doc_id. A set that is too small to be near another one takes no part further on.
    classes = written(sketches.where(known).groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("id"), F.first("registers").alias("registers")), tables)
    leads = classes.where(F.col("n") * 100 >= (F.col("n") + 1) * percent).select("id", "n", "registers")
    base = written(sketches.select("doc_id", "n", "d1", "d2"), tables)
    dropped(sketches)
    # Most of what belongs together meets in the first bands. The other bands then have to tie what is apart still.
    early = _ties(leads.withColumn("part", F.col("id")), 0, FIRST, percent, block, tables)
    parts = components(early, tables).withColumnRenamed("component", "part")
    later = written(leads.join(parts, F.col("id") == F.col("node"), "left").select("id", "n", "registers", F.coalesce("part", "id").alias("part")), tables)
    near = early.unionByName(_ties(later, FIRST, BANDS, percent, block, tables))
    clusters = written(components(near, tables).select(F.col("component").alias("group"), F.col("node").alias("id")), tables)
    bodies = sifted(whole.where("doc_id is not null").withColumnRenamed("doc_id", "id"), "id", clusters)
    links = compared(clusters, bodies, text_linker(words, percent), block, tables)
    joins = components(links, tables)
    dropped(later)
    lead = classes.drop("registers").join(joins, F.col("id") == F.col("node"), "left").select("d1", "d2", "n", F.coalesce("component", "id").alias("component_id"))
    lead = base.where(known).join(lead, ["d1", "d2", "n"]).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = base.join(lead, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


@query(
    "op11_near_duplicates",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (
      SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
    n AS (SELECT doc_id, len(sh) AS n FROM s),
    t AS MATERIALIZED (SELECT doc_id, md5_number_lower(unnest(sh)) AS h FROM s),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM t a JOIN t b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
    walk AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT walk.node, links.b FROM walk JOIN links ON links.a = walk.seen)
    SELECT n.doc_id, n.n AS n_shingles, min(seen) AS component_id, n.doc_id = min(seen) AS kept
    FROM n JOIN walk ON walk.node = n.doc_id GROUP BY n.doc_id, n.n
    """,
)
def _query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
