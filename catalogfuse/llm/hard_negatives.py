"""Hard negatives of anchors by inner product, with length buckets and coordinate lists.

Rows lie in buckets of one label and similar length, longest first. Inside a bucket every coordinate of the normalised
vectors has a sorted list. A row can reach an anchor's lower edge only if the angle between both is small enough, so each
coordinate on which the anchor is strong (its focus) gives a range in that list; the rows of all ranges are
verified by exact integer products. The lower edge is the worst of the best rows so far: it rises from bucket to
bucket, and from the first wave of row blocks to the second. Where the ranges keep much of a bucket, the bucket's rows
are verified by one matrix product, which gives the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalogfuse.llm.common import dropped, parts, query, table, written

LEAST, MOST = -(2**63), 2**63 - 1
BUCKET = 1024  # rows of a length bucket
FOCUS = 3  # coordinates that an anchor looks up
WAVE = 16  # one row block of so many is searched first
SLACK = 1e-9  # rounding of angles never drops a row: ranges are this much wider


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of integers as rows; what a shorter list lacks is zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    heads = np.cumsum(lengths) - lengths
    out[row, np.arange(len(flat)) - np.repeat(heads, lengths)] = flat
    return out


def _width(column: pa.ChunkedArray) -> int:
    return max([0, *(int(c.value_lengths().to_numpy(zero_copy_only=False).max()) for c in column.chunks if len(c))])


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as numbers whose products sum up exactly: doubles up to 53 bits, integers up to 63, else Python's."""
    size = a.shape[1] * max([1, *(abs(int(x)) for x in (a.min(initial=0), a.max(initial=0)))]) * max([1, *(abs(int(x)) for x in (b.min(initial=0), b.max(initial=0)))])
    kind = np.float64 if size < 2**53 else np.int64 if size < 2**63 else object
    return a.astype(kind), b.astype(kind)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a @ b
    return np.clip(out, LEAST, MOST).astype(np.int64) if out.dtype == object else out.astype(np.int64)


class _Bests:
    """The best ``k`` rows of each band of each anchor so far, and the score that a row must reach."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int) -> None:
        """``low`` and ``high``: the bands' edges by anchor (rows); a band that isn't there has low > high."""
        self.edge, self.high, self.k = low, high, k
        self.band, self.row, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def least(self) -> np.ndarray:
        return np.where(self.edge <= self.high, self.edge, MOST).min(axis=1)

    def add(self, anchor: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        bands = self.edge.shape[1]
        found = [(self.band, self.row, self.score)]
        for j in range(bands):
            fits = (score >= self.edge[anchor, j]) & (score <= self.high[anchor, j])
            found.append((anchor[fits] * bands + j, row[fits], score[fits]))
        band, row, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((ids[row], ~score, band))  # ~score: descending, without overflow
        band, row, score = band[order], row[order], score[order]
        place = np.arange(len(band)) - np.searchsorted(band, band)
        keep = place < self.k
        self.band, self.row, self.score = band[keep], row[keep], score[keep]
        full = place[keep] == self.k - 1
        self.edge.ravel()[self.band[full]] = np.maximum(self.edge.ravel()[self.band[full]], self.score[full])


def _ranges(unit: np.ndarray, lists: np.ndarray, anchors: np.ndarray, cosine: np.ndarray, focus: int):
    """For each anchor its focus coordinates, the values that are feasible there, and where these lie in the sorted lists."""
    at = np.argpartition(-np.abs(anchors), min(focus, anchors.shape[1]) - 1, axis=1)[:, :focus]
    angle = np.arccos(np.clip(np.take_along_axis(anchors, at, 1), -1, 1))
    turn = np.arccos(np.clip(cosine, -1, 1))[:, None]
    low, high = np.cos(np.minimum(np.pi, angle + turn)) - SLACK, np.cos(np.maximum(0, angle - turn)) + SLACK
    begin, end = np.empty(at.shape, np.int64), np.empty(at.shape, np.int64)
    for c in np.unique(at):
        here = at == c
        values = unit[lists[:, c], c]
        begin[here], end[here] = np.searchsorted(values, low[here], "left"), np.searchsorted(values, high[here], "right")
    return at, low, high, begin, end


def best_rows(ids, labels, rows, anchor_ids, anchor_labels, anchors, low, high, same: bool, k: int, bucket: int = BUCKET, focus: int = FOCUS) -> _Bests:
    """The ``k`` best rows of each band of each anchor, among the rows of the anchor's label (``same``) or of all others."""
    best = _Bests(low, high, k)
    length, reach = np.sqrt((rows.astype(float) ** 2).sum(axis=1)), np.sqrt((anchors.astype(float) ** 2).sum(axis=1))
    exact_rows, exact_anchors = _exact(rows, anchors)
    for label in np.unique(labels):
        mine = np.flatnonzero(labels == label)
        mine = mine[np.argsort(-length[mine], kind="stable")]
        wanted = anchor_labels == label if same else anchor_labels != label
        for start in range(0, len(mine), bucket):
            part = mine[start : start + bucket]
            longest = length[part[0]] * (1 + SLACK)
            edge = best.least()
            asked = np.flatnonzero(wanted & (edge < MOST) & (edge <= reach * longest))
            if not len(asked):
                continue
            cosine = edge[asked] / np.maximum(reach[asked] * longest, 1e-300) - SLACK
            whole = cosine <= 0
            found = []
            if not whole.all():
                unit = rows[part] / np.maximum(length[part], 1e-300)[:, None]
                lists = np.argsort(unit, axis=0, kind="stable")
                pruned = asked[~whole]
                at, floor, roof, begin, end = _ranges(unit, lists, anchors[pruned] / reach[pruned][:, None], cosine[~whole], focus)
                tight = np.argmin(end - begin, axis=1)
                picks = np.arange(len(pruned))
                much = (end - begin)[picks, tight] > len(part) // 4
                for i in np.flatnonzero(~much).tolist():
                    j = tight[i]
                    here = lists[begin[i, j] : end[i, j], at[i, j]]
                    values = unit[here[:, None], at[i]]
                    here = part[here[((values >= floor[i]) & (values <= roof[i])).all(axis=1)]]
                    found.append((np.full(len(here), pruned[i]), here, _products(exact_rows[here], exact_anchors[pruned[i]])))
                asked = np.concatenate((asked[whole], pruned[much]))
            for at in range(0, len(asked), 256):
                some = asked[at : at + 256]
                scores = _products(exact_anchors[some], exact_rows[part].T)
                i, j = np.nonzero(scores >= edge[some][:, None])
                found.append((some[i], part[j], scores[i, j]))
            anchor, row, score = (np.concatenate(x) for x in zip(*found, strict=True))
            other = ids[row] != anchor_ids[anchor]
            best.add(anchor[other], row[other], score[other], ids)
    return best


def _cell(same: bool, k: int):
    kind = pa.schema([("anchor_id", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return kind.empty_table()
        width = max(1, _width(rows.column("vector")), _width(asked.column("vector")))
        ids, labels, anchor_ids, anchor_labels = (t.column(c).to_numpy() for t in (rows, asked) for c in ("vec_id", "label"))
        bands = asked.column("bands").to_pylist()
        most = max(map(len, bands))
        low, high, place = np.ones((len(bands), most), np.int64), np.zeros((len(bands), most), np.int64), np.zeros((len(bands), most), np.int64)
        for i, of in enumerate(bands):
            for j, b in enumerate(of):
                low[i, j], high[i, j], place[i, j] = b["low"], b["high"], b["place"]
        best = best_rows(ids, labels, _matrix(rows.column("vector"), width), anchor_ids, anchor_labels, _matrix(asked.column("vector"), width), low, high, same, k)
        anchor = best.band // most
        return pa.Table.from_arrays([pa.array(anchor_ids[anchor]), pa.array(place.ravel()[best.band].astype(np.int32)), pa.array(ids[best.row]), pa.array(best.score)], schema=kind)

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _search(rows: DataFrame, blocks: int, anchors: DataFrame, bands: DataFrame, homes: DataFrame | None, k: int, deals: int, tables: str) -> DataFrame:
    """(anchor_id, place, vec_id, score, rank): the ``k`` best rows of each band. ``homes``: the blocks that hold an anchor's label,
    for a search among the rows of that label; None for one among all other labels."""

    def wave(where: Column, bands: DataFrame) -> DataFrame:
        asked = bands.groupBy("anchor_id").agg(F.collect_list(F.struct("place", "low", "high")).alias("bands")).join(anchors, "anchor_id")
        asked = asked.join(homes, "label") if homes is not None else asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        asked = asked.where(where).select("block", F.pmod(F.xxhash64("anchor_id"), F.lit(deals)).cast("int").alias("deal"), F.col("anchor_id").alias("vec_id"), "label", "vector", "bands")
        dealt = rows.where(where).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
        met = dealt.groupBy("block", "deal").cogroup(asked.groupBy("block", "deal"))
        return met.applyInArrow(_cell(homes is not None, k), "anchor_id bigint, place int, vec_id bigint, score bigint")

    # The first wave's k-th score is a lower edge for all other blocks: what they send is then of the size of the result.
    first = written(_ranked(wave(F.col("block") % WAVE == 0, bands), k), tables)
    known = first.where(F.col("rank") == k).select("anchor_id", "place", F.col("score").alias("edge"))
    risen = bands.join(known, ["anchor_id", "place"], "left").select("anchor_id", "place", F.greatest("low", "edge").alias("low"), "high")
    return _ranked(first.drop("rank").unionByName(wave(F.col("block") % WAVE != 0, risen)), k)


def hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: float = 256.0,
    block_rows: int = 65536, block_anchors: int = 8192, tables: str = "negatives",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label and embedding; components become floor(``scale`` * x). For each row that ``anchors`` picks
    and each of its ``positives`` best rows of the same label, the first ``negatives`` rows of other labels whose score is between
    ``least`` and ``most`` percent of the positive's. Scores are inner products; ties go to the smaller vec_id. The result is
    exact: no row is left out by an index.

    Rows with a null vec_id or label, a null vector, or any null or non-finite component take no part. A shorter vector
    lacks components, which count as zero; an empty one scores zero. Components and scores beyond 64 bits are held at that border.
    Rows that repeat a vec_id are candidates of their own and never their own anchor's; of several anchor rows of one vec_id the
    one with the least label and vector is the anchor. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    numbers = F.col("embedding").cast("array<double>")
    fine = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null").where(F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), anchors.alias("anchor"), F.transform(numbers, lambda x: F.floor(x * scale)).alias("vector"))
    rows = rows.withColumn("length", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    blocks = max(2 * parts(spark), -(-vectors.count() // block_rows))
    # A range of labels and lengths is one block; equal ones are parted by vec_id, so that no label or vector is one task's.
    rows = rows.repartitionByRange(blocks, "label", F.desc("length"), "vec_id").withColumn("block", F.spark_partition_id())
    rows = written(rows.drop("length"), tables)
    asked = written(rows.where("anchor").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("own")).select(F.col("vec_id").alias("anchor_id"), "own.*"), tables)
    shape = rows.agg(F.max("block").alias("last"), F.count("anchor").alias("n")).first()
    blocks, deals = (shape["last"] if shape["last"] is not None else 0) + 1, max(1, -(-asked.count() // block_anchors))
    rows = rows.drop("anchor")
    homes = written(rows.select("label", "block").distinct(), tables)
    anything = asked.select("anchor_id", F.lit(1).alias("place"), F.lit(LEAST).alias("low"), F.lit(MOST - 1).alias("high"))
    near = written(_search(rows, blocks, asked, anything, homes, positives, deals, tables), tables)
    near = near.select("anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    share = lambda up, percent: F.expr(f"(cast(positive_score as decimal(20,0)) * {percent} + {up}) div 100")
    # A positive below zero has no negatives: its band is empty.
    bands = near.where("positive_score >= 0").select("anchor_id", "place", share(99, least).alias("low"), share(0, most).alias("high"))
    far = _search(rows, blocks, asked, bands, None, negatives, deals, tables)
    return far.join(near, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


@query(
    "op12_hard_negatives",
    """
    WITH v AS MATERIALIZED (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS MATERIALIZED (
      SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10
    """,
)
def _query(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)
