"""Comparisons inside groups of any size, in cells of bounded size: links come out, never pairs.

A group of at most ``block`` members is one cell. A larger one is dealt to cells, each with the group's lead, and every cell
links what it can. Members that are joined by then need no comparison among themselves; those outside the group's
largest joined part meet all members of the group, cell by cell. So every pair of a group is either joined already or compared,
and a group of near copies costs its size, not its square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogfuse.llm.common import parts, written
from catalogfuse.llm.components import components
from catalogfuse.llm.hashing import shingle_sets, slices, text_bytes

# A linker gets rows and the borders of the cells in them, and returns (k, 2) ids: links that join all that is linked in each cell.
Linker = Callable[[pa.Table, list[int]], np.ndarray]
NONE = np.zeros((0, 2), np.int64)


def joined(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Of a matrix of links, those that join what is linked: (k, 2) ids, at most one less than there are rows."""
    labels = np.arange(len(ids))
    while True:
        low = np.minimum(labels, np.where(linked, labels[None, :], len(ids)).min(axis=1, initial=len(ids)))
        low = low[low]
        if (low == labels).all():
            break
        labels = low
    moved = np.flatnonzero(labels != np.arange(len(ids)))
    return np.stack((ids[labels[moved]], ids[moved]), axis=1)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of blocks of the sets' incidence matrix."""
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.float32)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    token = np.cumsum(np.concatenate((np.ones(1, bool), flat[1:] != flat[:-1]))) - 1
    shared = np.bincount(token)[token] > 1  # a token of one set overlaps nothing
    owner, token = owner[shared], token[shared]
    token = np.unique(token, return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for at in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, (at, at + width))
        x = np.zeros((len(sets), width), np.float32)
        x[owner[a:b], token[a:b] - at] = 1
        out += x @ x.T
    return out


def set_links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Links between sets with 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets], np.int64)
    both = np.rint(_overlaps(sets)).astype(np.int64)
    return joined(ids, 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both))


def text_linker(words: int, percent: int) -> Linker:
    """Links between texts (column text) whose sets of word shingles are that similar."""

    def link(rows: pa.Table, edges: list[int]) -> np.ndarray:
        ids, sets = rows.column("id").to_numpy(), []
        for batch in rows.select(["text"]).to_batches():
            for part in slices(batch):
                sets += shingle_sets(*text_bytes(part.column("text")), words)
        return np.concatenate([NONE, *(set_links(ids[a:b], sets[a:b], percent) for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a > 1)])

    return link


def _streamed(link: Linker):
    """Whole cells from rows that are sorted by group and cell; a cell may span Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: pa.Table, edges: list[int]) -> pa.RecordBatch:
            found = link(rows, edges)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            group, cell = rows.column("group").to_numpy(), rows.column("cell").to_numpy()
            edges = [0, *(np.flatnonzero((group[1:] != group[:-1]) | (cell[1:] != cell[:-1])) + 1).tolist()]
            if edges[-1]:
                yield out(rows.slice(0, edges[-1]), edges)
            held = rows.slice(edges[-1])
        if held is not None:
            yield out(held, [0, held.num_rows])

    return run


def within(rows: DataFrame, payload: DataFrame, link: Linker) -> DataFrame:
    """(a, b): the links in each cell of (group, cell, id). A cell is held whole, so it has to be of bounded size."""
    # In order of id, the least one leads: groups that share most of their members then give the same links.
    spark = rows.sparkSession
    cells = rows.join(payload, "id").repartition(parts(spark), "group", "cell").sortWithinPartitions("group", "cell", "id")
    return cells.mapInArrow(_streamed(link), "a bigint, b bigint")


def compared(members: DataFrame, payload: DataFrame, link: Linker, block: int = 512, tables: str = "cells") -> DataFrame:
    """(a, b): links that join whatever ``link`` links inside a group.

    ``members``: distinct (group, id). ``payload``: a row per id with what ``link`` reads; the linker must be of pairs, so that
    whether two rows link doesn't depend on the rest of their cell.
    """
    sizes = written(members.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lead")).where("n > 1"), tables)
    large = F.col("n") > block
    count = F.ceil(F.col("n") / block)
    placed = members.join(sizes, "group")
    own = placed.where(~large | (F.col("id") != F.col("lead"))).select("group", "id", F.pmod(F.xxhash64("id"), count).cast("bigint").alias("cell"))
    leads = sizes.where(large).select("group", F.col("lead").alias("id"), F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("cell"))
    links = written(within(own.unionByName(leads), payload, link), tables)
    if sizes.where(large).isEmpty():
        return links
    parts = components(links, tables).select(F.col("node").alias("id"), "component")
    of = written(placed.where(large).join(parts, "id", "left").select("group", "id", "n", F.coalesce("component", "id").alias("component")), tables)
    most = of.groupBy("group", "component").agg(F.count(F.lit(1)).alias("held")).groupBy("group").agg(F.max(F.struct("held", "component")).alias("most"))
    outside = written(of.join(most, "group").where(F.col("component") != F.col("most.component")).select("group", "id", "n"), tables)
    if outside.isEmpty():
        return links
    rest = outside.groupBy("group").agg(F.count(F.lit(1)).alias("m"))
    columns, rows = F.ceil(F.col("n") / block), F.ceil(F.col("m") / block)
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    left = outside.join(rest, "group").select("group", "id", F.pmod(F.xxhash64("id"), rows).alias("i"), F.explode(upto(columns)).alias("j"))
    right = of.join(rest, "group").select("group", "id", F.pmod(F.xxhash64("id"), columns).alias("j"), F.explode(upto(rows)).alias("i"))
    met = left.unionByName(right).select("group", "id", F.xxhash64("i", "j").alias("cell")).distinct()
    return links.unionByName(written(within(met, payload, link), tables))
