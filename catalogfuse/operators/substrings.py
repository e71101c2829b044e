"""Dictionary terms anywhere in texts, by their rarest gram.

A gram is a window of eight bytes, held exactly in one integer; a shorter term is its own gram. The dictionary's grams are
counted over all texts, each term keeps the one that occurs least, and only these are looked up: a text yields a row for
each of them that it holds, so a dictionary of rare terms shuffles next to nothing however long the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogfuse.functions.basics import as_col
from catalogfuse.plans.sieve import U, scramble, sieve

GRAM, HEAD = 8, 3
SLICE = 1 << 20  # bytes of text that are unfolded to windows at once


def byte_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of about SLICE bytes of ``_low``, or of one longer text."""
    ends = np.cumsum(pc.binary_length(batch.column("_low")).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The eight bytes from each byte of the texts on, as integers, and where each text ends."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    padded = np.concatenate((data, np.zeros(GRAM, np.uint8)))
    return np.ndarray((len(data),), "<u8", padded, 0, (1,)).astype(U), offsets[1:] - offsets[0]


def _texts(at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each place, and how many of the bytes from there on are its own."""
    row = np.searchsorted(ends, at, side="right")
    return row, ends[row] - at


def _mask(size: int) -> np.uint64:
    return U(2 ** (8 * size) - 1)


def _hash(grams: np.ndarray, size: int) -> np.ndarray:
    return scramble(scramble(grams) + U(size))


def _term_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_t, size, gram, hashed): all windows of a long term, the whole of a short one."""
    names = ["_t", "size", "gram", "hashed"]
    for batch in batches:
        for part in byte_slices(batch):
            grams, ends = _windows(part.column("_low"))
            row, left = _texts(np.arange(len(grams)), ends)
            length = np.bincount(row, minlength=part.num_rows)
            first = np.concatenate((np.ones(1, bool), row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
            for size in range(1, GRAM + 1):
                at = np.flatnonzero((left >= GRAM) & (length[row] >= GRAM) if size == GRAM else first & (length[row] == size))
                found = grams[at] & _mask(size)
                terms = part.column("_low").take(pa.array(row[at]))
                yield pa.RecordBatch.from_arrays([terms, pa.array(np.full(len(at), size, np.int32)), pa.array(found.view(np.int64)), pa.array(_hash(found, size).view(np.int64))], names=names)


def _found(part: pa.RecordBatch, sizes: list[int], heads: Broadcast, held: Broadcast) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size the distinct (text, gram) of the slice that are in the sieve."""
    grams, ends = _windows(part.column("_low"))
    # Of the places, those whose first HEAD bytes begin a gram; all for shorter grams.
    likely = np.flatnonzero(heads.value.has(grams << U(64 - 8 * HEAD)))
    places = {True: (likely, *_texts(likely, ends))}
    for size in sizes:
        if size < HEAD and False not in places:
            places[False] = (np.arange(len(grams)), *_texts(np.arange(len(grams)), ends))
        at, row, left = places[size >= HEAD]
        own = left >= size
        some, text = grams[at[own]] & _mask(size), row[own]
        keep = held.value.has(_hash(some, size))
        some, text = some[keep], text[keep]
        order = np.lexsort((some, text))
        some, text = some[order], text[order]
        new = np.concatenate((np.ones(1, bool), (some[1:] != some[:-1]) | (text[1:] != text[:-1]))) if len(some) else np.zeros(0, bool)
        yield size, text[new], some[new]


def _count(sizes: list[int], heads: Broadcast, held: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch):
                for size, _, grams in _found(part, sizes, heads, held):
                    grams, texts = np.unique(grams, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), size, np.int32)), pa.array(grams.view(np.int64)), pa.array(texts)], names=["size", "gram", "texts"])

    return run


def _lookup(sizes: list[int], heads: Broadcast, held: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch):
                for size, text, grams in _found(part, sizes, heads, held):
                    keys = part.column("_key").take(pa.array(text))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(grams), size, np.int32)), pa.array(grams.view(np.int64))], names=["_key", "size", "gram"])

    return run


def gram_hits(df: DataFrame, terms: DataFrame, text: Column | str, key: str) -> tuple[DataFrame, DataFrame]:
    """(_key, size, gram) of the texts that hold a term's rarest gram, and (_t, size, gram) of the terms that occur at all in grams."""
    lowered = df.select(F.col(key).alias("_key"), F.coalesce(F.lower(as_col(text)), F.lit("")).alias("_low"))
    grams = terms.select(F.lower("term").alias("_low")).distinct().where("_low <> ''").mapInArrow(_term_grams, "_t string, size int, gram bigint, hashed bigint")
    sizes = sorted(r.size for r in grams.select("size").distinct().collect())
    # Only a term longer than a gram has a choice of grams: the others are not counted.
    many = grams.where(F.octet_length("_t") > GRAM)
    counts = lowered.mapInArrow(_count([GRAM], _heads(many), sieve(many, "hashed")), "size int, gram bigint, texts bigint")
    # Read by the sieve, the heads and the result: the texts are counted once.
    counts = counts.groupBy("size", "gram").agg(F.sum("texts").alias("texts")).persist()
    # A term with a gram that no text has is in no text.
    known = many.join(counts, ["size", "gram"], "left").groupBy("_t").agg(
        F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "size", "gram", "hashed")).alias("_g")
    )
    chosen = known.where("_g.texts > 0").select("_t", "_g.size", "_g.gram", "_g.hashed")
    chosen = chosen.unionByName(grams.where(F.octet_length("_t") <= GRAM))
    kind = T.StructType([T.StructField("_key", df.schema[key].dataType), T.StructField("size", T.IntegerType()), T.StructField("gram", T.LongType())])
    return lowered.mapInArrow(_lookup(sizes, _heads(chosen), sieve(chosen, "hashed")), kind), chosen.drop("hashed")


def _heads(grams: DataFrame) -> Broadcast:
    """The first HEAD bytes of the grams, as a bitmap of all such bytes."""
    return sieve(grams.where(F.col("size") >= HEAD), F.shiftleft("gram", 64 - 8 * HEAD), 8 * HEAD)


def substring_terms(df: DataFrame, terms: DataFrame, text: Column | str, key: str) -> DataFrame:
    """(key, ord, term): the terms of ``terms(ord, term)`` that occur anywhere in a text, case ignored; of equal terms the first.

    Only texts that hold the rarest gram of a term longer than a gram are read again, to verify it.
    """
    folded = terms.groupBy(F.lower("term").alias("_t")).agg(F.min(F.struct("ord", "term")).alias("hit")).where("_t <> ''")
    hits, chosen = gram_hits(df, terms, text, key)
    met = hits.join(chosen.join(folded, "_t"), ["size", "gram"]).select("_key", "_t", "hit")
    long = F.octet_length("_t") > GRAM
    texts = df.select(F.col(key).alias("_key"), F.lower(as_col(text)).alias("_low"))
    verified = met.where(long).join(texts, "_key").where(F.col("_low").contains(F.col("_t"))).select("_key", "hit")
    found = met.where(~long).select("_key", "hit").unionByName(verified)
    return found.select(F.col("_key").alias(key), F.col("hit.ord").alias("ord"), F.col("hit.term").alias("term"))
