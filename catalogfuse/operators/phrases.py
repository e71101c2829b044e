"""Dictionary terms as whole words in texts.

Texts and terms are cut into words alike. Inside the tasks the word n-grams of a text, of the lengths that the terms have, are hashed;
only those whose hash is in the sieve of the terms become rows, to be joined to the terms by their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogfuse.functions.basics import as_col
from catalogfuse.operators.substrings import byte_slices
from catalogfuse.plans.sieve import U, scramble, sieve


def worded(text: Column | str) -> Column:
    """The words in small letters, one space between them."""
    return F.trim(F.regexp_replace(F.lower(as_col(text)), "(?U)[^\\w]+", " "))


class _Words:
    """Hash, start, end and text of every word of a slice of ``_low``, and its bytes."""

    def __init__(self, column: pa.Array) -> None:
        column = column.cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        self.data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        solid = self.data != 0x20
        first, last = solid.copy(), solid.copy()
        begins = offsets[:-1][np.diff(offsets) > 0]
        first[1:] &= ~solid[:-1]
        first[begins] = solid[begins]
        last[:-1] &= ~solid[1:] | first[1:]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(offsets, self.starts, side="right") - 1
        lengths = self.ends - self.starts
        heads = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        chars = self.data[solid].astype(U) + U(1)
        place = np.arange(len(chars)) - np.repeat(heads, lengths)
        table = scramble(np.arange(int(lengths.max(initial=0)), dtype=U)) | U(1)
        self.hashes = scramble(np.add.reduceat(chars * table[place], heads)) if len(heads) and len(chars) else np.zeros(0, U)

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``size`` words of one text."""
        at = np.arange(max(0, len(self.starts) - size + 1))
        at = at[self.text[at] == self.text[at + size - 1]]
        out = np.zeros(len(at), U)
        for i in range(size):
            out = scramble(out) + self.hashes[at + i]
        return at, scramble(out + U(size))

    def cut(self, at: np.ndarray, size: int) -> pa.Array:
        whole = self.data.tobytes()
        return pa.array([whole[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at + size - 1].tolist(), strict=True)], pa.binary()).cast(pa.string())


def _hashed(sizes: list[int]):
    """The hash of every term as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch):
                words = _Words(part.column("_low"))
                count = np.bincount(words.text, minlength=part.num_rows)
                for size in sizes:
                    at, hashes = words.grams(size)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[count[words.text[at]] == size].view(np.int64))], names=["hashed"])

    return run


def _lookup(sizes: list[int], held: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch):
                words = _Words(part.column("_low"))
                for size in sizes:
                    at, hashes = words.grams(size)
                    keep = held.value.has(hashes)
                    at, hashes = at[keep], hashes[keep]
                    order = np.lexsort((hashes, words.text[at]))
                    at, hashes = at[order], hashes[order]
                    text = words.text[at]
                    new = np.ones(len(at), bool)
                    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
                    yield pa.RecordBatch.from_arrays([part.column("_key").take(pa.array(text[new])), words.cut(at[new], size)], names=["_key", "_t"])

    return run


def phrase_terms(df: DataFrame, terms: DataFrame, text: Column | str, key: str) -> DataFrame:
    """(key, ord, term): the terms of ``terms(ord, term)`` whose words stand in a text one after the other; of equal terms the first."""
    folded = terms.groupBy(worded("term").alias("_t")).agg(F.min(F.struct("ord", "term")).alias("hit")).where("_t <> ''")
    sizes = sorted(r.n for r in folded.select(F.size(F.split("_t", " ")).alias("n")).distinct().collect())
    held = sieve(folded.select(F.col("_t").alias("_low")).mapInArrow(_hashed(sizes), "hashed bigint"), "hashed")
    lowered = df.select(F.col(key).alias("_key"), F.coalesce(worded(text), F.lit("")).alias("_low"))
    kind = T.StructType([T.StructField("_key", df.schema[key].dataType), T.StructField("_t", T.StringType())])
    found = lowered.mapInArrow(_lookup(sizes, held), kind).join(folded, "_t")
    return found.select(F.col("_key").alias(key), F.col("hit.ord").alias("ord"), F.col("hit.term").alias("term"))
