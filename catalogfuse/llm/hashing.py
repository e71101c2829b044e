"""Hashes of words, shingles and byte windows for whole Arrow batches, in numpy inside Spark's tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the result depends on every bit of ``x``."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(batch: pa.RecordBatch, text: str = "text", max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no piece but a single longer text has more than ``max_bytes`` of text.

    The arrays that are derived from a piece take up to some 40 bytes per byte of text.
    """
    lengths = np.frombuffer(pc.binary_length(batch.column(text).fill_null("")).cast(pa.int64()).buffers()[1], dtype=np.int64)[: batch.num_rows]
    start, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if size and size + n > max_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column one after the other, and the offsets of its n + 1 borders. Null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word (a run without white space), and the borders of the texts in the words."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, np.zeros(len(offsets), np.int64)
    solid = ~_SPACES[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = offsets[:-1][offsets[:-1] < n]
    first[begins] = solid[begins]  # a text's first byte starts a word whatever stands before it
    starts = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    lengths = ends - starts
    borders = np.searchsorted(starts, offsets)
    if len(starts) == 0:
        return np.zeros(0, U), starts, ends, borders
    chars = (_LOWER[data] if lower else data)[solid].astype(U) + U(1)
    heads = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(chars), dtype=np.int64) - np.repeat(heads, lengths)
    table = mix(np.arange(int(lengths.max()), dtype=U)) | U(1)
    return mix(np.add.reduceat(chars * table[place], heads)), starts, ends, borders


def beginnings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """The hash of each word's first ``size`` bytes (all of a shorter word), in lower case."""
    out, table = np.zeros(len(starts), U), mix(np.arange(size, dtype=U)) | U(1)
    for i in range(size):
        inside = starts + i < ends
        out[inside] += (_LOWER[data[starts[inside] + i]].astype(U) + U(1)) * table[i]
    return mix(out)


def shingles(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each word on; the last k - 1 places have none and hold what is left."""
    out = np.zeros(len(word_hashes), U)
    for i in range(k):
        out[: len(out) - i] = mix(out[: len(out) - i]) + word_hashes[i:]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; a text of fewer words is one shingle, one of none has none."""
    hashes, _, _, borders = words(data, offsets)
    rolled = shingles(hashes, k)
    out = []
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        else:
            out.append(shingles(np.concatenate((hashes[a:b], np.full(1, b - a, U))), b - a + 1)[:1] if b > a else np.zeros(0, U))
    return out


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrays as a list column."""
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64) if flat.dtype == U else flat, kind))


def list_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column of bigint as hashes, and the borders of its rows. Null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(U)
    return flat, np.concatenate(([0], np.cumsum(lengths)))
