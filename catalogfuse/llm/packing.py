"""Token ids packed into fixed rows by best-fit decreasing.

A task tokenises its documents and packs them in batches of a bounded number of tokens: pieces go by falling length, each
into the row with the least room that still holds it, which a segment tree over the rooms finds in log(row length)
steps. A document longer than a row is split without loss: full rows first, the rest as a piece like any other.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogfuse.llm.common import query, table, texts
from catalogfuse.llm.hashing import slices

# Fixed value: the pattern that splits a text before the vocabulary's merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a file of ranks (base64 bytes and rank on each line), read once per worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class Rooms:
    """Which rooms (free places) rows have: a segment tree of the number of rows per room."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.counts = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def _add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.counts[at] += n
            at >>= 1

    def put(self, room: int, row: int) -> None:
        if room:
            self.rows.setdefault(room, []).append(row)
            self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The row with the least room of at least ``least``, and its room; None if there is none."""
        at = least + self.size
        # Up until a right neighbour holds something, then down its left side.
        if not self.counts[at]:
            while at > 1 and (at & 1 or not self.counts[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.counts[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit(lengths: list[int], row: int) -> list[list[int]]:
    """Rows of places in ``lengths``, none over ``row`` in sum. Equal lengths keep their order."""
    rooms, rows = Rooms(row), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = rooms.take(lengths[i])
        at, room = found if found else (len(rows), row)
        if not found:
            rows.append([])
        rows[at].append(i)
        rooms.put(room - lengths[i], at)
    return rows


OUT = (
    "pack bigint, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<bigint>, doc_offsets array<bigint>, doc_tokens array<bigint>"
)


def _packed(pieces: list[tuple], row: int, pad: int, first: int) -> pa.RecordBatch:
    """``pieces``: (doc_id, offset in the document, tokens of the document, ids)."""
    rows = best_fit([len(p[3]) for p in pieces], row)
    columns = [[] for _ in range(8)]
    for n, members in enumerate(rows):
        ids, borders = np.full(row, pad, np.uint16), [0]
        for i in members:
            part = pieces[i][3]
            ids[borders[-1] : borders[-1] + len(part)] = part
            borders.append(borders[-1] + len(part))
        values = (first + n, borders[-1], ids.tobytes(), borders, borders[:-1], *([pieces[i][k] for i in members] for k in (0, 1, 2)))
        for column, value in zip(columns, values, strict=True):
            column.append(value)
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=re.findall(r"(\w+) [a-z]+(?:<\w+>)?", OUT))


def pack_tokens(
    docs: DataFrame, ranks: str = "/opt/tokenizers/byte_bpe_50k.tiktoken", row: int = 2048, pad: int = 50256, batch_tokens: int = 4_000_000
) -> DataFrame:
    """One row per packed row: pack, n_tokens, ids (``row`` little-endian 16-bit ids, ``pad`` behind the last), cu_seqlens
    (borders of the segments), position_resets (where positions start again at 0), and for each segment its document,
    its offset in the document's tokens and how many those are.

    Every token of every document is in one row once. A text without tokens (null, empty) is in none. Rows without doc_id
    and rows that repeat one are documents of their own, with that id. An empty table gives an empty result.
    ``pack`` numbers the rows in a task; it is unique. Batches of ``batch_tokens`` tokens bound what a task holds; one
    document that is larger is a batch of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pieces, held, made = encoder(ranks), [], 0, 0
        for batch in batches:
            for part in slices(batch):
                owners = part.column("doc_id").to_pylist()
                for owner, ids in zip(owners, encode.encode_ordinary_batch(part.column("text").to_pylist(), num_threads=1), strict=True):
                    ids = np.array(ids, np.uint16)
                    pieces += [(owner, at, len(ids), ids[at : at + row]) for at in range(0, len(ids), row)]
                    held += len(ids)
                    if held >= batch_tokens:
                        out = _packed(pieces, row, pad, made)
                        pieces, held, made = [], 0, made + out.num_rows
                        yield out
        if pieces:
            yield _packed(pieces, row, pad, made)

    packed = texts(docs).mapInArrow(run, OUT)
    return packed.withColumn("pack", F.shiftleft(F.spark_partition_id().cast("bigint"), 40) + F.col("pack"))


def positions(cu_seqlens: list[int], row: int) -> np.ndarray:
    """Position ids of a packed row: each segment counts from 0, and so does the padding."""
    out = np.arange(row)
    for a, b in zip(cu_seqlens, [*cu_seqlens[1:], row], strict=True):
        out[a:b] -= a
    return out


def write_packed(packed: DataFrame, folder: str) -> None:
    """The packed rows as Parquet in a folder that all executors share: ids as binary rows of equal length."""
    packed.write.parquet(folder)


@query("op5_packing")
def _query(spark, sf_dir):
    return pack_tokens(table(spark, sf_dir, "documents"))
