"""A set of 64-bit hashes as a bitmap of bounded size, for rows that are to be dropped before they are shuffled.

Rows whose hash shares a bit with a member pass as well: a join has to follow. However many members there are, a bitmap of
2 ** bits bits comes through the driver as at most 2 ** (bits - 15) rows of 4 kB.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U = np.uint64


def scramble(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x`` (the finaliser of splitmix64)."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Sieve:
    def __init__(self, bits: int, blocks: dict[int, bytes]) -> None:
        self.shift = U(64 - bits)
        self.held = np.zeros(1 << (bits - 3), np.uint8)
        for k, block in blocks.items():
            self.held[k * 4096 : k * 4096 + len(block)] = np.frombuffer(block, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = (hashes >> self.shift).astype(np.int64)
        return (self.held[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def sieve(frame: DataFrame, hashed: Column | str, bits: int = 22) -> Broadcast:
    """The hashes of a column (bigint) as a broadcast :class:`Sieve`."""
    place = F.shiftrightunsigned(hashed, 64 - bits) + 1
    rows = frame.groupBy(F.bitmap_bucket_number(place).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("held"))
    blocks = {r.block - 1: bytes(r.held) for r in rows.collect()}
    return frame.sparkSession.sparkContext.broadcast(Sieve(bits, blocks))
