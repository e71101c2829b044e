"""Repeated byte windows by a depth-limited radix sort of suffixes, most significant digits first.

Suffixes are ordered through ``length`` bytes only, so equal groups are exactly the repeated windows. A pass deals the
suffixes by their next digit and whatever stands alone drops out, so that the deeper digits are made of few:

1. The first digit is the least ``gram`` of a window (by hash; the leftmost of equal ones). Windows that start side
   by side mostly share it, so one record stands for such a run of windows: digit, hash of the run's bytes, least doc_id.
2. Records that agree in the digit and in the bytes are repeats of whole runs. Where the bytes differ, the runs may
   still share windows, and only then
3. the windows of those runs are dealt one by one, by the hash of all their bytes.

Documents are dealt to blocks. A block sends one record for equal runs of its documents and gets back one bit each:
whether a smaller doc_id elsewhere has it. So a passage that all documents share costs one record per block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogfuse.llm.common import parts, query, table, texts
from catalogfuse.llm.hashing import U, mix, slices, text_bytes

GRAM = 24  # a longer first digit makes more records, but fewer that agree in it by chance
BODY = 6  # bytes of a run's hash that travel beside its digit
BASE = U(0x9E3779B97F4A7C15 | 1)
BYTES = mix(np.arange(256, dtype=U) + U(0x1234567))


def _power(n: int) -> np.uint64:
    return U(pow(int(BASE), n, 1 << 64))


def gram_hashes(data: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Polynomial hashes of the ``size`` bytes from each byte on, for each size, by doubling."""
    doubled = {1: BYTES[data]}
    top = 1
    while top * 2 <= max(sizes):
        h = doubled[top]
        doubled[top * 2] = h[:-top] * _power(top) + h[top:] if len(h) > top else np.zeros(0, U)
        top *= 2
    out = []
    for size in sizes:
        h, done = None, 0
        for bit in sorted((b for b in doubled if size & b), reverse=True):
            more = doubled[bit][done:]
            h = more if h is None else h[: len(more)] * _power(bit) + more
            done += bit
        out.append(h[: max(0, len(data) - size + 1)])
    return out


def runs(data: np.ndarray, offsets: np.ndarray, length: int):
    """Runs of windows that share their least gram.

    Returns the text, first window and number of windows of each run, its digit, the hash of its bytes, and the hashes
    of all windows of ``data`` (those that cross texts are in no run).
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, U), np.zeros(0, U), np.zeros(0, U)
    grams, windows = gram_hashes(data, (GRAM, length))
    width = length - GRAM + 1
    # The least of each ``width`` grams and how far it is, by doubling; equal ones: the leftmost.
    value, away, span = (mix(grams) >> U(32)).astype(np.uint32), np.zeros(len(grams), np.uint8), 1
    levels = {1: (value, away)}
    while span * 2 <= width:
        v, d = levels[span]
        right = v[span:] < v[:-span]
        levels[span * 2] = np.where(right, v[span:], v[:-span]), np.where(right, d[span:] + np.uint8(span), d[:-span])
        span *= 2
    v, d = levels[span]
    n = len(windows)
    rest = width - span
    right = v[rest : rest + n] < v[:n]
    away = np.where(right, d[rest : rest + n] + np.uint8(rest), d[:n]) if rest else d[:n]
    owner = np.repeat(np.arange(len(offsets) - 1), np.maximum(np.diff(offsets) - length + 1, 0))
    # Window starts inside a text: each text's first len - length + 1 bytes.
    lengths = np.maximum(np.diff(offsets) - length + 1, 0)
    heads = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    starts = np.arange(len(owner)) - np.repeat(heads, lengths) + np.repeat(offsets[:-1], lengths)
    anchor = starts + away[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    first = starts[at]
    digit = mix(grams[anchor[at]] + U(77))
    body = mix(mix(windows[first]) + windows[first + count - 1] * U(0xD6E8FEB86659FD93) + count.astype(U))
    return owner[at], first, count, digit, body, windows


class Block:
    """A block's documents and the records they make. The order of the records depends on their hashes alone."""

    def __init__(self, docs: pa.Table, length: int, keep: bool = True) -> None:
        """``keep``: the hashes of all windows, 8 bytes a byte, stay for ``window_hashes``."""
        self.ids, self.data, parts_ = [], [], []
        for batch in docs.select(["doc_id", "text"]).combine_chunks().to_batches():
            for piece in slices(batch, max_bytes=1 << 20):
                data, offsets = text_bytes(piece.column("text"))
                owner, first, count, digit, body, windows = runs(data, offsets, length)
                parts_.append((owner + len(self.ids), first - offsets[owner], count, digit, body))
                self.data.append((data, offsets, len(self.ids), windows if keep else None))
                self.ids += piece.column("doc_id").to_pylist()
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U))
        joined = [np.concatenate(x) for x in zip(*(parts_ or [none]), strict=True)]
        self.owner, self.first, self.count, self.digit, self.body = joined
        self.doc = np.array(self.ids, np.int64)[self.owner] if len(self.ids) else np.zeros(0, np.int64)
        # Records: equal (digit, body) once, with the least doc_id.
        order = np.lexsort((self.doc, self.body, self.digit))
        g, c = self.digit[order], self.body[order]
        new = np.ones(len(order), bool)
        new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        self.record = np.empty(len(order), np.int64)
        self.record[order] = np.cumsum(new) - 1
        heads = order[new]
        self.digits, self.bodies, self.least = self.digit[heads], self.body[heads], self.doc[heads]
        # Runs of one digit and different bytes within the block are opened whatever other blocks say.
        self.mixed = np.zeros(len(heads), bool)
        same = self.digits[1:] == self.digits[:-1]
        self.mixed[1:] |= same
        self.mixed[:-1] |= same

    def window_hashes(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window of the chosen runs: the run and the hash."""
        run = np.repeat(chosen, self.count[chosen])
        step = np.arange(len(run)) - np.repeat(np.cumsum(self.count[chosen]) - self.count[chosen], self.count[chosen])
        out = np.zeros(len(run), U)
        for _, offsets, low, windows in self.data:
            inside = (self.owner[run] >= low) & (self.owner[run] < low + len(offsets) - 1)
            r = run[inside]
            out[inside] = windows[offsets[self.owner[r] - low] + self.first[r] + step[inside]]
        return run, mix(out)

    def opened(self, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows of all runs whose record is opened: run, window's place among the distinct ones, and these with their least doc_id."""
        chosen = np.flatnonzero(wide[self.record])
        run, hashes = self.window_hashes(chosen)
        order = np.lexsort((self.doc[run], hashes))
        h = hashes[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        place = np.empty(len(h), np.int64)
        place[order] = np.cumsum(new) - 1
        return run, place, h[new], self.doc[run[order[new]]], hashes


def _deal(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Borders of the buckets in sorted keys: equal ranges of hashes."""
    step = (1 << 64) // buckets
    return np.searchsorted(keys, np.array([min(i * step, (1 << 64) - 1) for i in range(1, buckets)], dtype=U))


SENT = "bucket int, block int, kind int, digits binary, bodies binary, least binary"
BACK = "block int, bucket int, kind int, earlier binary, wide binary"


def _low(digits: np.ndarray) -> bytes:
    """Half of a digit: with the bucket it tells digits apart well enough, as a false match only opens runs."""
    return digits.astype(np.uint32).tobytes()


def _short(bodies: np.ndarray) -> bytes:
    return np.ascontiguousarray(bodies.view(np.uint8).reshape(-1, 8)[:, :BODY]).tobytes()


def _long(short: bytes) -> np.ndarray:
    out = np.zeros((len(short) // BODY, 8), np.uint8)
    out[:, :BODY] = np.frombuffer(short, np.uint8).reshape(-1, BODY)
    return out.view(U).ravel()


def _planes(ids: np.ndarray) -> bytes:
    """Ids byte by byte, all first bytes first: the empty high bytes then compress away in the shuffle."""
    return np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 8).T).tobytes()


def _ids(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _rows(block: int, kind: int, buckets: int, digits: np.ndarray, bodies: np.ndarray | None, least: np.ndarray) -> list[tuple]:
    cuts = [0, *_deal(digits, buckets).tolist(), len(digits)]
    out = []
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            out.append((i, block, kind, _low(digits[a:b]) if bodies is not None else b"", _short(bodies[a:b]) if bodies is not None else digits[a:b].tobytes(), _planes(least[a:b])))
    return out


def _table(rows: list[tuple], names: str, kinds) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in names.split(", ")])


_SENT_KINDS = [pa.int32()] * 3 + [pa.binary()] * 3
_BACK_KINDS = [pa.int32()] * 3 + [pa.binary()] * 2


def _send(length: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        block = Block(docs, length, keep=False)
        return _table(_rows(key[0].as_py(), 0, buckets, block.digits, block.bodies, block.least), SENT, _SENT_KINDS)

    return run


def _judge(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
    """Per bucket: which records of each block occur earlier elsewhere, and which digits have different bytes."""
    rows = sent.to_pylist()
    passed = [(r["block"], key[0].as_py(), 2, r["digits"], r["bodies"]) for r in rows if r["kind"] == 2]
    rows = [r for r in rows if r["kind"] != 2]
    if not rows:
        return _table(passed, BACK, _BACK_KINDS)
    least = np.concatenate([_ids(r["least"]) for r in rows])
    bodies = np.concatenate([_long(r["bodies"]) if r["kind"] == 0 else np.frombuffer(r["bodies"], U) for r in rows])
    digits = np.concatenate([np.frombuffer(r["digits"], np.uint32) for r in rows]) if rows[0]["kind"] == 0 else bodies
    order = np.lexsort((least, bodies, digits))
    g, c, d = digits[order], bodies[order], least[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    earlier = np.empty(len(g), bool)
    earlier[order] = d[first] < d
    digit = np.ones(len(g), bool)
    digit[1:] = g[1:] != g[:-1]
    group = np.cumsum(digit) - 1
    wide = np.empty(len(g), bool)
    wide[order] = (np.bincount(group, weights=new) > 1)[group]
    out, at = passed, 0
    for r in rows:
        n = len(r["least"]) // 8
        out.append((r["block"], key[0].as_py(), r["kind"], np.packbits(earlier[at : at + n]).tobytes(), np.packbits(wide[at : at + n]).tobytes()))
        at += n
    return _table(out, BACK, _BACK_KINDS)


def _bits(back: pa.Table, kind: int, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bits that came back, in the order of the block's records."""
    cuts = [0, *_deal(keys, buckets).tolist(), len(keys)]
    earlier, wide = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    for r in back.to_pylist():
        if r["kind"] == kind:
            a, b = cuts[r["bucket"]], cuts[r["bucket"] + 1]
            earlier[a:b] = np.unpackbits(np.frombuffer(r["earlier"], np.uint8), count=b - a)
            wide[a:b] = np.unpackbits(np.frombuffer(r["wide"], np.uint8), count=b - a)
    return earlier, wide


def _open(length: int, buckets: int):
    """Send the windows of opened runs; what came back for the runs goes along for the last step."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, back: pa.Table) -> pa.Table:
        number = key[0].as_py()
        block = Block(docs, length)
        earlier, wide = _bits(back, 0, block.digits, buckets)
        _, _, hashes, least, _ = block.opened((wide | block.mixed) & ~earlier)
        rows = _rows(number, 1, buckets, hashes, None, least)
        rows.append((number % buckets, number, 2, np.packbits(earlier).tobytes(), np.packbits(wide).tobytes(), b""))
        return _table(rows, SENT, _SENT_KINDS)

    return run


OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(length: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, back: pa.Table) -> pa.Table:
        block = Block(docs, length)
        n = len(block.digits)
        earlier, wide = np.zeros(n, bool), np.zeros(n, bool)
        for r in back.to_pylist():
            if r["kind"] == 2:
                earlier = np.unpackbits(np.frombuffer(r["earlier"], np.uint8), count=n).astype(bool)
                wide = np.unpackbits(np.frombuffer(r["wide"], np.uint8), count=n).astype(bool)
        gone = earlier[block.record] | (block.least[block.record] < block.doc)
        run_of, place, hashes, least, _ = block.opened((wide | block.mixed) & ~earlier)
        before, _ = _bits(back, 1, hashes, buckets)
        window_gone = before[place] | (least[place] < block.doc[run_of])
        step = np.arange(len(run_of)) - np.searchsorted(run_of, run_of) if len(run_of) else run_of
        starts = np.concatenate((block.first[gone], (block.first[run_of] + step)[window_gone]))
        ends = np.concatenate(((block.first + block.count)[gone], (block.first[run_of] + step + 1)[window_gone])) + length - 1
        owner = np.concatenate((block.owner[gone], block.owner[run_of][window_gone]))
        order = np.lexsort((starts, owner))
        owner, starts, ends = owner[order], starts[order], ends[order]
        borders = np.searchsorted(owner, np.arange(len(block.ids) + 1))
        out = []
        for data, offsets, low, _ in block.data:
            for i in range(len(offsets) - 1):
                text = data[offsets[i] : offsets[i + 1]]
                a, b = borders[low + i], borders[low + i + 1]
                spans = _merged(starts[a:b], ends[a:b])
                kept, at = hashlib.sha256(), 0
                for s, e in spans:
                    kept.update(text[at:s])
                    at = e
                kept.update(text[at:])
                out.append((block.ids[low + i], len(text), sum(e - s for s, e in spans), len(spans), kept.hexdigest(), [{"start": s, "end": e} for s, e in spans]))
        return _table(out, "doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans", [pa.int64()] * 4 + [pa.string(), _SPAN])

    return run


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Sorted spans that overlap or touch, as one."""
    if not len(starts):
        return []
    reach = np.maximum.accumulate(ends)
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(starts)) - 1
    return list(zip(starts[new].tolist(), reach[last].tolist(), strict=True))


def suffix_dedup(docs: DataFrame, length: int = 50, blocks: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges that go).

    A byte goes when a string of ``length`` bytes that covers it also starts in a document with a smaller doc_id. Strings
    are compared by 64-bit hashes. A null text is empty; a text below ``length`` bytes loses nothing. Rows without doc_id
    lose nothing and cost nobody anything. Rows that repeat a doc_id are no smaller than each other: both keep what they
    share. An empty table gives an empty result.

    ``length`` is from 25 to 64. ``blocks`` (twice the shuffle partitions unless given) bounds the text that a task holds.
    """
    if not GRAM < length <= 64:
        raise ValueError(f"length must be from {GRAM + 1} to 64")
    buckets = parts(docs.sparkSession)
    blocks = blocks or 2 * buckets
    whole = texts(docs)
    dealt = whole.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"))
    by_block = dealt.groupBy("block")
    runs_back = by_block.applyInArrow(_send(length, buckets), SENT).groupBy("bucket").applyInArrow(_judge, BACK)
    opened = by_block.cogroup(runs_back.groupBy("block")).applyInArrow(_open(length, buckets), SENT)
    back = opened.groupBy("bucket").applyInArrow(_judge, BACK)
    found = by_block.cogroup(back.groupBy("block")).applyInArrow(_cut(length, buckets), OUT)
    lone = whole.where("doc_id is null").select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
    )
    return found.unionByName(lone)


@query("op8_suffix_dedup")
def _query(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents"))
