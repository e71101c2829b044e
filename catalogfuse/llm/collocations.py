"""Phrase collocations by Rabin-Karp fingerprints.

Every text's bytes and every text's words have prefix polynomials, so that the fingerprint of any phrase is one
subtraction and one product (numpy, whole batches). Spark sums the fingerprints' occurrences, shortest phrases first:
a phrase is counted only where its parts of one word less passed, which a bitmap of fixed size tells; a part that
shares a bit with a frequent one only costs a row. The last scan follows the fingerprints that are frequent to their
places in the texts, compares every occurrence there with the first one of its batch, word by word, and makes strings
of these phrases only. The strings are counted once more, so that no collision of fingerprints reaches a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalogfuse.llm.common import dropped, query, table, written
from catalogfuse.llm.hashing import _LOWER, U, mix, slices, text_bytes

BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 2**64))
LONGEST = 4  # words of a phrase
SLICE = 1 << 20  # bytes of text whose polynomials are held at once
HELD = 1 << 20  # fingerprints that are summed before they leave a task

_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANKS = np.zeros(256, dtype=bool)
_BLANKS[[0x20, 0x09]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64, for i below n."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(max(n, 1 << 16), base, U)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Phrases:
    """The words of a batch of texts in pieces, and the fingerprints of its phrases."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> None:
        """``langs``: a hash of each text's language."""
        n = len(data)
        self.data = _LOWER[data]
        breaks, solid = _BREAKS[data], ~(_BREAKS[data] | _BLANKS[data])
        begins = np.unique(offsets[:-1][offsets[:-1] < n])
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        first[begins] = solid[begins]
        last[:-1] &= ~solid[1:] | first[1:]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        marks = breaks.astype(np.int64)
        marks[begins] += 1
        self.piece = np.cumsum(marks)[self.starts] if n else np.zeros(0, np.int64)
        self.text = np.searchsorted(offsets, self.starts, side="right") - 1
        up, down = _powers(n + 1)
        total = np.concatenate((np.zeros(1, U), np.cumsum((self.data.astype(U) + U(1)) * up[:n])))
        self.words = mix((total[self.ends] - total[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(U))
        self.langs = langs[self.text]
        self.total = np.concatenate((np.zeros(1, U), np.cumsum(self.words * up[: len(self.words)])))

    def prints(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words of the phrases of ``size`` words, and their fingerprints."""
        count = len(self.words) - size + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.piece[:count] == self.piece[size - 1 :])
        rolled = (self.total[at + size] - self.total[at]) * _powers(len(self.words) + 1)[1][at]
        return at, mix(mix(rolled + U(size)) ^ self.langs[at])


class Sieve:
    """A bitmap of the leading bits of fingerprints."""

    def __init__(self, bits: int, blocks: dict[int, bytes]) -> None:
        self.shift = U(64 - bits)
        self.held = np.zeros(1 << (bits - 3), np.uint8)
        for k, block in blocks.items():
            self.held[k * 4096 : k * 4096 + len(block)] = np.frombuffer(block, np.uint8)

    def has(self, prints: np.ndarray) -> np.ndarray:
        place = (prints >> self.shift).astype(np.int64)
        return (self.held[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _sieve(frame: DataFrame, bits: int) -> Sieve:
    """The fingerprints of ``frame`` in 2 ** bits bits: at most 2 ** (bits - 15) rows of 4 kB reach the driver, whatever their number."""
    place = F.shiftrightunsigned("print", 64 - bits) + 1
    rows = frame.groupBy(F.bitmap_bucket_number(place).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("held")).collect()
    return Sieve(bits, {r.block - 1: bytes(r.held) for r in rows})


def _scan(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, Phrases]]:
    for batch in batches:
        for part in slices(batch, max_bytes=most):
            langs = part.column("lang").dictionary_encode()
            seeds = np.array([int(mix(np.frombuffer(str(x).encode() + b"\0" * (8 - len(str(x).encode()) % 8), U)).sum(dtype=U)) for x in langs.dictionary.to_pylist()], U)
            yield part, Phrases(*text_bytes(part.column("text")), seeds[langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, found in _scan(batches):
        at, prints = found.prints(1)
        prints, first, counts = np.unique(prints, return_index=True, return_counts=True)
        lang = part.column("lang").take(pa.array(found.text[at[first]]))
        yield pa.RecordBatch.from_arrays([lang.cast(pa.string()), pa.array(prints.view(np.int64)), pa.array(counts)], names=["lang", "print", "found"])


def _passed(found: Phrases, size: int, shorter) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of ``size`` words whose parts of one word less are in the sieve ``shorter``."""
    at, prints = found.prints(size)
    part, of = found.prints(size - 1)
    frequent = np.zeros(len(found.words) + 1, bool)
    frequent[part] = shorter.has(of)
    keep = frequent[at] & frequent[at + 1]
    return at[keep], prints[keep]


def _count_phrases(size: int, shorter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            prints, counts = np.unique(np.concatenate([np.zeros(0, U), *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(counts)], names=["print", "found"])

        for _, found in _scan(batches):
            held.append(_passed(found, size, shorter.value)[1])
            if sum(map(len, held)) > HELD:
                yield out()
        yield out()

    return run


def _exact_words(found: Phrases) -> np.ndarray:
    """A number for each word, equal for equal bytes only: words of one hash are compared with the first of them."""
    _, first, number = np.unique(found.words, return_index=True, return_inverse=True)
    lead = first[number]
    lengths = found.ends - found.starts
    same = lengths == lengths[lead]
    heads = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(heads, lengths)
    partner = np.minimum(np.repeat(found.starts[lead], lengths) + place, max(len(found.data) - 1, 0))
    differs = found.data[np.repeat(found.starts, lengths) + place] != found.data[partner]
    if len(differs):
        same &= ~np.logical_or.reduceat(differs, heads)
    if not same.all():
        known: dict[bytes, int] = {}
        number = np.array([known.setdefault(found.data[a:b].tobytes(), len(known)) for a, b in zip(found.starts.tolist(), found.ends.tolist(), strict=True)], np.int64)
    return number


def distinct_phrases(at: np.ndarray, prints: np.ndarray, exact: np.ndarray, size: int, text_lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place and the number of occurrences of each phrase. Phrases of one fingerprint are compared word by word."""
    _, first, number, counts = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
    lead = at[first][number]
    same = text_lang[at] == text_lang[lead]
    for k in range(size):
        same &= exact[at + k] == exact[lead + k]
    if same.all():
        return at[first], counts
    rows = np.stack([text_lang[at], *(exact[at + k] for k in range(size))], axis=1)
    _, first, counts = np.unique(rows, axis=0, return_index=True, return_counts=True)
    return at[first], counts


def _write_out(frequent, longest: int):
    """(lang, size, phrase, found) of the phrases whose fingerprints are in the sieve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _scan(batches, 2 * SLICE):
            if not len(found.words):
                continue
            exact = _exact_words(found)
            langs = part.column("lang").dictionary_encode()
            spoken = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[found.text]
            data, starts, ends = found.data.tobytes(), found.starts.tolist(), found.ends.tolist()
            for size in range(1, longest + 1):
                at, prints = found.prints(size)
                keep = frequent.value.has(prints)
                at, counts = distinct_phrases(at[keep], prints[keep], exact, size, spoken)
                phrases = [b" ".join([data[starts[i] : ends[i]] for i in range(a, a + size)]) for a in at.tolist()]
                lang = langs.dictionary.take(pa.array(spoken[at])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(at), size, np.int32)), pa.array(phrases, pa.binary()), pa.array(counts)], names=["lang", "size", "phrase", "found"])

    return run


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = LONGEST, sieve_bits: int = 27, tables: str = "phrases") -> tuple[DataFrame, DataFrame]:
    """Two tables. (lang, size, phrase, found): all phrases of 1 to ``longest`` words that occur ``least`` times in texts of a
    language, with their exact numbers of occurrences. (lang, n): all word occurrences of a language."""
    spark = docs.sparkSession
    spoken = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    often = F.col("found") >= least
    # Batches come summed up, so another hash table per task before the shuffle would only take memory.
    counted = spoken.mapInArrow(_count_words, "lang string, print bigint, found bigint").repartition("print")
    counted = written(counted.groupBy("lang", "print").agg(F.sum("found").alias("found")), tables)
    totals = written(counted.groupBy("lang").agg(F.sum("found").alias("n")), tables)
    levels = [written(counted.where(often).select("print"), tables)]
    dropped(counted)
    for size in range(2, longest + 1):
        sieve = spark.sparkContext.broadcast(_sieve(levels[-1], sieve_bits))
        found = spoken.mapInArrow(_count_phrases(size, sieve), "print bigint, found bigint").repartition("print")
        levels.append(written(found.groupBy("print").agg(F.sum("found").alias("found")).where(often).select("print"), tables))
        sieve.unpersist()
    prints = levels[0]
    for level in levels[1:]:
        prints = prints.unionByName(level)
    sieve = spark.sparkContext.broadcast(_sieve(prints, sieve_bits))
    exact = spoken.mapInArrow(_write_out(sieve, longest), "lang string, size int, phrase binary, found bigint")
    exact = exact.groupBy("lang", "size", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("found").alias("found")).where(often)
    exact = written(exact, tables)
    for level in levels:
        dropped(level)
    return exact, totals


def _whole(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = 30, longest: int = LONGEST, inside: int = 80, first: int = 2000, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``first`` collocations by score, a, phrase.

    Texts are lower-cased (A-Z) and cut into pieces at ``. , ; : ! ?`` and U+000A to U+000D, pieces into words at blanks and
    tabs. A candidate is a phrase of 2 to ``longest`` words that occurs at least ``least`` times (a) in its language. Of its cuts
    into two parts, which occur l and r times, the one of the lowest floor(2000000 * a / (l + r)) counts, of equals the
    first. A candidate inside a longer one that occurs at least ``inside`` percent as often is left out. n: all words of
    the language. Numbers are exact (decimals where products may pass 64 bits).

    A null language is ``und``; a null, empty or blank text has no words; repeated rows and repeated doc_ids are texts of
    their own, since doc_id isn't read. An empty table, or one without frequent phrases, gives no rows. Other columns
    are not read, so their names don't matter.
    """
    counted, totals = frequent_phrases(docs, least, longest, **options)
    parts = F.split("phrase", " ")
    spoken = counted.where("size >= 2").withColumn("words", parts)
    cut = spoken.select("lang", "phrase", F.col("found").alias("a"), "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("tail"))
    cut = cut.join(counted.select("lang", F.col("phrase").alias("head"), F.col("found").alias("l")), ["lang", "head"])
    cut = cut.join(counted.select("lang", F.col("phrase").alias("tail"), F.col("found").alias("r")), ["lang", "tail"])
    cut = cut.withColumn("score", F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # What lies inside longer candidates: the largest of them is enough to judge.
    span = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    within = spoken.where("size > 2").select("lang", "found", F.explode(span).alias("phrase")).groupBy("lang", "phrase").agg(F.max("found").alias("longer"))
    kept = scored.join(within, ["lang", "phrase"], "left").where(F.coalesce(_whole("longer"), F.lit(0)) * 100 < _whole("a") * inside)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    best = kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= first)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


@query(
    "op13_collocations",
    r"""
    WITH pieces AS MATERIALIZED (
      SELECT lang, row_number() OVER () AS piece, piece AS body FROM (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
    w AS MATERIALIZED (SELECT lang, piece, regexp_extract_all(body, '[^\x20\x09]+') AS ws FROM pieces),
    g AS (
      SELECT lang, m AS size, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
      FROM w, range(1, 5) t(m) WHERE len(ws) >= m),
    n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
    f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
    c AS (SELECT lang, phrase, f AS a, size, string_split(phrase, ' ') AS ws FROM f WHERE size >= 2),
    cuts AS (
      SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail
      FROM c, range(1, 4) t(k) WHERE k < size),
    scored AS (
      SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, (2000000 * a::HUGEINT) // (x.f + y.f) AS score
      FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    longer AS (
      SELECT lang, inner_phrase AS phrase, max(a) AS longer FROM (
        SELECT lang, a, unnest(list_transform(range(1, size - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS inner_phrase
        FROM c, range(2, 4) t(m) WHERE m < size) GROUP BY ALL)
    SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, encode(best.phrase)) AS rank, best.phrase, a, l, r, n.n,
           score::BIGINT AS score
    FROM best JOIN n ON n.lang = best.lang LEFT JOIN longer ON longer.lang = best.lang AND longer.phrase = best.phrase
    WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT
    QUALIFY rank <= 2000
    """,
)
def _query(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
