"""Personal data: patterns, and terms that give away what the patterns found.

Base spans are e-mail and IP addresses, card and phone numbers. Then information theory decides on the other words of
their documents: how much of a protected entity's information a term discloses is their pointwise mutual information, estimated from
document counts of the whole corpus, over the entity's own information,

    log(N * n(term, entity) / (n(term) * n(entity))) / log(N / n(entity)).

A term that discloses at least ``threshold`` of it is a span of its own; ``sanitise`` removes the entities and
generalises those terms.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogfuse.llm.common import query, sifted, table, texts, written
from catalogfuse.llm.hashing import slices, text_bytes, words

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Led by the signs: the local part is what runs up to one, so no start is tried twice."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        domain, start = _DOMAIN.match(text, at + 1), at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if domain and start < at:
            last = domain.end()
            out.append((start, last))
        at = text.find("@", max(last, at + 1))
    return out


def _octets(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))


def _luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(found: str) -> str:
    return "".join(c for c in found if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; leftmost matches that don't overlap, those that fail a check dropped."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m[0])]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _others(text: str, spans: list[tuple[str, int, int]], reach: int | None) -> list[tuple[int, int]]:
    """(start, end) of the words that touch no span; with ``reach``, of so many on either side of each span only."""
    found = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in found]
    taken = sorted((a, b) for _, a, b in spans)
    first, ends = [a for a, _ in taken], []
    for _, b in taken:
        ends.append(max(b, ends[-1]) if ends else b)
    places = range(len(found))
    if reach is not None:
        places = sorted({k for a, b in taken for low, high in [(bisect_left(starts, a), bisect_left(starts, b))] for k in (*range(max(0, low - reach), low), *range(high, min(high + reach, len(found))))})
    out = []
    for s, e in (found[k] for k in places):
        k = bisect_left(first, e)
        if k == 0 or ends[k - 1] <= s:
            out.append((s, e))
    return out


def _hashes(values: list[str]) -> np.ndarray:
    """A hash for each value; white space in it becomes a mark, so that it is one word."""
    joined = pa.array([v.translate(_MARK) for v in values], pa.large_string())
    return words(*text_bytes(joined))[0].view(np.int64)


_MARK = {c: 0xFFFC for c in (0x20, *range(0x09, 0x0E))}
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_TERM = pa.struct([("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
FOUND = (
    "doc_id bigint, mark bigint, spans array<struct<kind:string,start:bigint,end:bigint>>, "
    "entities array<bigint>, others array<struct<term:bigint,start:bigint,end:bigint>>"
)


def _find(reach: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values, ids = part.column("text").to_pylist(), part.column("doc_id").to_pylist()
                spans = [base_spans(t) for t in values]
                others = [_others(t, s, reach) if s else [] for t, s in zip(values, spans, strict=True)]
                entity = iter(_hashes([f"{k}:{t[a:b]}" for t, s in zip(values, spans, strict=True) for k, a, b in s]).tolist())
                term = iter(_hashes([t[a:b] for t, n in zip(values, others, strict=True) for a, b in n]).tolist())
                # Rows that repeat doc_id and text have the same mark.
                marks = [int.from_bytes(hashlib.blake2b(f"{i}:{t}".encode(), digest_size=8).digest(), "big", signed=True) for i, t in zip(ids, values, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(marks, pa.int64()),
                        pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans], pa.list_(_SPAN)),
                        pa.array([sorted({next(entity) for _ in s}) for s in spans], pa.list_(pa.int64())),
                        pa.array([[{"term": next(term), "start": a, "end": b} for a, b in n] for n in others], pa.list_(_TERM)),
                    ],
                    names=["doc_id", "mark", "spans", "entities", "others"],
                )

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts hold each word."""
    for batch in batches:
        for part in slices(batch):
            hashes, _, _, borders = words(*text_bytes(part.column("text")))
            owner = np.repeat(np.arange(part.num_rows), np.diff(borders))
            order = np.lexsort((owner, hashes))
            h, o = hashes[order], owner[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
            terms, n = np.unique(h[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "texts"])


def find_pii(docs: DataFrame, reach: int | None = None, threshold: float = 0.8, support: int = 2, tables: str = "pii") -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end in code points, by kind and start), base kinds first.

    A term is a word (lower-cased A-Z, with its punctuation) of a document that holds an entity; with ``reach``, within so
    many words of one. It is a span where it discloses ``threshold`` of the entity's information. For an entity of several
    documents it has to stand in ``support`` of them at least; one of a single document has no others to ask.

    A null or empty text has no spans. Rows without doc_id, and rows that repeat one, are documents of their own; rows
    that repeat doc_id and text get the same spans. An entity that every document has carries no information and
    discloses none. An empty table gives an empty result.
    """
    whole = texts(docs)
    found = written(whole.mapInArrow(_find(reach), FOUND), tables)
    total = F.lit(float(found.count()))
    holding = found.where(F.size("entities") > 0)
    held = holding.select("mark", F.explode("entities").alias("entity")).distinct()
    held = written(held.join(held.groupBy("entity").agg(F.count(F.lit(1)).alias("holders")), "entity"), tables)
    own = F.log(total / F.col("holders"))
    held = held.where(own > 0)
    words_of = holding.select("mark", F.explode("others.term").alias("term")).distinct()
    texts_with = whole.select("text").mapInArrow(_frequencies, "term bigint, texts bigint").groupBy("term").agg(F.sum("texts").alias("texts"))
    # A term stands with an entity in its holders at most, so one that is too frequent even then discloses none of that document.
    most = held.agg(F.max("holders")).first()[0] or 1
    may = F.log(total / F.col("texts")) >= threshold * own
    rare = words_of.select("term").distinct().join(texts_with, "term").withColumn("holders", F.lit(most)).where(may).drop("holders")
    rare = written(rare, tables)
    candidates = written(sifted(words_of, "term", rare).join(rare, "term"), tables)
    # Alone in its document, an entity is disclosed by a term whatever the entity: no pairs are needed.
    alone = held.where("holders = 1").select("mark", "holders").distinct()
    telling = candidates.join(alone, "mark").where(may).select("mark", "term")
    pairs = candidates.where(F.col("texts") >= support).join(held.where("holders > 1"), "mark").where(may)
    together = pairs.groupBy("entity", "term", "texts", "holders").agg(F.count(F.lit(1)).alias("both"))
    mutual = F.log(total * F.col("both") / (F.col("texts") * F.col("holders")))
    often = together.where((F.col("both") >= support) & (mutual >= threshold * own)).select("entity", "term")
    telling = telling.union(pairs.join(often, ["entity", "term"]).select("mark", "term")).distinct()
    extra = holding.select("mark", F.inline("others")).join(telling, ["mark", "term"]).groupBy(F.col("mark").alias("_mark")).agg(
        F.array_sort(F.collect_set(F.struct(F.lit("term").alias("kind"), "start", "end"))).alias("terms")
    )
    joined = found.join(extra, F.col("mark") == F.col("_mark"), "left")
    return joined.select("doc_id", F.concat("spans", F.coalesce("terms", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))).alias("spans"))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each entity replaced by its kind, and each telling term by what sort of word it is."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start < at:  # inside or across what is gone already
            at = max(at, end)
            continue
        word = text[start:end]
        sort = kind if kind != "term" else "number" if word[:1].isdigit() else "name" if word[:1].isupper() else "word"
        out += [text[at:start], f"[{sort}]"]
        at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id and the sanitised text, for unique doc_ids. A null text comes out empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[(s["kind"], s["start"], s["end"]) for s in row or []] for row in batch.column("spans").to_pylist()]
            clean = [redact(t, s) for t, s in zip(batch.column("text").to_pylist(), spans, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(clean, pa.string())], names=["doc_id", "text"])

    return texts(docs).join(found, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id bigint, text string")


@query("op3_pii")
def _query(spark, sf_dir):
    found = find_pii(table(spark, sf_dir, "documents"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = of(*KINDS[:4])
    counts = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
