"""Near-duplicate lines by a segment-partition edit join.

How many edits two lines may be apart follows the shorter one's length. Cut that line into so many segments and one more,
and at least one of them is intact in the longer line, at nearly the same place. The sizes of the segments follow from the length
rounded down, and the former half of them is placed from the line's start, the latter from its end: lines of a few lengths share
their segments, and few edits can move one, so a line stands under few substrings. Of the lines that meet any other, those that are near none of the first under their keys meet all before them; pairs
are verified by the edit distance up to the limit. Nothing but JVM expressions runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogfuse.llm.common import parts, query, sifted, table, texts, written


def allowed(length: Column, per: int, most: int) -> Column:
    """Edits that a line of a length may differ by: one per ``per`` characters, at least one and at most ``most``."""
    return F.least(F.lit(most), F.greatest(F.lit(1), F.floor(length / per).cast("int")))


def rounded(length: Column) -> Column:
    """The length without its digits but the first three, in binary: at least four fifths of it."""
    step = F.call_function("shiftleft", F.lit(1), F.greatest(F.lit(0), F.length(F.bin(length.cast("bigint"))) - 3))
    return length - F.pmod(length, step)


def moves(edits: int, less: int, number: int) -> range:
    """How far segment ``number``, counted from 0, may have moved in a line that is ``less`` characters longer, against its own end.

    Of the segments, the first that has no more edits up to its end than its number is intact: it has so many edits to its left and the
    others to its right, so it moves by no more than these allow against either end.
    """
    against = 0 if _from_start(edits, number) else less
    return range(max(-number, less - (edits - number)) - against, min(number, less + (edits - number)) + 1 - against)


def _from_start(edits, number):
    """Whether a segment, one of ``edits`` + 1, is placed from the start of a line; the others are from the end. Numbers or columns."""
    return number * 2 <= edits


def probes(most: int) -> list[tuple[int, int, int, int, int]]:
    """(edits, less, number, move, before): what a line looks up. ``before`` is the next smaller ``less`` that asks for the same, or -1."""
    found = []
    for edits in range(1, most + 1):
        for less in range(edits + 1):
            for number in range(edits + 1):
                for move in moves(edits, less, number):
                    before = max((k for k in range(less) if move in moves(edits, k, number)), default=-1)
                    found.append((edits, less, number, move, before))
    return found


def _key(base: Column, edits: Column, number: Column, line: Column, move: Column, length: Column | None = None) -> Column:
    """48 bits for a segment of a line, or for the substring ``move`` characters off its place; null outside of the line."""
    size = F.floor(base / (edits + 1)).cast("int")
    from_end = F.length(line) - (edits - number + 1) * size
    start = F.when(_from_start(edits, number), number * size).otherwise(from_end) + move
    of = [base, edits, number] if length is None else [length, edits, number]
    hashed = F.xxhash64(*of, F.substring(line, start + 1, size)).bitwiseAND(F.lit((1 << 48) - 1))
    return F.when((start >= 0) & (start + size <= F.length(line)), hashed)


def index_keys(lines: DataFrame, per: int, most: int, exact: bool = False) -> DataFrame:
    """(key, a, edits): a row for each segment of the lines(id, line). ``exact`` keys are of one length each."""
    own = lines.withColumns({"edits": allowed(F.length("line"), per, most), "base": rounded(F.length("line"))})
    cut = own.select("*", F.explode(F.sequence(F.lit(0), "edits")).alias("number"))
    key = _key(F.col("base"), F.col("edits"), F.col("number"), F.col("line"), F.lit(0), F.length("line") if exact else None)
    return cut.select(key.alias("key"), F.col("id").alias("a"), "edits")


def probe_keys(lines: DataFrame, per: int, most: int, least: int, exact: bool = False) -> DataFrame:
    """(key, b, own): under what the lines may stand that are up to as many characters shorter as their own length allows.

    ``own`` are the keys that ``index_keys`` has of the line itself.
    """
    names = ("edits", "less", "number", "move", "before")
    asked = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, p, strict=True)]) for p in probes(most)])
    cut = lines.select("id", "line", F.inline(asked))
    length = F.length("line") - F.col("less")
    nearer = F.length("line") - F.col("before")
    again = (F.col("before") >= 0) & (rounded(nearer) == rounded(length)) & (allowed(nearer, per, most) == F.col("edits"))
    cut = cut.where((length >= least) & (allowed(length, per, most) == F.col("edits")) & (F.lit(exact) | ~again))
    key = _key(rounded(length), F.col("edits"), F.col("number"), F.col("line"), F.col("move"), length if exact else None)
    own = (F.col("less") == 0) & (F.col("move") == 0)
    return cut.select(key.alias("key"), F.col("id").alias("b"), own.alias("own")).where("key is not null")


# The white space of lines of white space.
WHITE = " \t\n\x0b\x0c\r"

# The letters that are counted, two bits each, and the cuts of a line, in parts of its length rounded down.
COUNTED = " etaoinsrhdlucmf"
CUTS = (1 / 4, 1 / 2, 3 / 4)
# Four counts on a ring: the bits in which two of them differ are as many as the steps between them.
RING = (0b00, 0b01, 0b11, 0b10)


def marks(line: Column) -> Column:
    """32 bits: how often each letter of COUNTED is there, modulo four."""
    counts = [F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit(""))) for c in COUNTED]
    coded = [F.element_at(F.array(*[F.lit(x << 2 * k).cast("bigint") for x in RING]), n % 4 + 1) for k, n in enumerate(counts)]
    return reduce(lambda p, q: p.bitwiseOR(q), coded)


def line_marks(line: Column, per: int, most: int) -> Column:
    """What ``may_be_near`` compares: for each cut, the marks of what is before it and of what is behind it, counted from the end.

    Where the shorter lines that may be near are cut elsewhere, the marks for their cuts follow.
    """
    length = F.length(line)
    cuts, shorter = rounded(length), rounded(length - allowed(length, per, most))
    ends = []
    for base in (cuts, shorter):
        for cut in CUTS:
            before, behind = F.floor(base * cut).cast("int"), F.floor(base * (1 - cut)).cast("int")
            ends += [F.substring(line, F.lit(1), before), F.substring(line, length - behind + 1, behind)]
    texts_of = F.when(cuts == shorter, F.array(*ends[: 2 * len(CUTS)])).otherwise(F.array(*ends))
    return F.struct(cuts.alias("cuts"), shorter.alias("shorter"), F.transform(texts_of, marks).alias("of"))


def may_be_near(a: Column, b: Column, edits: Column) -> Column:
    """By the marks of their ends, lines a and b, not shorter, can be that near.

    An edit is before a cut or behind it, and changes two counts of that end by one at most: those of two letters, or that of a letter
    and of another which moves across the cut.
    """
    def few(at: int) -> Column:
        apart = [F.bit_count(F.get(a["of"], F.lit(k)).bitwiseXOR(F.get(b["of"], F.lit(at + k)))) for k in range(2 * len(CUTS))]
        return reduce(lambda p, q: p & q, [x + y <= 2 * edits for x, y in zip(apart[::2], apart[1::2], strict=True)])

    return F.when(a["cuts"] == b["cuts"], few(0)).when(a["cuts"] == b["shorter"], few(2 * len(CUTS))).otherwise(True)


def banded_distance(x: Column, y: Column, edits: Column | int) -> Column:
    """The edit distance of two texts if it is at most ``edits``, else null."""
    return F.nullif(F.call_function("levenshtein", x, y, edits if isinstance(edits, Column) else F.lit(edits)), F.lit(-1))


def _meeting(keys: DataFrame) -> DataFrame:
    """(id): the lines of keys(key, b, own) that stand under a key with another line, as the own key of one of the two; no pairs."""
    under = Window.partitionBy("key")
    own = F.when(F.col("own"), F.col("b"))
    ends = {"least": F.min("b"), "last": F.max("b"), "own_least": F.min(own), "own_last": F.max(own)}
    seen = keys.withColumns({name: end.over(under) for name, end in ends.items()})
    met = (F.col("own") & (F.col("least") != F.col("last"))) | (F.col("own_least") != F.col("b")) | (F.col("own_last") != F.col("b"))
    return seen.where(met).select(F.col("b").alias("id"))


def _near_lines(held: DataFrame, per: int, most: int, least: int, tables: str) -> DataFrame:
    """(first): the places of those lines(first, id, line, marks) that are near one before them.

    A line meets the first one under each of its keys. Only lines that are near none of these meet all that stand before
    them, so that a group whose lines are all near each other costs its size.
    """
    texts_of = held.select("id", "line")

    def verified(pairs: DataFrame) -> DataFrame:
        # Pairs are few bytes and much work: dealt to as many tasks as there are parts.
        dealt = pairs.distinct().repartition(parts(held.sparkSession), "a", "b")
        both = dealt.join(texts_of.toDF("a", "x"), "a").join(texts_of.toDF("b", "y"), "b")
        return both.where(banded_distance(F.col("x"), F.col("y"), F.col("edits")).isNotNull()).select("first").distinct()

    whole = held.select(F.struct("first", "id", "marks", F.length("line").alias("n")).alias("id"), "line")
    own = index_keys(whole, per, most)
    heads = own.groupBy("key").agg(F.min("a").alias("head"))
    may = (F.col("a.id") != F.col("head.id")) & may_be_near(F.col("a.marks"), F.col("head.marks"), F.col("edits"))
    to_head = own.join(heads, "key").where(may)
    done = written(verified(to_head.select(F.col("a.first").alias("first"), F.col("a.id").alias("a"), F.col("head.id").alias("b"), "edits")), tables)

    left = whole.join(done, F.col("id.first") == done["first"], "left_anti")
    may = (F.col("a.id") != F.col("b.id")) & may_be_near(F.col("a.marks"), F.col("b.marks"), F.col("edits"))
    # Lines of one length stand on both sides: the second of these joins finds them.
    later_short = index_keys(left, per, most, True).join(probe_keys(whole, per, most, least, True), "key")
    later_short = later_short.where(may & (F.col("a.n") < F.col("b.n")) & (F.col("b.first") <= F.col("a.first")))
    later_long = index_keys(whole, per, most, True).join(probe_keys(left, per, most, least, True), "key")
    later_long = later_long.where(may & (F.col("a.first") <= F.col("b.first")))
    pairs = [
        met.select(F.col(f"{later}.first").alias("first"), F.col("a.id").alias("a"), F.col("b.id").alias("b"), "edits")
        for met, later in ((later_short, "a"), (later_long, "b"))
    ]
    return done.unionByName(verified(pairs[0].unionByName(pairs[1])))


def line_dedup(docs: DataFrame, per: int = 20, most: int = 3, least: int = 16, tables: str = "lines") -> DataFrame:
    """One row per document: doc_id, n_lines, n_exact, n_near (lines that go as copies, as near copies), kept_lines (places from 0).

    Lines are what line feeds part. A line goes when an earlier one (smaller doc_id, then place) equals it, or when its
    first occurrence comes after that of a line within so many edits as the shorter one's length allows, one per ``per``
    characters, from one to ``most``; what is compared is the input, not what is left.
    Lines of fewer than ``least`` characters go only as equals; lines of white space stay.

    A null or empty text is one empty line. Rows without doc_id keep all lines and are no one's original. Rows that
    repeat a doc_id share their places: at one place, equal lines all stay. An empty table gives an empty result.
    """
    whole = texts(docs).select("doc_id", F.split("text", "\n").alias("lines"))
    blank = lambda line: F.ltrim(line, F.lit(WHITE)) == ""
    lines = whole.where("doc_id is not null").select("doc_id", F.posexplode("lines").alias("at", "line")).where(~blank(F.col("line")))
    firsts = lines.groupBy("line").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    known = written(firsts.select("first", F.monotonically_increasing_id().alias("id"), "line"), tables)
    long = known.where(F.length("line") >= least).select("id", "line")
    ids = written(_meeting(probe_keys(long, per, most, least)), tables).distinct()
    held = sifted(known, "id", ids).join(ids, "id", "left_semi").withColumn("marks", line_marks(F.col("line"), per, most))
    held = written(held, tables)
    near = written(_near_lines(held, per, most, least, tables), tables)
    marked = known.select("first").join(near.select("first", F.lit(1).alias("near")), "first", "left")
    per_doc = marked.groupBy(F.col("first.doc_id").alias("_id")).agg(
        F.count(F.lit(1)).alias("firsts"), F.count("near").alias("n_near"), F.collect_list(F.when(F.col("near").isNull(), F.col("first.at"))).alias("kept")
    )
    numbered = F.transform("lines", lambda line, i: F.when(blank(line) | F.col("doc_id").isNull(), i))
    base = whole.select("doc_id", F.size("lines").cast("bigint").alias("n_lines"), F.array_compact(numbered).alias("blank"))
    out = base.join(per_doc, F.col("doc_id") == F.col("_id"), "left")
    none = F.lit(0).cast("bigint")
    return out.select(
        "doc_id", "n_lines", F.greatest(none, F.col("n_lines") - F.size("blank") - F.coalesce("firsts", none)).alias("n_exact"),
        F.coalesce("n_near", none).alias("n_near"),
        F.sort_array(F.concat("blank", F.coalesce("kept", F.array().cast("array<int>")))).alias("kept_lines"),
    )


def kept_texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id and the text of the lines that stay, for unique doc_ids."""
    lines = F.split("text", "\n")
    return texts(docs).join(found, "doc_id").select("doc_id", F.array_join(F.transform("kept_lines", lambda i: F.get(lines, i)), "\n").alias("text"))


# The letters of several bytes that the test tables have, one byte each for distances that are of bytes.
LETTERS = "éÉßÇçäÄóÈöÓèñÑêüÖÍÜÊí"
BYTES = f"translate(line, '{LETTERS}', {' || '.join(f'chr({i})' for i in (*range(1, 9), *range(14, 27)))})"


@query(
    "op7_line_dedup",
    r"""
    WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM s),
    t AS MATERIALIZED (SELECT doc_id, pos, line, regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g') = '' AS blank FROM l),
    f AS MATERIALIZED (SELECT line, arg_min(doc_id, (doc_id, pos)) AS doc_id, arg_min(pos, (doc_id, pos)) AS pos, length(line) AS n FROM t WHERE NOT blank GROUP BY line),
    c AS MATERIALIZED (SELECT *, {BYTES} AS b, [length(line) - length(replace(line, 'e', '')), length(line) - length(replace(line, 'a', '')), length(line) - length(replace(line, 'n', '')), length(line) - length(replace(line, ' ', '')),
      length(line) - length(replace(line, 't', '')), length(line) - length(replace(line, 'r', '')), length(line) - length(replace(line, 's', ''))] AS k FROM f WHERE n >= 16),
    near AS (
      SELECT DISTINCT y.doc_id, y.pos FROM c x JOIN c y ON y.n BETWEEN x.n - 3 AND x.n + 3 AND (x.doc_id, x.pos) < (y.doc_id, y.pos)
      AND abs(x.n - y.n) <= least(3, greatest(1, least(x.n, y.n) // 20)) AND abs(x.k[1] - y.k[1]) <= 3 AND abs(x.k[2] - y.k[2]) <= 3 AND abs(x.k[3] - y.k[3]) <= 3
      AND abs(x.k[4] - y.k[4]) <= 3 AND abs(x.k[5] - y.k[5]) <= 3 AND abs(x.k[6] - y.k[6]) <= 3 AND abs(x.k[7] - y.k[7]) <= 3
      WHERE levenshtein(x.b, y.b) <= least(3, greatest(1, least(x.n, y.n) // 20))),
    m AS (SELECT t.doc_id, t.pos, t.blank, f.line IS NOT NULL AS first, near.pos IS NOT NULL AS near
      FROM t LEFT JOIN f ON f.doc_id = t.doc_id AND f.pos = t.pos LEFT JOIN near ON near.doc_id = t.doc_id AND near.pos = t.pos)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT blank AND NOT first) AS n_exact, count(*) FILTER (near) AS n_near,
      coalesce(list(pos ORDER BY pos) FILTER (blank OR (first AND NOT near)), []) AS kept_lines
    FROM m GROUP BY doc_id
    """.replace("{BYTES}", BYTES),
)
def _query(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents"))
