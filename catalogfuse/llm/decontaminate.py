"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so a question whose parameters were changed keeps its template. Hashes
of template windows of the documents meet those of the benchmark in a hash join; where enough windows of an item lie
on one diagonal, the placeholders' values are compared: they must map one to one, as they do in a copy and in a
re-parameterised question, and don't in texts that share a template by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogfuse.llm.common import query, sifted, table, texts, written

# Words that name a unit.
UNITS = (
    "km", "cm", "mm", "kg", "mg", "lb", "lbs", "oz", "ml", "mph", "kmh", "hz", "kw", "kwh", "meter", "meters", "metre", "metres", "mile", "miles",
    "inch", "inches", "feet", "foot", "yard", "yards", "gram", "grams", "liter", "liters", "litre", "litres", "second", "seconds", "minute", "minutes",
    "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent",
    "degree", "degrees",
)
# Number words.
NUMBERS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
    "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "dozen",
)
# Words that have a capital only because they begin a sentence.
LEADS = (
    "a", "an", "the", "if", "when", "while", "what", "who", "which", "where", "why", "how", "in", "on", "at", "of", "to", "for", "from", "with", "by", "is",
    "are", "was", "were", "do", "does", "did", "can", "has", "have", "and", "but", "or", "he", "she", "it", "they", "we", "you", "this", "that", "then",
)
NAME_WORDS = 4
BEND = 8  # tokens by which longer or shorter names and numbers may move what follows them
BROADCAST_WINDOWS = 200_000  # windows of the benchmark up to which they go to the documents; beyond, both are shuffled


# Thai, Lao, Burmese, Khmer, kana and Han: no blanks between words.
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3005-\u3007\u3031-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\x{20000}-\x{3FFFF}"


def tokens(text: Column) -> Column:
    """Words and numbers, without white space and punctuation; scripts without blanks by characters.

    A text that is mostly in capitals (of E, A and N, which tell it cheaply) is read in small letters: there, capitals don't tell names.
    """
    held = lambda letters: sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in letters), F.lit(0))
    capitals, small = held("EAN"), held("ean")
    text = F.when(capitals > small, F.lower(text)).otherwise(text)
    return F.regexp_extract_all(text, F.lit(rf"[\p{{L}}\p{{M}}&&[^{UNSPACED}]]+|[{UNSPACED}&&[\p{{L}}\p{{M}}]]|[0-9]+(?:[.,][0-9]+)*"), F.lit(0))


def template(token: Column) -> Column:
    """A number, in digits or a word, a word with a capital and a unit are placeholders; another word is itself."""
    return (
        F.when(F.substring(token, 1, 1).between("0", "9"), F.lit("<num>"))
        .when(token.isin(*UNITS, *NUMBERS), F.when(token.isin(*NUMBERS), F.lit("<num>")).otherwise("<unit>"))
        .when(token != F.lower(token), F.lit("<name>")).otherwise(token)
    )


def spelled(tokens_: Column, at: Column, before: Column, after: Column) -> Column:
    """A placeholder's value: the token, and of a name all of its words, up to NAME_WORDS on either side, but not more than ``before``
    and ``after`` tokens away."""
    name = lambda t: F.coalesce((template(t) == "<name>") & ~F.lower(t).isin(*LEADS), F.lit(False))
    none = F.struct(F.lit("").alias("text"), F.lit(True).alias("on"))

    def grown(side: int, most: Column) -> Column:
        def more(s: Column, k: Column) -> Column:
            word = F.get(tokens_, at + side * k)
            on = s["on"] & (k <= most) & name(word)
            joined = F.concat(word, F.lit(" "), s["text"]) if side < 0 else F.concat(s["text"], F.lit(" "), word)
            return F.named_struct(F.lit("text"), F.when(on, joined).otherwise(s["text"]), F.lit("on"), on)

        return F.aggregate(F.sequence(F.lit(1), F.lit(NAME_WORDS)), none, more)["text"]

    word = F.get(tokens_, at)
    return F.when(name(word), F.concat(grown(-1, before), word, grown(1, after))).otherwise(word)


def windows(tokens_: Column, lengths: list[int], literals: int, exact: bool) -> Column:
    """Hashes of the template's windows of each length, with their first token (from 0) and length.

    A window with fewer than ``literals`` words that are no placeholders has the hash of its tokens themselves, if
    ``exact``, and none otherwise. A window has as many of them as any other with its template, so it needs one hash only.
    """

    def of(canon: Column) -> Column:
        def one(length: int, flags: Column | None = None) -> Column:
            last = F.size(canon) - length
            starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

            def key(i: Column) -> Column:
                h = F.xxhash64(F.slice(canon, i + 1, length))
                if flags is None:
                    return h
                words = F.size(F.array_remove(F.slice(flags, i + 1, length), 0))
                return F.when(words >= literals, h).otherwise(F.xxhash64(F.lit("exact"), F.slice(tokens_, i + 1, length)))

            return F.transform(starts, lambda i: F.struct(key(i).alias("h"), i.alias("at")))

        def all_of(flags: Column | None = None) -> Column:
            return F.concat(*[one(n, flags) for n in lengths]) if len(lengths) > 1 else one(lengths[0], flags)

        if not exact:
            return all_of()
        flag = F.transform(canon, lambda t: F.when(F.substring(t, 1, 1) == "<", 0).otherwise(1))
        return F.element_at(F.transform(F.array(flag), all_of), 1)

    # One element names the template, so that it is computed once and not for every window.
    return F.element_at(F.transform(F.array(F.transform(tokens_, template)), of), 1)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 8, literals: int = 4, least: int = 13, tables: str = "contaminated"
) -> DataFrame:
    """Rows for what was found only: doc_id, item_id, matched_tokens, item_tokens, slots, same_slots (those with equal values).

    A document holds an item when windows of ``window`` tokens on one diagonal, or on some at most BEND tokens apart (a name of two
    words in place of one moves what follows), cover ``least`` tokens of it (all of a shorter item) and the values of the placeholders there map one to one, or ``least`` tokens in a row are the item's own: a changed
    value elsewhere does not make those another text. Windows with fewer than ``literals`` words that are no
    placeholders have templates that tell nothing: they are looked for by their tokens, placeholders' values too. An item of
    fewer than ``window`` tokens is one window.

    Null and empty texts hold nothing, null and empty items are found nowhere. Rows without doc_id are not searched. Rows
    that repeat a doc_id are searched together; rows that repeat an item_id count as one item, whatever text matched.
    Empty tables give an empty result.
    """
    items = benchmark.select("item_id", tokens(F.coalesce(F.col("text"), F.lit(""))).alias("item")).where(F.size("item") > 0)
    items = items.withColumn("length", F.least(F.size("item"), F.lit(window)))
    lengths = sorted(r[0] for r in items.select("length").distinct().collect()) or [window]  # at most ``window`` values
    starts = F.sequence(F.lit(0), F.size("item") - F.col("length"))
    cut = items.select("item_id", "length", F.explode(F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice("item", i + 1, F.col("length")).alias("part")))).alias("w"))
    part = F.col("w.part")
    literal = F.size(F.filter(part, lambda t: template(t) == t))
    h = F.when(literal >= literals, F.xxhash64(F.transform(part, template))).otherwise(F.xxhash64(F.lit("exact"), part))
    index = cut.select("item_id", h.alias("h"), F.col("w.at").alias("item_at"), (literal < literals).alias("exact")).distinct()
    counted = index.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or("exact"), F.lit(False)).alias("exact")).first()
    index = index.drop("exact")
    side = F.broadcast(index) if counted["n"] <= BROADCAST_WINDOWS else index

    searched = texts(docs).where("doc_id is not null")
    # The tokens are named once, as the template is.
    hashed = F.element_at(F.transform(F.array(tokens(F.col("text"))), lambda t: windows(t, lengths, literals, counted["exact"])), 1)
    met = searched.select("doc_id", F.inline(hashed)).join(side, "h")
    lines = met.groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.sort_array(F.collect_set("item_at")).alias("ats"))
    lines = written(lines, tables)
    # The tokens of the documents that were met.
    held = sifted(searched, "doc_id", lines).select("doc_id", tokens(F.col("text")).alias("doc"))
    placed = lines.join(held, "doc_id").join(items.select("item_id", "item", "length"), "item_id")
    placed = written(placed, tables)
    covered = F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("length") - 1))))
    values = F.filter(
        covered, lambda i: template(F.get("item", i)) != F.get("item", i)
    )
    ends = lambda i: (i, F.size("item") - 1 - i)
    values = F.transform(values, lambda i: F.named_struct(
        F.lit("a"), spelled(F.col("item"), i, *ends(i)), F.lit("b"), spelled(F.col("doc"), i + F.col("shift").cast("int"), *ends(i))
    ))
    same = lambda i: F.coalesce(F.get("item", i) == F.get("doc", i + F.col("shift").cast("int")), F.lit(False))
    longest = F.aggregate(
        F.sequence(F.lit(0), F.size("item") - 1), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, i: F.struct(F.when(same(i), s["now"] + 1).otherwise(0).alias("now"), F.greatest(s["most"], F.when(same(i), s["now"] + 1).otherwise(0)).alias("most")),
    )
    here = placed.select("doc_id", "item_id", F.size(covered).alias("matched_tokens"), F.size("item").alias("item_tokens"), values.alias("values"), longest["most"].alias("run"))
    # Diagonals near each other: each stands in two bands, so any two at most BEND apart share one.
    bands = F.array(F.floor(F.col("shift") / (2 * BEND)) * 2, F.floor((F.col("shift") + BEND) / (2 * BEND)) * 2 + 1)
    spans = placed.select("doc_id", "item_id", F.size("item").alias("item_tokens"), F.explode(bands).alias("band"), covered.alias("covered"), values.alias("values"))
    bent = spans.groupBy("doc_id", "item_id", "band", "item_tokens").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("matched_tokens"), F.flatten(F.collect_list("values")).alias("values"), F.count(F.lit(1)).alias("lines")
    ).where("lines > 1")
    both = here.unionByName(bent.select("doc_id", "item_id", "matched_tokens", "item_tokens", "values", F.lit(0).alias("run")))
    slots = F.array_distinct("values")
    judged = both.select(
        "doc_id", "item_id", "matched_tokens", "item_tokens", "run", F.size(slots).alias("slots"),
        F.size(F.filter(slots, lambda v: v["a"] == v["b"])).alias("same_slots"),
        F.size(F.array_distinct(F.transform(slots, lambda v: v["a"]))).alias("a"), F.size(F.array_distinct(F.transform(slots, lambda v: v["b"]))).alias("b"),
    )
    one_to_one = (F.col("a") == F.col("slots")) & (F.col("b") == F.col("slots"))
    good = judged.where((F.col("matched_tokens") >= F.least(F.lit(least), F.col("item_tokens"))) & (one_to_one | (F.col("run") >= least)))
    best = F.max(F.struct("matched_tokens", "same_slots", "slots", "item_tokens")).alias("best")
    return good.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.matched_tokens", "best.item_tokens", "best.slots", "best.same_slots"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no item was found, rows without doc_id among them."""
    return docs.join(contaminated(docs, benchmark, **options).select("doc_id").distinct(), "doc_id", "left_anti")


@query("op4_decontaminate")
def _query(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
