"""Item codes: extraction from file names, spellings, comparison keys and prefixes.

A code is read by an ordered table of :class:`CodeRule`. The default table covers code *shapes*;
rules for particular vendors are the caller's data and go in front of it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogfuse.functions.basics import (
    alternation,
    as_col,
    distinct_in_order,
    first_hit,
    let,
    literal_map,
    replace_each,
    sealed,
    strip_chars,
)

# Quality words removed from names when they stand between separators.
QUALITY_WORDS = (
    "4K", "4KS", "8K", "HD", "LR", "VR", "DVD", "FULL", "HEVC", "H264", "H265", "X264", "X265", "AAC", "XXX", "PRT",
)
# What a code does not begin or end with; the shape of a digit code; the shape that tells a dated code, and
# the one that it is then read by.
EDGE = "-_. "
DIGIT_CODE = "(\\d{6})([-_])(\\d{2,4})"
DATED_CODE = "([A-Z0-9_]{2,})[-.]2?0?(\\d{2}[-.]\\d{2}[-.]\\d{2})"
DATED_PARTS = "([A-Z0-9-]{2,})[-_.]2?0?(\\d{2}[-.]\\d{2}[-.]\\d{2})"
# Rewrites (pattern, replacement) of a name before its code is read, in order: part markers; then dates.
PART_REWRITES = (
    ("-C\\.", "."), ("\\.PART", "-CD"), ("-PART", "-CD"), (" EP\\.", ".EP"), ("-CD-", ""), ("[-_ .]CD\\d{1,2}", ""), ("[-_ .][A-Z0-9]\\.$", ""),
)
DATE_REWRITES = (("\\d{4}[-_.]\\d{1,2}[-_.]\\d{1,2}", ""), ("[-\\[]\\d{2}[-_.]\\d{2}[-_.]\\d{2}]?", ""), ("--", "-"))
# Shapes of spellings. A series led by 91; with a second number; with an episode; an episode alone; of two
# names; of three letters; of two. And the text behind the last hyphen that is no part of a code.
SPELLINGS = {
    "lead": "(91[A-Z]{2,})-?(\\d{3,})", "multi": "([A-Z]{2,})-?(\\d{3,})-(\\d+)", "episode": "([A-Z]{2,})-?(\\d{3,})(.*)(EP\\d+)",
    "bare": "([^. ]+\\.EP\\d+)\\.", "double": "([A-Z]{2,})-([A-Z]{2,})-(\\d+)", "three": "([A-Z]{3,})-?(\\d{2,})", "two": "([A-Z]{2,})-?(\\d{3,})",
}
TRAILING_TEXT = "-[^0-9]+?$"


@dataclass(frozen=True)
class CodeRule:
    """One step of the cascade: where ``pattern`` is found, the code is ``template``.

    ``template`` uses Java group references. ``gate`` is an extra literal the name must contain,
    ``unless`` one it must not contain.
    """

    pattern: str
    template: str = "$0"
    gate: str | None = None
    unless: str | None = None
    case: str | None = None
    supplement: bool = False

    def condition(self, subject: Column) -> Column:
        cond = subject.rlike(self.pattern)
        if self.gate:
            cond = cond & subject.contains(self.gate)
        if self.unless:
            cond = cond & ~subject.contains(self.unless)
        return cond

    def value(self, subject: Column) -> Column:
        hit = F.regexp_extract(subject, f"({self.pattern})", 1)
        out = hit if self.template == "$0" else F.regexp_replace(hit, self.pattern, self.template)
        return F.lower(out) if self.case == "lower" else out


def brand_rule(brand: str, min_digits: int, joiner: str = "-") -> CodeRule:
    """Vendor rule: BRAND, optional separators, at least ``min_digits`` digits."""
    return CodeRule(f"{brand}[-_]*(\\d{{{min_digits},}})", f"{brand}{joiner}$1", gate=brand)


# Code shapes, tried in this order.
SHAPE_RULES = (
    CodeRule("([A-Z]{2,})00(\\d{3})", "$1-$2"),
    CodeRule("\\d{2,}[A-Z]{2,}-\\d{2,}[A-Z]?"),
    CodeRule("[A-Z]{2,}-\\d{2,}[Z]?", supplement=True),
    CodeRule("[A-Z]+-[A-Z]\\d+"),
    CodeRule("\\d{2,}[-_]\\d{2,}"),
    CodeRule("\\d{3,}-[A-Z]{3,}"),
    CodeRule("([^A-Z]|^)(N\\d{4})(\\D|$)", "$2", case="lower"),
    CodeRule("H_\\d{3,}([A-Z]{2,})(\\d{2,})", "$1-$2"),
    CodeRule("([A-Z]{3,}).*?(\\d{2,})", "$1-$2"),
    CodeRule("([A-Z]{2,}).*?(\\d{3,})", "$1-$2"),
)


def file_stem(path: Column | str) -> Column:
    """File name without directories and extension."""
    name = F.element_at(F.split(F.replace(as_col(path), F.lit("\\"), F.lit("/")), "/"), -1)
    return F.regexp_replace(name, "(?<=.)\\.[^.]*$", "")


def strip_noise(
    c: Column | str, tokens: Sequence[str] = (), repl: str = "", quality_words: Sequence[str] = QUALITY_WORDS
) -> Column:
    """Upper case, noise tokens out (longest first), separated quality words to '-', edges trimmed."""
    ordered = sorted({t.upper() for t in tokens if t}, key=lambda t: (-len(t), t))
    text = replace_each(F.upper(as_col(c)), [(t, repl) for t in ordered])
    cut = text
    for word in quality_words:
        cut = F.regexp_replace(cut, f"[-_ .\\[]{word}[-_ .\\]]", "-")
    if quality_words:
        # Most names hold none of the words: one test spares them the chain.
        cut = F.when(text.rlike(f"[-_ .\\[](?:{alternation(quality_words)})[-_ .\\]]"), cut).otherwise(text)
    return strip_chars(F.replace(cut, F.lit("--"), F.lit("-")), EDGE)


def normalize_digit_code(c: Column | str, vendor_prefixes: Sequence[str] = ()) -> Column:
    """``dddddd-ddd`` codes, with a known vendor prefix dropped; NULL for anything else."""
    text = strip_chars(F.trim(as_col(c)), EDGE)
    vendor = f"(?:(?:{alternation(vendor_prefixes)})[-_ ]*)?" if vendor_prefixes else ""
    pattern = f"(?i)^{vendor}{DIGIT_CODE}$"
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, "$1$2$3"))


def expand_series(c: Column | str, names: dict[str, str]) -> Column:
    """Short series name to its long form, lower case without '-' and '.'; misses only lower case."""
    key = F.lower(as_col(c))
    if not names:
        return key
    long_name = literal_map({k.lower(): v.lower().replace("-", "").replace(".", "") for k, v in names.items()})[key]
    return F.coalesce(long_name, key)


def supplement_prefix(c: Column | str, prefixes: Sequence[tuple[str, str]]) -> Column:
    """Prepend vendor digits by the first dictionary prefix the code starts with."""
    c = as_col(c)
    upper = F.upper(c)
    cases = [(upper.startswith(key.upper()), F.concat(F.lit(digits), c)) for key, digits in prefixes]
    return first_hit(cases, c) if cases else c


def _rewritten(c: Column, rewrites: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda text, rule: F.regexp_replace(text, *rule), rewrites, c)


def extract_item_code(
    df,
    path: str = "path",
    out: str = "item_code",
    tokens: Sequence[str] = (),
    rules: Sequence[CodeRule] = SHAPE_RULES,
    series_names: dict[str, str] | None = None,
    supplements: Sequence[tuple[str, str]] = (),
    vendor_prefixes: Sequence[str] = (),
    composed: bool = False,
):
    """Item code of every path: digit code, dated code, then the rule table; else the cleaned name.

    ``composed`` puts the cleaned name in canonical composition (Python, Arrow batched): for names from file systems
    that take letters and marks apart.

    The cascade is built in three projections (clean name, bare name, code) so that no single
    generated method grows with the number of rules.
    """
    clean = F.concat(strip_noise(F.concat(F.trim(file_stem(as_col(path))), F.lit(".")), tokens), F.lit("."))
    dated = strip_chars(F.replace(_rewritten(clean, PART_REWRITES), F.lit(" "), F.lit("-")), EDGE)
    bare = _rewritten(dated, DATE_REWRITES)
    staged = df.withColumn("_clean", clean).withColumn("_dated", dated).withColumn("_bare", bare)
    name, dated_name = F.col("_bare"), F.col("_dated")

    digit_code = normalize_digit_code(name, vendor_prefixes)
    series = expand_series(strip_chars(F.regexp_extract(dated_name, DATED_PARTS, 1), "-"), series_names or {})
    date = F.replace(F.regexp_extract(dated_name, DATED_PARTS, 2), F.lit("-"), F.lit("."))
    dated_code = F.concat(series, F.lit("."), date)
    dated_code = F.concat(F.upper(F.substring(dated_code, 1, 1)), F.lower(F.substring(dated_code, F.lit(2), F.length(dated_code))))

    cases = [(digit_code.isNotNull(), digit_code), (dated_name.rlike(DATED_CODE) & dated_name.rlike(DATED_PARTS), dated_code)]
    for rule in rules:
        value = rule.value(name)
        cases.append((rule.condition(name), supplement_prefix(value, supplements) if rule.supplement else value))
    fallback = strip_chars(F.regexp_replace(F.col("_clean"), "[【(（\\[].+?[]）)】]", ""), "@. ")
    if composed:
        from catalogfuse.functions.text import nfc

        fallback = nfc(fallback)
    code = strip_chars(first_hit(cases, fallback), EDGE).alias(out)
    return sealed(staged, code, keep=[c for c in df.columns if c != out])


def short_code(c: Column | str) -> Column:
    """Code without three or more leading digits; NULL when there are none to drop."""
    return F.nullif(F.regexp_extract(as_col(c), "\\d{3,}([a-zA-Z]+-\\d+)", 1), F.lit(""))


def code_prefix(c: Column | str, fixed_prefixes: Sequence[str] = (), unknown: str = "unknown") -> Column:
    """Series letters of a code: dated series, then a fixed prefix, then letters with leading digits."""
    c = as_col(c)
    dated = "([A-Za-z0-9-.]{3,})[-_. ]\\d{2}\\.\\d{2}\\.\\d{2}"
    cases = [(c.rlike(dated), F.regexp_extract(c, dated, 1))]
    cases += [(F.upper(c).startswith(p.upper()), F.lit(p)) for p in fixed_prefixes]
    cases.append((c.rlike("\\d*[A-Za-z]+"), F.regexp_extract(c, "(\\d*[A-Za-z]+)\\d*", 1)))
    return first_hit(cases, F.lit(unknown))


def first_letter_bucket(c: Column | str) -> Column:
    """First character when it is an ASCII letter or digit, else '#'."""
    first = F.substring(F.upper(as_col(c)), 1, 1)
    return F.when(first.rlike("^[A-Z0-9]$"), first).otherwise("#")


def is_prefix_family(
    c: Column | str, prefixes: Sequence[str], patterns: Sequence[str] = (), digit_codes: bool = True
) -> Column:
    """Code belongs to a family: one of its prefixes, one of its patterns, or a digit code."""
    c = as_col(c)
    out = F.lit(False)
    if prefixes:
        out = out | F.upper(c).rlike(f"^(?:{alternation([p.upper() for p in prefixes])})")
    for pattern in patterns:
        out = out | c.rlike(pattern)
    return out | normalize_digit_code(c).isNotNull() if digit_codes else out


def is_digit_led(c: Column | str) -> Column:
    """Three or more digits in front of letters and a number."""
    return F.upper(as_col(c)).rlike("\\d{3,}[A-Z]+-\\d{2}")


def _drop_zeros(c: Column) -> Column:
    text = F.trim(F.upper(c))
    pattern = "^([A-Z0-9]+)-0+(\\d+)$"
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, "$1-$2")).otherwise(text)


def code_variants(code: Column | str, short: Column | str | None = None) -> Column:
    """Spellings to look a code up by, in order: zero-free forms, then the codes as written."""
    code = as_col(code)
    parts = [code] if short is None else [code, as_col(short)]
    return distinct_in_order(F.array(*[_drop_zeros(p) for p in parts], *[F.trim(F.upper(p)) for p in parts]))


def candidate_codes(name: Column | str) -> Column:
    """Alternative spellings of the code in an upper-case name, shortest first.

    Shapes tried in order: ``91XX123``; ``XX-123-4``; ``XX-123 ... EP4`` or ``NAME.EP4.``; ``XX-YY-123``; three letters with two
    or more digits; two letters with three or more digits. Order within one length is the order listed.
    """
    name = F.regexp_replace(as_col(name), TRAILING_TEXT, "")

    def spelled(shape: str, *layouts: str) -> Column:
        """``layouts`` name the groups of the shape by number; the rest of them stands as it is."""
        groups = {d: F.regexp_extract(name, SPELLINGS[shape], int(d)) for d in "1234" if any(d in x for x in layouts)}
        return F.array(*[F.concat(*[groups.get(ch, F.lit(ch)) for ch in layout]) for layout in layouts])

    def tidy(forms: Column, by: str = ".") -> Column:
        return F.transform(forms, lambda v: F.replace(F.replace(F.replace(v, F.lit(".."), F.lit(".")), F.lit(" "), F.lit("")), F.lit("."), F.lit(by)))

    def if_three(shape: str, forms: Column) -> Column:
        none = F.array().cast("array<string>")
        return F.when(F.length(F.regexp_extract(name, SPELLINGS[shape], 2)) == 3, forms).otherwise(none)

    has = {k: name.rlike(p) for k, p in SPELLINGS.items()}
    whole = spelled("episode", "1-2.34")
    # A zero is a literal here, not a group.
    episode = F.concat(
        tidy(whole), tidy(whole, " "), spelled("episode", "12"), if_three("episode", tidy(spelled("episode", "1-02.34")))
    )
    cases = [
        (has["lead"], spelled("lead", "1-2", "12", "1 2")),
        (has["multi"], spelled("multi", "1-2-3")),
        (name.contains("EP"), F.when(has["episode"], episode).when(has["bare"], spelled("bare", "1")).otherwise(F.array().cast("array<string>"))),
        (has["double"], spelled("double", "1-2-3")),
        (has["three"], spelled("three", "1-2", "12", "1-02", "102")),
        (has["two"], F.concat(spelled("two", "1-2", "12", "1 2"), if_three("two", spelled("two", "1-02", "102", "1 02")))),
    ]
    found = distinct_in_order(first_hit(cases, F.array().cast("array<string>")))
    keyed = F.transform(found, lambda v, i: F.struct(F.length(v).alias("n"), i.alias("i"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


def candidate_titles(name: Column | str, labels: Sequence[str] = ()) -> Column:
    """Title fragments to search by when a name holds no code.

    Words of the name (non-word characters as blanks), label words cut from both ends; then words
    longer than seven, the whole, and head / tail / middle windows longer than ten characters.
    The text following a bracketed name comes first.
    """
    def words_of(upper: Column) -> Column:
        words = F.filter(F.split(F.regexp_replace(upper, "(?U)[\\W_]", " "), " +"), lambda w: w != "")
        return let(words, trimmed) if labels else words

    def trimmed(words: Column) -> Column:
        hit = lambda w: w.rlike(f"(?:{alternation([x.upper() for x in labels])})")
        flags = F.transform(words, lambda w: hit(w).cast("int"))
        head = F.array_position(flags, 0)
        tail = F.array_position(F.reverse(flags), 0)
        kept = F.slice(words, head.cast("int"), (F.size(words) - head - tail + 2).cast("int"))
        return F.when(head > 0, kept).otherwise(F.array().cast("array<string>"))

    return let(as_col(name), lambda raw: let(F.upper(raw), lambda upper: let(words_of(upper), lambda words: _title_fragments(raw, upper, words))))


def _title_fragments(raw: Column, upper: Column, words: Column) -> Column:
    n = F.size(words)

    def window(start: int, drop: int, min_words: int) -> Column:
        part = F.slice(words, start + 1, F.greatest(n - start - drop, F.lit(0)))
        return F.when((n > min_words) & (F.length(F.array_join(part, "")) > 10), F.array_join(part, " "))

    head2 = F.slice(words, 1, 2)
    head_window = F.when((n > 2) & (F.length(F.array_join(head2, "")) > 10), F.array_join(head2, " "))
    after_bracket = F.regexp_extract(raw, "(?:【.+】|『.+』|〖.+〗)[,，\\- ]?(\\S{6,18}?)[,，\\- ]", 1)
    fragments = F.concat(
        F.array(after_bracket),
        F.filter(words, lambda w: F.length(w) > 7),
        F.array(F.array_join(words, " "), head_window, window(2, 0, 2), window(1, 1, 3), window(2, 2, 3), raw),
    )
    single = F.array(
        after_bracket,
        F.trim(F.substring(upper, 1, 30)),
        F.when(F.length(upper) > 38, F.trim(F.substring(upper, 11, 20))),
        raw,
    )
    return distinct_in_order(F.when(n > 1, fragments).otherwise(single))


CODE_PARTS = "([a-z]+)-?(\\d+)"


def code_key(c: Column | str, pattern: str = CODE_PARTS) -> Column:
    """Comparison key of a code: letters, then digits without leading zeros (three kept)."""
    text = F.replace(F.replace(F.lower(F.trim(as_col(c))), F.lit("_"), F.lit("-")), F.lit(" "), F.lit(""))
    prefix, digits = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    bare = F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0"))
    shown = F.when((F.length(bare) < 3) & (F.length(digits) >= 3), F.lpad(bare, 3, "0")).otherwise(bare)
    return F.when(digits != "", F.regexp_replace(F.concat(prefix, shown), "[^a-z0-9]", ""))


def url_slug_parts(url: Column | str, language_suffixes: Sequence[str] = ()) -> Column:
    """Path segments of a URL without trailing language segments."""
    path = F.regexp_extract(as_col(url), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    if language_suffixes:
        path = F.regexp_replace(path, f"(?i)(?:/(?:{alternation(language_suffixes)})|/)+$", "")
    return F.filter(F.split(path, "/"), lambda p: p != "")


def code_from_url(url: Column | str, language_suffixes: Sequence[str] = ()) -> Column:
    """Last path segment, upper case."""
    parts = url_slug_parts(url, language_suffixes)
    return F.when(F.size(parts) > 0, F.upper(F.element_at(parts, -1)))


def external_id_from_url(url: Column | str, id_prefix: str, language_suffixes: Sequence[str] = ()) -> Column:
    """First segment starting with ``id_prefix``, else the last segment; lower case."""
    parts = F.transform(url_slug_parts(url, language_suffixes), F.lower)
    marked = F.filter(parts, lambda p: p.startswith(id_prefix))
    return F.when(F.size(marked) > 0, F.element_at(marked, 1)).when(F.size(parts) > 0, F.element_at(parts, -1))
