"""Text cleaning and language tests."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogfuse.functions.basics import alternation, as_col, replace_each, strip_chars

# Entity and punctuation clean-up applied to the text fields of a fused item.
TEXT_REPLACEMENTS = (
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&apos;", "'"),
    ("&quot;", '"'),
    ("&lsquo;", "「"),
    ("&rsquo;", "」"),
    ("&hellip;", "…"),
    ("<br/>", ""),
    ("・", "·"),
    ("“", "「"),
    ("”", "」"),
    ("...", "…"),
    ("\u00a0", ""),
    ("\u3000", ""),
    ("\u2800", ""),
)

# Named entities understood by strip_html.
HTML_ENTITIES = (
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&hellip;", "…"),
    ("&amp;", "&"),
)

# Script ranges.
KANA = "\\u3040-\\u30FF"
CJK = "\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF\\u3040-\\u30FF\\uAC00-\\uD7AF"
LATIN_ONLY = "^[a-zA-Z0-9\\s.,;:!?()\\-\"'`~@#$%^&*+=_/\\\\|<>]+$"

_LATIN_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_FULL_WIDTH = "".join(chr(cp) for cp in range(0xFF01, 0xFF5F)) + "\u3000・"
_HALF_WIDTH = "".join(chr(cp) for cp in range(0x21, 0x7F)) + " ·"


def clean_text(c: Column | str) -> Column:
    """HTML entities, line-break tags, odd spaces and quotes to plain text."""
    return replace_each(c, TEXT_REPLACEMENTS)


def clean_node_text(c: Column | str) -> Column:
    """Clean-up of one extracted HTML text node."""
    return replace_each(F.trim(as_col(c)), (("\n", ""), ("\r", ""), ("&nbsp;", " ")))


def half_width(c: Column | str) -> Column:
    """Full-width ASCII block, ideographic space and katakana dot to half width, one pass."""
    return F.translate(as_col(c), _FULL_WIDTH, _HALF_WIDTH)


def fold_width(c: Column | str, masked: Sequence[tuple[str, str]] = ()) -> Column:
    """Match key: unmask, half width, drop every non-word character and '_', upper case."""
    text = half_width(replace_each(c, masked))
    return F.upper(F.regexp_replace(text, "(?U)[\\W_]", ""))


def alias_key(c: Column | str) -> Column:
    """Case and width folding used by alias tables; keeps punctuation."""
    return F.upper(half_width(F.trim(as_col(c))))


@F.pandas_udf(T.StringType())
def _nfkc_casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).strip().casefold())


@F.pandas_udf(T.StringType())
def nfc(values: pd.Series) -> pd.Series:
    """Canonical composition (``NFC``); Spark has no expression for it."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def nfkc_key(c: Column | str, ascii_only: bool = False) -> Column:
    """NFKC + strip + casefold.

    Spark has no normalisation expression, so this is an Arrow-batched Python function. Pass
    ``ascii_only=True`` for data known to be ASCII: the key is then native ``lower(trim(c))``.
    """
    c = as_col(c)
    return F.lower(F.trim(c)) if ascii_only else _nfkc_casefold(c)


def convert_script(c: Column | str, source_chars: str, target_chars: str) -> Column:
    """Character-level script conversion with a caller-supplied one-to-one table."""
    if len(source_chars) != len(target_chars):
        raise ValueError("source_chars and target_chars must have the same length")
    return F.translate(as_col(c), source_chars, target_chars)


def replace_words(
    c: Column | str,
    ordered: Sequence[tuple[str, str]],
    language: Column | str | None = None,
    language_value: str | None = None,
    language_words: Sequence[tuple[str, str]] = (),
) -> Column:
    """Ordered dictionary replacement, then a second dictionary for rows of one language."""
    out = replace_each(c, ordered)
    if language is not None and language_words:
        out = F.when(as_col(language) == F.lit(language_value), replace_each(out, language_words)).otherwise(out)
    return out


def strip_title_parts(c: Column | str, markers: Sequence[str], edge: str = ":， ") -> Column:
    """Remove part markers such as 'part one' from a title; trims after each removal."""
    out = as_col(c)
    for marker in markers:
        out = F.trim(strip_chars(F.replace(out, F.lit(marker), F.lit("")), edge))
    return out


def clean_match_title(c: Column | str, words: Sequence[str], bracket_groups: str = "【.*?】") -> Column:
    """Title for matching: no bracket groups, no trailing media words, people or makers.

    ``words`` is the list of removable trailing words. One anchored alternation removes any run of
    them, so there is no loop; a title made only of such words is kept.
    """
    base = F.trim(F.regexp_replace(F.regexp_replace(as_col(c), bracket_groups, ""), "\\s+", " "))
    if not words:
        return base
    seps = "[\\s\\-—｜|/／・,，、：:()（）\\[\\]［］]"
    pattern = f"(?i)(?:{seps}*(?:{alternation(words)}){seps}*)+$"
    cut = F.trim(F.regexp_replace(F.regexp_replace(base, pattern, ""), f"^{seps}+|{seps}+$", ""))
    return F.when(cut == "", base).otherwise(cut)


def has_kana(c: Column | str) -> Column:
    return as_col(c).rlike(f"[{KANA}]")


def is_latin_only(c: Column | str) -> Column:
    return as_col(c).rlike(LATIN_ONLY)


def probably_english(c: Column | str) -> Column:
    """Four signals, two needed; a text with CJK characters must be at least 85 % Latin letters."""
    text = F.trim(as_col(c))
    words_re = "[A-Za-z]+(?:'[A-Za-z]+)?"
    # Letters by a table look-up per character; the costly word counts run only where the two cheap
    # signals (letter share, letter count) do not settle the matter.
    letters = F.length(text) - F.length(F.translate(text, _LATIN_LETTERS, ""))
    cjk = F.when(text.rlike(f"[{CJK}]"), F.regexp_count(text, F.lit(f"[{CJK}]"))).otherwise(0)
    letter_ratio = letters / F.nullif(letters + cjk, F.lit(0))
    words = F.regexp_count(text, F.lit(words_re))
    tokens = words + cjk
    score = (
        (letter_ratio >= 0.6).cast("int")
        + F.coalesce(words / F.nullif(tokens, F.lit(0)) >= 0.5, F.lit(False)).cast("int")
        + ((letters >= 20) | (words >= 5)).cast("int")
        + ((F.length(text) <= 80) & (letters >= 3) & (words >= 1)).cast("int")
    )
    return (
        F.when((F.length(text) == 0) | has_kana(text) | (letters == 0), False)
        .when((cjk > 0) & (letter_ratio < 0.85), False)
        .when((letters >= 20) & (letter_ratio >= 0.6), True)
        .otherwise(score >= 2)
    )


def detect_language(c: Column | str) -> Column:
    """'ja' when kana is present, 'en' when probably English, else 'other'."""
    return F.when(has_kana(c), "ja").when(probably_english(c), "en").otherwise("other")


def needs_translation(c: Column | str, target: str) -> Column:
    """True when the text is in a recognised language other than ``target``."""
    return as_col(c).isNotNull() & ~detect_language(c).isin("other", target)


def line_breaks(c: Column | str) -> Column:
    """Every spelling of a line break, escaped or tagged, to '\\n'."""
    text = replace_each(c, (("\r\n", "\n"), ("\r", "\n"), ("\\r\\n", "\n"), ("\\n", "\n"), ("\\r", "\n")))
    text = F.regexp_replace(text, "(?i)&lt;\\s*br\\s*/?\\s*&gt;", "\n")
    return F.regexp_replace(text, "(?i)<\\s*br\\s*/?\\s*>", "\n")


def merge_outlines(
    outline: Column | str,
    original: Column | str,
    order: str = "outline_first",
    translator: Column | str | None = None,
    note: str = "translated by ",
) -> Column:
    """Outline plus the original-language text, in either order, with an optional translator note.

    ``order`` is 'outline_first', 'original_first' or 'outline_only'.
    """
    a, b = line_breaks(outline), line_breaks(original)
    differs = b.isNotNull() & (b != "") & (b != a)
    if order == "outline_first":
        joined = F.concat(a, F.lit("\n\n"), b)
    elif order == "original_first":
        joined = F.concat(b, F.lit("\n\n"), a)
    elif order == "outline_only":
        joined = a
    else:
        raise ValueError(f"unknown order {order!r}")
    if translator is not None:
        who = F.nullif(as_col(translator), F.lit(""))
        joined = F.concat(joined, F.coalesce(F.concat(F.lit("\n\n" + note), who), F.lit("")))
    return F.when(differs, joined).otherwise(a)


def strip_html(c: Column | str) -> Column:
    """Unescape, line-breaking tags to newlines, drop other tags, at most one blank line in a row."""
    text = replace_each(F.trim(as_col(c)), HTML_ENTITIES)
    text = F.regexp_replace(text, "(?i)<br\\s*/?>", "\n")
    text = F.regexp_replace(text, "(?i)</p\\s*>", "\n")
    text = F.regexp_replace(text, "<[^>]+>", "")
    text = replace_each(text, (("\r\n", "\n"), ("\r", "\n")))
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def drop_generic_text(c: Column | str, markers: Sequence[str], at_least: int = 2) -> Column:
    """NULL when the text is blank or holds ``at_least`` boilerplate markers."""
    c = as_col(c)
    key = F.lower(F.regexp_replace(c, "[\\s\\u3000]+", ""))
    squeezed = ["".join(m.split()).lower() for m in markers]
    hits = sum((key.contains(m).cast("int") for m in squeezed), F.lit(0))
    return F.when((key != "") & (hits < at_least), c)


def glob_to_regex(pattern: str) -> str:
    """Shell wildcard to an anchored Java regex."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = close
        elif ch.isalnum() or ch in "_ ":
            out.append(ch)
        else:
            out.append("\\" + ch)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def strip_title_affixes(title: Column | str, code: Column | str, names: Column | str) -> Column:
    """Title without trailing names and a leading code; '/' becomes '#', edge blanks and dashes go."""
    code = as_col(code)
    cut = F.aggregate(
        F.coalesce(as_col(names), F.array().cast("array<string>")),
        as_col(title),
        lambda t, n: F.when(
            t.endswith(F.concat(F.lit(" "), n)), F.substring(t, F.lit(1), F.length(t) - F.length(n) - 1)
        ).otherwise(t),
    )
    text = F.trim(cut)
    bare = F.when((code != text) & text.startswith(code), F.trim(F.replace(text, code, F.lit("")))).otherwise(text)
    return strip_chars(F.replace(bare, F.lit("/"), F.lit("#")), " -")


def strip_brackets(names: Column | str) -> Column:
    """Names without what stands in brackets: the first part outside them."""
    return F.transform(as_col(names), lambda n: F.regexp_extract(n, "[^()（）]+", 0))
