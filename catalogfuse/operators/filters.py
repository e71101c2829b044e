"""Row filters with their statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogfuse.functions.basics import as_col
from catalogfuse.functions.paths import CleanupRules, needs_cleanup
from catalogfuse.functions.text import glob_to_regex


def cleanup_candidates(inventory: DataFrame, rules: CleanupRules) -> DataFrame:
    """Files the rules would delete. Nothing is deleted here."""
    return inventory.where(needs_cleanup("path", "size", rules))


def min_size(inventory: DataFrame, mb: float, is_link: Column | None = None) -> DataFrame:
    """Files of at least ``mb`` megabytes, and links of any size."""
    big = F.col("size") >= int(mb * 1024 * 1024)
    return inventory.where(big if is_link is None else big | is_link)


# The characters a text strip removes.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(cp) for cp in range(0x2000, 0x200B)
)


@dataclass(frozen=True)
class LineFilter:
    """Conditions on a trimmed line; all given ones must hold."""

    glob: str | None = None
    regex: str | None = None
    contains: Sequence[str] = ()
    contains_any_case: Sequence[str] = ()
    prefix: str | None = None
    suffix: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    drop_empty: bool = False
    only_empty: bool = False

    def condition(self, line: Column | str) -> Column:
        text = F.btrim(as_col(line), F.lit(WHITESPACE))
        low = F.lower(text)
        tests = []
        if self.glob is not None:
            tests.append(text.rlike(glob_to_regex(self.glob)))
        if self.regex is not None:
            tests.append(text.rlike(self.regex))
        tests += [text.contains(w) for w in self.contains]
        tests += [low.contains(w.lower()) for w in self.contains_any_case]
        if self.prefix is not None:
            tests.append(text.startswith(self.prefix))
        if self.suffix is not None:
            tests.append(text.endswith(self.suffix))
        if self.min_length is not None:
            tests.append(F.length(text) >= self.min_length)
        if self.max_length is not None:
            tests.append(F.length(text) <= self.max_length)
        if self.drop_empty:
            tests.append(text != "")
        if self.only_empty:
            tests.append(text == "")
        out = F.lit(True)
        for t in tests:
            out = out & t
        return out


def filter_lines(df: DataFrame, spec: LineFilter, line: str = "line") -> DataFrame:
    return df.where(spec.condition(line))


def line_stats(df: DataFrame, spec: LineFilter, line: str = "line") -> DataFrame:
    """Total and matched lines, one pass."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(spec.condition(line)).alias("matched"))


def flag_missing_pages(
    text: Column | str, title: Column | str, image: Column | str, not_found: Sequence[str], generic_titles: Sequence[str],
    logo: str,
) -> Column:
    """Soft 404: a 404 code with a not-found text, or with a generic title and the site's logo."""
    body, head, img = (F.lower(F.coalesce(as_col(c), F.lit(""))) for c in (text, title, image))
    code = body.rlike("(^|\\s)404(\\s|$)")
    said = F.exists(F.array(*[F.lit(m.lower()) for m in not_found]), lambda m: body.contains(m))
    generic = F.exists(F.array(*[F.lit(m.lower()) for m in generic_titles]), lambda m: head.contains(m))
    return code & (said | (generic & img.contains(logo.lower())))


def page_gone(text: Column | str, markers: Sequence[str]) -> Column:
    """Page that says in so many words that the item is gone."""
    body = F.coalesce(as_col(text), F.lit(""))
    return F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: body.contains(m))
