"""Small building blocks shared by the expression modules."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. Inside of lambdas Spark computes an expression again wherever it stands."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(c: Column | str) -> Column:
    """'' is the missing value of text sources; it becomes NULL once, at the source boundary."""
    return F.nullif(as_col(c), F.lit(""))


def empty_to_null(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(F.size(c) > 0, c)


def replace_each(c: Column | str, pairs: Iterable[tuple[str, str]]) -> Column:
    """Literal replacements applied in the given order."""
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, as_col(c))


def strip_chars(c: Column | str, chars: str) -> Column:
    """Trim any of ``chars`` from both ends."""
    return F.btrim(as_col(c), F.lit(chars))


def rstrip_chars(c: Column | str, chars: str) -> Column:
    return F.rtrim(as_col(c), F.lit(chars))


def alternation(words: Sequence[str]) -> str:
    """Regex alternation of literal words, longest first, so no word hides a longer one."""
    return "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))


def first_hit(cases: Sequence[tuple[Column, Column]], default: Column | None = None) -> Column:
    """CASE WHEN over ordered (condition, value) pairs."""
    if not cases:
        return default if default is not None else F.lit(None).cast("string")
    out = F.when(cases[0][0], cases[0][1])
    for cond, value in cases[1:]:
        out = out.when(cond, value)
    return out if default is None else out.otherwise(default)


def contains_any(c: Column | str, words: Sequence[str]) -> Column:
    c = as_col(c)
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words], F.lit(False))


def distinct_in_order(arr: Column | str) -> Column:
    """Order-keeping distinct without NULL and '' entries."""
    return F.array_distinct(F.filter(as_col(arr), lambda x: x.isNotNull() & (x != "")))


def text_list(c: Column | str, sep_regex: str = ",") -> Column:
    """Split, trim, drop blanks, de-duplicate in order."""
    return distinct_in_order(F.transform(F.split(as_col(c), sep_regex), lambda x: F.trim(x)))


def literal_map(mapping: dict[str, object]) -> Column:
    """Map literal for a dictionary that is the caller's configuration."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def sealed(df, *columns: Column, keep: Sequence[str]):
    """The columns ``keep`` of ``df`` and the computed ``columns``, closed to filter pushdown.

    A filter on a column that took several projections to compute (a join key's implied IS NOT NULL
    is enough) is rewritten in terms of the inputs and pushed below them, which repeats every step
    many times over. Filters do not pass a generator, so the columns leave through one that yields
    exactly one row.
    """
    return df.select(*[F.col(c) for c in keep], F.inline(F.array(F.struct(*columns))))
