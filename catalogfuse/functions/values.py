"""Dates, numbers, editions and lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogfuse.functions.basics import as_col, contains_any, first_hit, literal_map, text_list


def normalize_release(c: Column | str) -> Column:
    """First y-m-d in the text as ISO text; NULL for anything that is no calendar date."""
    text = F.replace(F.replace(as_col(c), F.lit("/"), F.lit("-")), F.lit("."), F.lit("-"))
    ymd = "(\\d{4})-(\\d{1,2})-(\\d{1,2})"
    parts = [F.regexp_extract(text, ymd, i) for i in (1, 2, 3)]
    iso = F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    # Casting checks the calendar without a pattern parser; year 0 is no calendar year.
    return F.when((parts[0] != "") & (parts[0] != "0000") & iso.try_cast("date").isNotNull(), iso)


def normalize_year(year: Column | str, release: Column | str) -> Column:
    """First four digits, '0000' rejected; else the year of a valid release date."""
    digits = F.nullif(F.regexp_extract(as_col(year), "\\d{4}", 0), F.lit(""))
    return F.coalesce(F.nullif(digits, F.lit("0000")), F.substring(normalize_release(release), 1, 4))


def is_zero_runtime(c: Column | str) -> Column:
    return F.trim(as_col(c)).rlike("^0+(\\.0+)?$")


def normalize_runtime(c: Column | str, seconds_from: int = 300) -> Column:
    """Minutes as text. All-zero is missing; ``seconds_from`` and above counts as seconds.

    Halves round to even. Text without a digit is kept as it is.
    """
    text = F.nullif(F.trim(as_col(c)), F.lit(""))
    digits = F.regexp_extract(text, "\\d+", 0)
    number = F.try_to_number(F.nullif(digits, F.lit("")), F.lit("999999999999")).cast("bigint")
    minutes = F.greatest(F.lit(1), F.bround(number / 60, 0).cast("bigint"))
    return (
        F.when(is_zero_runtime(text), F.lit(None).cast("string"))
        .when(digits == "", text)
        .when(number >= seconds_from, minutes.cast("string"))
        .otherwise(number.cast("string"))
    )


def normalize_score(c: Column | str) -> Column:
    """One-decimal text; unreadable scores are NULL."""
    number = as_col(c).try_cast("double")
    return F.when(number.isNotNull(), F.format_string("%.1f", number))


def critic_score(c: Column | str) -> Column:
    """Score times ten, cut to an integer."""
    return F.floor(as_col(c).try_cast("double") * 10).cast("int")


def format_release(c: Column | str, pattern: str = "YYYY-MM-DD") -> Column:
    """Fill a YYYY / YY / MM / DD template; a missing date is '0000-00-00'."""
    iso = F.coalesce(F.nullif(as_col(c), F.lit("")), F.lit("0000-00-00"))
    if pattern == "YYYY-MM-DD":
        return iso
    ymd = "(\\d{4})-(\\d{2})-(\\d{2})"
    year, month, day = (F.regexp_extract(iso, ymd, i) for i in (1, 2, 3))
    out = F.replace(F.lit(pattern), F.lit("YYYY"), year)
    out = F.replace(out, F.lit("YY"), F.substring(year, -2, 2))
    out = F.replace(out, F.lit("MM"), month)
    return F.replace(out, F.lit("DD"), day)


def normalize_edition(
    c: Column | str,
    synonyms: dict[str, str],
    restored_words: Sequence[str],
    restored: str,
    leaked_words: Sequence[str],
    leaked: str,
    uncut_words: Sequence[str],
    uncut_leaked: str,
) -> Column:
    """Edition label: exact synonyms first, then substring rules, else unchanged."""
    text = F.nullif(F.trim(as_col(c)), F.lit(""))
    exact = literal_map(synonyms)[text] if synonyms else F.lit(None).cast("string")
    leaked_label = F.when(contains_any(text, uncut_words), uncut_leaked).otherwise(leaked)
    return F.coalesce(
        exact,
        first_hit(
            [(contains_any(text, restored_words), F.lit(restored)), (contains_any(text, leaked_words), leaked_label)],
            text,
        ),
    )


def merge_edition(
    leaked: Column, restored: Column, uncut: Column, cut: Column, edition: Column, code_is_uncut: Column,
    labels: dict[str, str],
) -> Column:
    """Precedence of file flags over the source's own label; the code decides when nothing is set."""
    return (
        F.when(leaked, labels["leaked"])
        .when(restored, labels["restored"])
        .when(uncut, labels["uncut"])
        .when(cut, labels["cut"])
        .when(edition.isNotNull() & (edition != ""), edition)
        .when(code_is_uncut, labels["uncut"])
        .otherwise(labels["cut"])
    )


def clean_list(c: Column | str) -> Column:
    """Comma text: trimmed entries, blanks dropped, first occurrence kept."""
    return F.array_join(text_list(c), ",")


def derive_country(
    edition: Column | str, code: Column | str, edition_map: dict[str, str], code_pattern: str, code_country: str,
    default: str,
) -> Column:
    """Country from the edition label, else from a code pattern, else the default."""
    return (
        F.when(as_col(edition).isin(*edition_map), literal_map(edition_map)[as_col(edition)])
        .when(as_col(code).rlike(code_pattern), code_country)
        .otherwise(default)
    )


def limit_people(c: Column | str, n: int, more: str = "") -> Column:
    """First ``n`` names of a comma text plus a suffix when names were left out."""
    names = F.split(as_col(c), ",")
    kept = F.concat(F.array_join(F.slice(names, 1, n), ","), F.lit(more))
    return F.when(F.size(names) > n, kept).otherwise(as_col(c))


# Labels that introduce a 13-digit article number.
BARCODE_PATTERN = "(?i)(?:EAN|JAN|ISBN(?:-13)?)\\s*[：:﹕]?\\s*([0-9][0-9\\-\\s]{10,20})"
_INVISIBLE = "[\\u200b-\\u200f\\u202a-\\u202e\\u2066-\\u2069\\ufeff]"


def extract_barcodes(c: Column | str) -> Column:
    """Labelled 13-digit numbers of a text: digits only, distinct, in order."""
    text = F.replace(F.regexp_replace(as_col(c), _INVISIBLE, ""), F.lit("\u00a0"), F.lit(" "))
    found = F.regexp_extract_all(text, F.lit(BARCODE_PATTERN), 1)
    digits = F.transform(found, lambda x: F.regexp_replace(x, "\\D", ""))
    return F.array_distinct(F.filter(digits, lambda x: F.length(x) == 13))


def is_valid_ean13(c: Column | str) -> Column:
    """Checksum of a 13-digit article number."""
    digits = F.regexp_replace(as_col(c), "\\D", "")
    total = sum(
        (F.substring(digits, i + 1, 1).try_cast("int") * (1 if i % 2 == 0 else 3) for i in range(12)), F.lit(0)
    )
    check = (10 - total % 10) % 10
    return F.coalesce((F.length(digits) == 13) & (check == F.substring(digits, 13, 1).try_cast("int")), F.lit(False))
