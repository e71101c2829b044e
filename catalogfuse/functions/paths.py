"""Facts read from a file path."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogfuse.functions.basics import alternation, as_col, contains_any, first_hit, replace_each, sealed
from catalogfuse.functions.codes import strip_noise


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(as_col(path), "/"), -1)


def parent_dir(path: Column | str) -> Column:
    return F.regexp_extract(as_col(path), "^(.*)/[^/]*$", 1)


def extension(path: Column | str) -> Column:
    """Lower-case extension with its dot; '' when there is none."""
    return F.lower(F.regexp_extract(file_name(path), "^.+(\\.[^.]*)$", 1))


def ancestors(path: Column | str) -> Column:
    """Every directory above the path, root first, component-wise."""
    parts = F.split(parent_dir(path), "/")
    return F.filter(
        F.transform(parts, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/")), lambda d: d != ""
    )


def part_number(
    df: DataFrame,
    stem: Column | str,
    code: Column | str,
    tokens: Sequence[str] = (),
    separators: str = "_ .",
    long_digits: bool = True,
    letters: bool = True,
    letter_c: bool = False,
    middle_digit: bool = True,
    numbered_words: Sequence[str] = ("vol", "case", "no"),
    out: str = "part",
) -> DataFrame:
    """Add the disc / part index of a file, 0 for none.

    Four patterns in order: ``cd12`` / ``part3`` / ``hd2``; a trailing number; a trailing letter a-o;
    a single digit between separators. ``separators`` are treated as '-'; a number behind one of ``numbered_words`` is no part.
    """
    name = F.replace(strip_noise(stem, tokens, "-"), as_col(code), F.lit("-"))
    name = F.trim(F.replace(name, F.lit("--"), F.lit("-")))
    name = replace_each(name, [(s, "-") for s in separators])
    name = F.concat(F.lower(name), F.lit("."))
    staged = df.withColumn("_name", F.regexp_replace(name, f"({alternation(numbered_words)})[-.]?\\d+", ""))
    name = F.col("_name")

    marked = F.regexp_extract(name, "[-_ .](cd|part|hd)([0-9]{1,2})", 2)
    tail_re, letter_re, middle_re = "-([0-9]{1,2})\\.?$", "(-|\\d{2,}|\\.)([a-o])\\.?$", "-([0-9])[^a-z0-9]"
    tail = F.regexp_extract(name, tail_re, 1)
    letter = F.regexp_extract(name, letter_re, 2)
    middle = F.regexp_extract(name, middle_re, 1)

    def number(c: Column) -> Column:
        return F.coalesce(c.try_cast("int"), F.lit(0))

    tail_value = number(tail) if long_digits else F.when(F.length(tail) == 1, number(tail)).otherwise(0)
    letter_index = F.when(letter == "", 0).otherwise(F.ascii(letter) - 96)
    letter_value = letter_index if letter_c else F.when(letter == "c", 0).otherwise(letter_index)
    cases = [(number(marked) > 0, number(marked)), (tail != "", tail_value)]
    if letters:
        cases.append((letter != "", letter_value))
    if middle_digit:
        cases.append((middle != "", number(middle)))
    part = first_hit(cases, F.lit(0)).cast("int").alias(out)
    return sealed(staged, part, keep=[c for c in df.columns if c != out])


def part_suffix(part: Column | str, style: str = "-cd") -> Column:
    """File-name suffix of a part number; '' for 0."""
    part = as_col(part)
    return F.when(part > 0, F.concat(F.lit(style), part.cast("string"))).otherwise("")


@dataclass(frozen=True)
class EditionWords:
    """Words that mark an edition in a path; label values are the caller's."""

    restored: Sequence[str] = (".restored",)
    regional: Sequence[str] = ()
    leaked: Sequence[str] = ("leaked",)
    uncut: Sequence[str] = ("uncut",)
    cut: Sequence[str] = ()
    labels: dict[str, str] = field(
        default_factory=lambda: {
            "restored": "restored",
            "regional": "regional",
            "leaked": "leaked",
            "uncut": "uncut",
            "cut": "cut",
        }
    )


def edition_from_path(path: Column | str, words: EditionWords, code_is_uncut: Column | None = None) -> Column:
    """Edition by precedence: restored, regional, leaked, uncut (by word or code), cut; NULL if none."""
    lower = F.lower(as_col(path))
    uncut = contains_any(lower, words.uncut)
    if code_is_uncut is not None:
        uncut = uncut | code_is_uncut
    return first_hit(
        [
            (contains_any(lower, words.restored), F.lit(words.labels["restored"])),
            (contains_any(lower, words.regional), F.lit(words.labels["regional"])),
            (contains_any(lower, words.leaked), F.lit(words.labels["leaked"])),
            (uncut, F.lit(words.labels["uncut"])),
            (contains_any(lower, words.cut), F.lit(words.labels["cut"])),
        ],
        F.lit(None).cast("string"),
    )


# Resolution words and the height they stand for, tried in order.
HEIGHT_WORDS = (
    (("8K",), 4000),
    (("4K", "UHD"), 2000),
    (("1440P", "QHD"), 1440),
    (("1080P", "FHD"), 1080),
    (("960P",), 960),
    (("720P", "HD"), 720),
)
# Height thresholds and the two naming styles (by height, by class).
BUCKETS = (
    (4000, "8K", "UHD8"),
    (2000, "4K", "UHD"),
    (1400, "1440P", "QHD"),
    (1000, "1080P", "FHD"),
    (900, "960P", "HD"),
    (700, "720P", "HD"),
    (500, "540P", "qHD"),
    (400, "480P", "480P"),
    (300, "360P", "360P"),
    (100, "144P", "144P"),
)


def height_from_path(path: Column | str, code: Column | str, tokens: Sequence[str] = ()) -> Column:
    """Picture height named by a path, 0 when it names none; the item code never counts."""
    ordered = sorted({t.upper() for t in tokens if t}, key=lambda t: (-len(t), t))
    text = replace_each(F.upper(as_col(path)), [(t, "") for t in ordered])
    code = F.upper(as_col(code))
    short = F.nullif(F.regexp_extract(code, "\\d{3,}([A-Z]+-\\d+)", 1), F.lit(""))
    text = F.when(F.length(code) > 0, F.replace(text, code, F.lit("-"))).otherwise(text)
    text = F.when(short.isNotNull(), F.replace(text, short, F.lit("-"))).otherwise(text)
    name = F.element_at(F.split(text, "/"), -1)
    cases = [
        (text.rlike(f"(?<![A-Z0-9])(?:{'|'.join(words)})(?![A-Z0-9])"), F.lit(height))
        for words, height in HEIGHT_WORDS
    ]
    cases.append((name.rlike("(?:^|[-_ .\\[])(?:4K60FPS|4KS)(?=\\.[^.\\\\/]+$)"), F.lit(2000)))
    cases.append((name.rlike("(?:^|[-_ .\\[])U(?:C)?-?4K(?=\\.[^.\\\\/]+$)"), F.lit(2000)))
    return first_hit(cases, F.lit(0))


def resolution_bucket(height: Column | str, style: str = "height") -> Column:
    """Resolution label of a height; '' below the lowest threshold."""
    height = as_col(height)
    column = 1 if style == "height" else 2
    return first_hit([(height >= b[0], F.lit(b[column])) for b in BUCKETS], F.lit(""))


def subtitle_token(
    stem: Column | str, tokens: Sequence[str], negative: Sequence[str] = (), ignored: Sequence[str] = ("CD",)
) -> Column:
    """A subtitle token stands in the upper-case file name (``ignored`` words removed first)."""
    name = F.concat(replace_each(F.upper(as_col(stem)), [(w.upper(), "") for w in ignored]), F.lit("."))
    return contains_any(name, [t.upper() for t in tokens]) & ~contains_any(as_col(stem), negative)


def output_paths(
    root: Column | str, folder: Column | str, name: Column | str, ext: Column | str, simple_assets: bool = False
) -> Column:
    """Target directory, file, sidecar and three asset paths of an item as one struct."""
    root, folder, name = as_col(root), as_col(folder), as_col(name)
    has_folder = folder.isNotNull() & (folder != "")
    target = F.when(has_folder, F.concat_ws("/", root, folder)).otherwise(root)

    def asset(kind: str) -> Column:
        full = F.concat(name, F.lit(f"-{kind}.jpg"))
        if not simple_assets:
            return F.concat_ws("/", target, full)
        return F.concat_ws("/", target, F.when(has_folder, F.lit(f"{kind}.jpg")).otherwise(full))

    return F.struct(
        target.alias("dir"),
        F.concat(target, F.lit("/"), name, F.lower(as_col(ext))).alias("file"),
        F.concat(target, F.lit("/"), name, F.lit(".nfo")).alias("sidecar"),
        asset("poster").alias("poster"),
        asset("thumb").alias("thumb"),
        asset("fanart").alias("fanart"),
    )


def is_scannable(path: Column | str) -> Column:
    """Not a dotfile, trailer or theme video."""
    name = file_name(path)
    return ~(name.rlike("^\\..+") | contains_any(name, ("trailer.", "trailers.", "theme_video.")))


@dataclass(frozen=True)
class CleanupRules:
    ignore_ext: Sequence[str] = ()
    ignore_contains: Sequence[str] = ()
    ext: Sequence[str] = ()
    names: Sequence[str] = ()
    contains: Sequence[str] = ()
    max_kb: int | None = None


def needs_cleanup(path: Column | str, size: Column | str, rules: CleanupRules) -> Column:
    """Two ignore rules first; then extension, exact name, part of name, or small size."""
    name, ext = file_name(path), F.regexp_extract(file_name(path), "^.+(\\.[^.]*)$", 1)
    remove = ext.isin(*rules.ext) | name.isin(*rules.names) | contains_any(name, rules.contains)
    if rules.max_kb is not None:
        remove = remove | (as_col(size) <= rules.max_kb * 1024)
    return ~(ext.isin(*rules.ignore_ext) | contains_any(name, rules.ignore_contains)) & remove
