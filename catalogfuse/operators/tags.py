"""Tag lists of items."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogfuse.functions.basics import as_col, distinct_in_order, replace_each
from catalogfuse.functions.text import half_width
from catalogfuse.operators.aliases import canonicalize_list

# Resolution words removed from tags before the file's own one is added.
RESOLUTION_TAGS = ("144P", "360P", "480P", "540P", "720P", "960P", "1080P", "1440P", "2160P", "4K", "8K")


@dataclass(frozen=True)
class TagOptions:
    """Which groups of tags to add, and how they are written.

    ``include`` may hold people, prefix, subtitle, edition, series, maker, label. A template is text
    in which the group's name stands for its value.
    """

    include: Sequence[str] = ("people", "prefix", "subtitle", "edition", "series", "maker", "label")
    people_whitelist: Sequence[str] = ()
    templates: dict[str, str] = field(default_factory=lambda: {g: g for g in ("people", "series", "maker", "label")})
    drop_words: Sequence[str] = ()
    subtitle_tag: str = "subtitled"
    unknown_prefix: str = "unknown"


def build_tags(
    df: DataFrame, options: TagOptions, out: str = "tags", aliases: DataFrame | None = None,
    lang: str | None = None, keys: Sequence[str] = ("item_code",), delete_marker: str | None = None,
) -> DataFrame:
    """Complete tag list: own tags (edition words out, mapped), people and code prefix in front,
    subtitle, edition, series, maker and label behind; distinct in order.

    Reads ``tags, people, letters, has_sub, edition, series, maker, label``; maker and label fill in
    for each other.
    """
    own = F.transform("tags", lambda t: replace_each(t, [(w, "") for w in options.drop_words]))
    staged = df.withColumn("_own", distinct_in_order(F.transform(own, lambda x: F.trim(x))))
    if aliases is not None:
        staged = canonicalize_list(staged, "_own", aliases, lang, keys, delete_marker=delete_marker)

    def filled(group: str, value: Column) -> Column:
        return F.replace(F.lit(options.templates.get(group, group)), F.lit(group), value)

    def one(group: str, value: Column) -> Column:
        value = F.nullif(value, F.lit(""))
        return F.array_compact(F.array(value)) if group in options.include else F.array().cast("array<string>")

    people = F.coalesce(F.col("people"), F.array().cast("array<string>"))
    if options.people_whitelist:
        people = F.filter(people, lambda p: p.isin(*options.people_whitelist))
    # Each person goes in front of the ones before, so the list is in reverse.
    people_tags = F.reverse(F.transform(people, lambda p: filled("people", p)))
    if "people" not in options.include:
        people_tags = F.array().cast("array<string>")
    maker = F.coalesce(F.nullif("maker", F.lit("")), F.nullif("label", F.lit("")))
    label = F.coalesce(F.nullif("label", F.lit("")), F.nullif("maker", F.lit("")))
    series = F.nullif("series", F.lit(""))
    parts = [
        one("prefix", F.when(F.col("letters") != options.unknown_prefix, F.col("letters"))),
        people_tags,
        F.col("_own"),
        one("subtitle", F.when(F.col("has_sub"), F.lit(options.subtitle_tag))),
        one("edition", F.col("edition")),
        one("series", filled("series", series)),
        one("maker", filled("maker", maker)),
        one("label", filled("label", label)),
    ]
    tags = distinct_in_order(F.transform(F.concat(*parts), lambda x: F.trim(x)))
    kept = [F.col(c) for c in df.columns if c != out]
    return staged.select(*kept, tags.alias(out))


def resolution_tags(tags: Column | str, definition: Column | str, codec: Column | str | None = None) -> Column:
    """Tags without resolution words, the file's definition (and codec) in front."""
    pairs = [(w, "") for word in RESOLUTION_TAGS for w in (word, word.lower())]
    cleaned = F.filter(F.transform(as_col(tags), lambda t: replace_each(t, pairs)), lambda t: t != "")
    front = [F.nullif(as_col(definition), F.lit(""))]
    if codec is not None:
        new = F.nullif(as_col(codec), F.lit(""))
        front.insert(0, F.when(~F.array_contains(cleaned, F.coalesce(new, F.lit(""))) & front[0].isNotNull(), new))
    return F.concat(F.array_compact(F.array(*front)), cleaned)


def drop_quality_tags(tags: Column | str, quality_words: Sequence[str]) -> Column:
    """Inner ``1080p``-like tags and trailing or inner quality words out of a comma text."""
    text = F.regexp_replace(as_col(tags), ",\\d+[kKpP],", ",")
    for word in quality_words:
        text = F.when(text.endswith("," + word), F.replace(text, F.lit("," + word), F.lit(""))).otherwise(text)
        text = F.replace(text, F.lit(f",{word},"), F.lit(","))
    return text


def tag_key(c: Column) -> Column:
    """Comparison key of tags: width folded, trimmed, lower case."""
    return F.lower(F.trim(half_width(c)))


def _template_tag(tag: Column, template: str, placeholder: str) -> Column:
    if placeholder not in template:
        return F.lit(False)
    prefix, suffix = (part.strip().lower() for part in template.split(placeholder, 1))
    if not prefix and not suffix:
        return F.lit(False)
    key = tag_key(tag)
    middle = F.trim(F.substring(key, F.lit(len(prefix) + 1), F.length(key) - len(prefix) - len(suffix)))
    return key.startswith(prefix) & key.endswith(suffix) & (middle != "")


def prioritize_tags(
    tags: Column | str, section: Sequence[str], series_tag: Column | None = None, series_template: str = "",
    placeholder: str = "series", shuffle_by: Column | None = None,
) -> Column:
    """Priority tags first, then series tags, then the rest; unchanged with fewer than two tags or no
    priority tag.

    ``shuffle_by`` mixes the priority tags by the MD5 of it and the tag: random-looking, yet the
    same on every run. Without it they keep their order.
    """
    tags = as_col(tags)
    keys = [s.strip().lower() for s in section]
    is_priority = lambda t: tag_key(t).isin(*keys)

    def is_series(t: Column) -> Column:
        own = F.lit(False) if series_tag is None else F.coalesce(tag_key(t) == tag_key(series_tag), F.lit(False))
        return ~is_priority(t) & (own | _template_tag(t, series_template, placeholder))

    first = F.filter(tags, is_priority)
    if shuffle_by is not None:
        keyed = F.transform(first, lambda t: F.struct(F.md5(F.concat_ws("|", shuffle_by.cast("string"), t)).alias("h"), t.alias("t")))
        mixed = F.transform(F.array_sort(keyed), lambda s: s["t"])
    else:
        mixed = first
    series = F.filter(tags, is_series)
    rest = F.filter(tags, lambda t: ~is_priority(t) & ~is_series(t))
    return F.when((F.size(tags) < 2) | (F.size(first) == 0), tags).otherwise(F.concat(mixed, series, rest))
