"""Sidecar records: one XML document per item, stored as rows of a table.

A dataset of XML rows replaces a file per record: millions of tiny files are the one layout a
cluster cannot read or write well. ``read_sidecar_files`` still reads such a folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogfuse.functions.basics import as_col
from catalogfuse.functions.people import only_own_tags
from catalogfuse.functions.text import line_breaks

_TEXT = (
    "title", "originaltitle", "num", "originalplot", "plot", "outline", "release", "releasedate", "premiered", "year",
    "runtime", "rating", "series", "studio", "maker", "publisher", "label", "cover", "poster", "trailer", "votes",
)
SIDECAR = T.StructType(
    [T.StructField(n, T.StringType()) for n in _TEXT]
    + [
        T.StructField("actor", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())]))),
        T.StructField("director", T.ArrayType(T.StringType())),
        T.StructField("tag", T.ArrayType(T.StringType())),
    ]
)
# The trailer of a translated outline (the group is the translator).
TRANSLATED_BY = "(?s)(?:\\n\\s*\\n|<br>\\s*<br>)由\\s*(.+?)\\s*提供翻译\\s*$"


def read_sidecar_files(spark: SparkSession, path: str, row_tag: str = "movie") -> DataFrame:
    """Documents of a folder, one row per document."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(SIDECAR).load(path)


def parse_sidecars(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Parse a column of XML documents; the row's other columns are kept."""
    options = {"mode": "PERMISSIVE", "rowTag": "movie"}
    parsed = df.withColumn("_d", F.from_xml(F.col(xml), SIDECAR, options))
    return parsed.select(*[c for c in df.columns if c != xml], "_d.*")


def sidecar_items(docs: DataFrame, fallback_code: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(item rows, quarantined rows). A document without a title counts as damaged.

    Dates fall back release -> releasedate -> premiered, maker and label likewise; the part suffix
    and the code prefix leave the titles; the outline loses its translator note and the original
    plot embedded in it.
    """
    some = lambda n: F.nullif(F.col(n), F.lit(""))
    code = F.coalesce(some("num"), F.col(fallback_code)) if fallback_code else some("num")
    base = docs.withColumn("item_code", code)
    bad = base.where(some("title").isNull())
    good = base.where(some("title").isNotNull())

    cut_code = lambda c: F.trim(F.replace(c, F.concat(F.coalesce("item_code", F.lit("")), F.lit(" ")), F.lit("")))
    raw_outline = F.trim(line_breaks(F.coalesce(some("plot"), some("outline"), F.lit(""))))
    note = F.nullif(F.regexp_extract(raw_outline, TRANSLATED_BY, 1), F.lit(""))
    outline = F.regexp_replace(raw_outline, TRANSLATED_BY, "")
    original = F.coalesce("originalplot", F.lit(""))
    at = F.call_function("instr", outline, original)
    without = F.concat(F.substring(outline, F.lit(1), at - 1), F.substring(outline, at + F.length(original), F.length(outline)))
    outline = F.when((original != "") & (at > 0), F.regexp_replace(F.btrim(without, F.lit(" \n")), "(?:\\n\\s*){3,}", "\n\n")).otherwise(outline)
    date = F.btrim(F.replace(F.coalesce(some("release"), some("releasedate"), some("premiered")), F.lit("/"), F.lit("-")), F.lit(". "))
    ymd = "(\\d{4})-(\\d{1,2})-(\\d{1,2})"
    padded = F.concat_ws("-", F.regexp_extract(date, ymd, 1), F.lpad(F.regexp_extract(date, ymd, 2), 2, "0"), F.lpad(F.regexp_extract(date, ymd, 3), 2, "0"))
    people = F.filter(F.transform(F.coalesce("actor", F.array().cast(SIDECAR["actor"].dataType)), lambda a: a["name"]), lambda n: n.isNotNull())
    tags = F.coalesce("tag", F.array().cast("array<string>"))
    extra = [c for c in docs.columns if c not in SIDECAR.fieldNames()]
    items = good.select(
        *extra,
        "item_code",
        cut_code(F.regexp_replace("title", " (CD)?\\d{1}$", "")).alias("title"),
        cut_code(F.coalesce("originaltitle", F.lit(""))).alias("originaltitle"),
        outline.alias("outline"),
        note.alias("outline_from"),
        F.nullif(original, F.lit("")).alias("originalplot"),
        people.alias("people"),
        tags.alias("tags"),
        only_own_tags(tags, people).alias("own_tags"),
        F.when((F.length(date) < 10) & date.rlike(ymd), padded).otherwise(date).alias("release"),
        some("year").alias("year"),
        some("runtime").alias("runtime"),
        some("rating").alias("score"),
        F.coalesce("director", F.array().cast("array<string>")).alias("directors"),
        some("series").alias("series"),
        F.coalesce(some("studio"), some("maker")).alias("maker"),
        F.coalesce(some("publisher"), some("label")).alias("label"),
        some("cover").alias("thumb"),
        some("poster").alias("poster"),
        some("trailer").alias("trailer"),
        some("votes").alias("wanted"),
    )
    return items, bad


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    return sidecar_items(read_sidecar_files(spark, path))[0]


def id_tag(source: str) -> str:
    """Element name of a source's id: leading digits are dropped."""
    return f"{source.lstrip('0123456789') or 'site'}id"


# Selectable parts of a sidecar.
PARTS = (
    "plot", "outline", "originalplot", "tagline", "premiered", "releasedate", "release", "originaltitle", "sorttitle",
    "mpaa", "customrating", "countrycode", "actor", "director", "rating", "criticrating", "votes", "year", "runtime",
    "set_people", "set_series", "series", "studio", "maker", "publisher", "label", "tag", "genre", "poster", "cover", "trailer",
)


def _escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def sidecar_xml(
    df: DataFrame,
    include: Sequence[str] = PARTS,
    id_sources: Sequence[str] = (),
    fallback_id: str | None = None,
    certification: tuple[str, str, str] = ("JP", "JP-18+", "NC-17"),
    unknown_person: str = "unknown",
    tagline: str = "release",
    title: str = "title",
) -> Column:
    """XML document of an item row as a text column; missing columns are left out.

    ``include`` selects the parts; ``id_sources`` are the keys of ``external_ids`` that get an id
    element; ``fallback_id`` names a source whose missing id is replaced by the code to search for.
    """
    have = set(df.columns)
    empty = F.array().cast("array<string>")

    def text(name: str) -> Column:
        return F.nullif(F.col(name).cast("string"), F.lit("")) if name in have else F.lit(None).cast("string")

    def element(tag: str, value: Column) -> Column:
        return F.concat(F.lit(f"  <{tag}>"), _escaped(value), F.lit(f"</{tag}>\n"))

    def repeated(tag: str, name: str, wrap: str | None = None, extra: str = "") -> Column:
        values = F.coalesce(F.col(name), empty) if name in have else empty
        if tag == "actor":
            values = F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(unknown_person)))
        if wrap:
            one = lambda v: F.concat(F.lit(f"  <{tag}>\n    <{wrap}>"), _escaped(v), F.lit(f"</{wrap}>\n{extra}  </{tag}>\n"))
        else:
            one = lambda v: element(tag, v)
        return F.array_join(F.transform(F.filter(values, lambda v: v != ""), one), "")

    def cdata(tag: str, value: Column) -> Column:
        body = F.replace(value, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
        return F.concat(F.lit(f"  <{tag}><![CDATA["), body, F.lit(f"]]></{tag}>\n"))

    code, original = text("item_code"), text("originaltitle")
    same = code == text("title")
    home, home_rating, other_rating = certification
    rating = F.when(text("country") == home, home_rating).otherwise(other_rating)
    score = text("score").try_cast("double")
    release, outline = text("release"), line_breaks(text("outline"))
    full_original = F.when(same, original).otherwise(F.concat(code, F.lit(" "), F.coalesce(original, F.lit(""))))
    parts = [
        ("plot", cdata("plot", outline)),
        ("outline", cdata("outline", outline)),
        ("originalplot", cdata("originalplot", line_breaks(text("originalplot")))),
        ("tagline", element("tagline", F.replace(F.lit(tagline), F.lit("release"), release))),
        ("premiered", element("premiered", release)),
        ("releasedate", element("releasedate", release)),
        ("release", element("release", release)),
        (None, element("num", code)),
        (None, element("title", text(title))),
        ("originaltitle", element("originaltitle", full_original)),
        ("sorttitle", element("sorttitle", F.when(same, code).otherwise(full_original))),
        ("mpaa", element("mpaa", rating)),
        ("customrating", element("customrating", rating)),
        ("countrycode", element("countrycode", text("country"))),
        ("actor", repeated("actor", "people", "name", "    <type>Actor</type>\n")),
        ("director", repeated("director", "directors")),
        ("rating", element("rating", score.cast("string"))),
        ("criticrating", element("criticrating", F.floor(score * 10).cast("string"))),
        ("votes", element("votes", text("wanted"))),
        ("year", element("year", text("year"))),
        ("runtime", element("runtime", F.replace(text("runtime"), F.lit(" "), F.lit("")))),
        ("set_people", repeated("set", "people", "name")),
        ("set_series", F.concat(F.lit("  <set>\n    <name>"), _escaped(text("series")), F.lit("</name>\n  </set>\n"))),
        ("series", element("series", text("series"))),
        ("studio", element("studio", text("maker"))),
        ("maker", element("maker", text("maker"))),
        ("publisher", element("publisher", text("label"))),
        ("label", element("label", text("label"))),
        ("tag", repeated("tag", "tags")),
        ("genre", repeated("genre", "tags")),
        ("poster", element("poster", text("poster"))),
        ("cover", element("cover", text("thumb"))),
        ("trailer", element("trailer", text("trailer"))),
    ]
    body = [F.coalesce(c, F.lit("")) for name, c in parts if name is None or name in include]
    if "external_ids" in have:
        for source in id_sources:
            value = F.nullif(F.col("external_ids")[source], F.lit(""))
            body.append(F.coalesce(element(id_tag(source), value), F.lit("")))
        if fallback_id:
            missing = F.coalesce(F.nullif(F.col("external_ids")[fallback_id], F.lit("")), F.lit("")) == ""
            body.append(F.when(missing, element(f"{id_tag(fallback_id)[:-2]}searchid", code)).otherwise(""))
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<movie>\n'
    return F.concat(F.lit(head), *body, F.lit("</movie>\n"))


def write_sidecars(items: DataFrame, path: str, include: Sequence[str] = PARTS, mode: str = "overwrite", **options) -> None:
    """Write (item_code, xml) rows as parquet, spread by code."""
    items.select("item_code", sidecar_xml(items, include, **options).alias("xml")).write.mode(mode).parquet(path)


def record_edition(tags: Column | str, rules: Sequence[tuple[Sequence[str], str]]) -> Column:
    """Edition named by an existing record's tags: first rule with a word in them."""
    from catalogfuse.functions.basics import contains_any, first_hit

    joined = F.array_join(as_col(tags), ",")
    return first_hit([(contains_any(joined, words), F.lit(label)) for words, label in rules])
