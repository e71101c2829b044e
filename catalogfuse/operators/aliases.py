"""Alias tables: ``aliases(ord, canonical MAP<language, name>, keywords ARRAY<STRING>, href)``.

``ord`` is document order; the first row that holds a key wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogfuse.functions.basics import distinct_in_order
from catalogfuse.functions.text import alias_key, strip_title_affixes


def alias_index(aliases: DataFrame, match_names: bool = True) -> DataFrame:
    """One row per folded key: the first alias row holding it. Keys are unique on purpose, so a
    join against this table can never multiply rows."""
    names = F.coalesce(F.col("keywords"), F.array().cast("array<string>"))
    if match_names:
        names = F.concat(names, F.map_values("canonical"))
    keys = F.array_distinct(F.transform(names, alias_key))
    return (
        aliases.select("ord", "canonical", "keywords", "href", F.explode(keys).alias("akey"))
        .where(F.col("akey") != "")
        .groupBy("akey")
        .agg(F.min(F.struct("ord", F.to_json("canonical").alias("canonical"), "keywords", "href")).alias("hit"))
        .select(
            "akey",
            F.col("hit.ord").alias("ord"),
            F.from_json("hit.canonical", "map<string,string>").alias("canonical"),
            F.col("hit.keywords").alias("keywords"),
            F.col("hit.href").alias("href"),
        )
    )


def _name_in(lang: str, delete_marker: str | None) -> Column:
    name = F.col("canonical")[lang]
    return F.replace(name, F.lit(delete_marker), F.lit("")) if delete_marker else name


def canonicalize(
    df: DataFrame, col: str, aliases: DataFrame, lang: str, out: str | None = None,
    delete_marker: str | None = None, match_names: bool = True,
) -> DataFrame:
    """Canonical name of ``col`` in one language; a miss keeps the name, the delete marker gives ''.

    The index has unique keys and no hint: small tables are broadcast by the optimizer, large ones
    are shuffled with AQE splitting hot names on the data side.
    """
    index = alias_index(aliases, match_names).select(
        "akey", F.lit(True).alias("_hit"), _name_in(lang, delete_marker).alias("_name")
    )
    out = out or col
    value = F.when(F.col("_hit"), F.col("_name")).otherwise(F.col(col))
    joined = df.withColumn("akey", alias_key(col)).join(index, "akey", "left")
    kept = [F.col(c) for c in df.columns if c != out]
    return joined.select(*kept, value.alias(out))


def canonicalize_list(
    df: DataFrame, col: str, aliases: DataFrame, lang: str, keys: Sequence[str], out: str | None = None,
    delete_marker: str | None = None, match_names: bool = True,
) -> DataFrame:
    """Canonical names of an array column: each entry mapped, deleted entries dropped, distinct in order.

    ``keys`` identify a row. Only the keys and the entries are exploded and shuffled; a group is one
    row's own array.
    """
    out = out or col
    index = alias_index(aliases, match_names).select(
        "akey", F.lit(True).alias("_hit"), _name_in(lang, delete_marker).alias("_name")
    )
    long = df.select(*keys, F.posexplode(col).alias("_pos", "_v")).withColumn("akey", alias_key("_v"))
    value = F.when(F.col("_hit"), F.col("_name")).otherwise(F.col("_v"))
    mapped = (
        long.join(index, "akey", "left")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_pos", value.alias("_n")))).alias("_l"))
        .select(*keys, distinct_in_order(F.transform("_l", lambda s: s["_n"])).alias("_out"))
    )
    kept = [F.col(c) for c in df.columns if c != out]
    return df.join(mapped, list(keys), "left").select(
        *kept, F.coalesce("_out", F.array().cast("array<string>")).alias(out)
    )


def expand_keywords(df: DataFrame, col: str, aliases: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """All alias keywords of the names in an array column (the name itself on a miss)."""
    index = alias_index(aliases, match_names=False).select("akey", F.col("keywords").alias("_kw"))
    long = df.select(*keys, F.posexplode(col).alias("_pos", "_v")).withColumn("akey", alias_key("_v"))
    names = (
        long.join(index, "akey", "left")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_kw", F.array("_v")).alias("_n")))).alias("_l"))
        .select(*keys, distinct_in_order(F.flatten(F.transform("_l", lambda s: s["_n"]))).alias(out))
    )
    return df.join(names, list(keys), "left")


def alias_prefix_lookup(df: DataFrame, names: DataFrame, col: str = "name") -> DataFrame:
    """Person name for an alias: exact, else the first alias that starts with the key.

    ``names(ord, name, alias)``. Each alias is expanded to its prefixes and reduced to the first
    alias per prefix, so the range join becomes an equi join with unique keys on the right; the sum
    of alias lengths bounds its size. ``matched_by`` is 'exact', 'prefix' or NULL.
    """
    hit = F.struct("ord", "name", "alias")
    exact = names.groupBy(F.col("alias").alias(col)).agg(F.min(hit).alias("_e"))
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.length("alias")), lambda i: F.substring("alias", F.lit(1), i)))
    by_prefix = (
        names.where(F.length("alias") > 0)
        .select("ord", "name", "alias", prefixes.alias(col))
        .groupBy(col)
        .agg(F.min(hit).alias("_p"))
    )
    found = F.coalesce("_e", "_p")
    return (
        df.join(exact, col, "left")
        .join(by_prefix, col, "left")
        .select(
            *df.columns,
            found["name"].alias("person"),
            found["alias"].alias("alias"),
            F.when(F.col("_e").isNotNull(), "exact").when(F.col("_p").isNotNull(), "prefix").alias("matched_by"),
        )
    )


def attach_portraits(
    people: DataFrame, files: DataFrame, aliases: DataFrame | None = None, lang: str = "jp",
    extensions: Sequence[str] = (".jpg", ".png"), only_missing: bool = True, all_keywords: bool = False,
) -> DataFrame:
    """Portrait file of every person by canonical name, extensions in order.

    ``people(name, has_image)``, ``files(path)``. Names with a blank are skipped, as are people with
    an image when ``only_missing``. Several files of one name: first folder in sorted order.
    ``all_keywords`` tries every alias keyword after the name itself.
    """
    from catalogfuse.functions.paths import file_name, parent_dir

    todo = people.where(~F.col("name").contains(" "))
    if only_missing:
        todo = todo.where(~F.col("has_image"))
    index = (
        files.select(file_name("path").alias("_file"), "path")
        .groupBy("_file")
        .agg(F.min_by("path", F.struct(F.split(parent_dir("path"), "/").alias("d"), F.col("path").alias("p"))).alias("portrait"))
    )
    wanted = todo.select("name", F.array("name").alias("_names"))
    if aliases is not None and all_keywords:
        wanted = expand_keywords(wanted, "_names", aliases, ["name"], "_kw").select(
            "name", distinct_in_order(F.concat("_names", F.coalesce("_kw", F.array().cast("array<string>")))).alias("_names")
        )
    elif aliases is not None:
        wanted = canonicalize(todo.select("name", F.col("name").alias("_n")), "_n", aliases, lang, match_names=False)
        wanted = wanted.select("name", F.array("_n").alias("_names"))
    spellings = F.flatten(
        F.transform("_names", lambda n: F.array(*[F.concat(n, F.lit(e)) for e in extensions]))
    )
    found = (
        wanted.select("name", F.posexplode(spellings).alias("_ord", "_file"))
        .join(index, "_file")
        .groupBy("name")
        .agg(F.min_by("portrait", "_ord").alias("portrait"))
    )
    return todo.join(found, "name", "left")


def redundant_aliases(aliases: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Alias rows that say nothing: all languages equal and the only keyword equal to them."""
    first = F.trim(F.col("canonical")[languages[0]])
    same = F.lit(True)
    for lang in languages[1:]:
        same = same & (F.trim(F.col("canonical")[lang]) == first)
    words = F.filter(F.transform("keywords", lambda x: F.trim(x)), lambda k: k != "")
    return aliases.where(same & (F.size(words) == 1) & (F.element_at(F.concat(words, F.array(F.lit(""))), 1) == first))


def redundancy_report(aliases: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Total rows, redundant rows and their share in percent."""
    hits = redundant_aliases(aliases, languages).select("ord", F.lit(1).alias("hit"))
    joined = aliases.select("ord").join(hits, "ord", "left")
    total, found = F.count(F.lit(1)), F.count("hit")
    return joined.agg(
        total.alias("total"), found.alias("redundant"), F.round(found * 100 / total, 2).alias("percent")
    )


def alias_section(
    aliases: DataFrame, start: str, stops: Sequence[str], marker_lang: str, languages: Sequence[str],
    skip: Sequence[str] = (),
) -> DataFrame:
    """Names in the document section from the start row up to the first stop row, minus ``skip``.

    The section is found with two ordinary aggregates (first start, first stop after it), not with
    a running flag over one big sorted partition.
    """
    marker = F.trim(F.col("canonical")[marker_lang])
    begin = aliases.agg(F.min(F.when(marker == start, F.col("ord"))))
    inside = aliases.where(F.col("ord") >= begin.scalar())
    end = inside.agg(F.min(F.when(marker.isin(*stops), F.col("ord"))))
    section = inside.where(F.col("ord") < F.coalesce(end.scalar(), F.lit(2**62)))
    values = F.explode(F.array(*[F.trim(F.col("canonical")[lang]) for lang in languages]))
    names = section.select(values.alias("name")).where(F.col("name").isNotNull() & (F.col("name") != ""))
    if skip:
        names = names.where(~F.col("name").isin(*skip))
    return names.distinct()


def strip_title_names(
    df: DataFrame, aliases: DataFrame, key: str, title: str = "title", code: str = "item_code", people: str = "people", extra: str | None = None,
) -> DataFrame:
    """Titles without the names of their people at the end, whatever alias stands there, and without a leading code.

    A person is looked up as written and as the parts outside brackets; with ``extra`` a second list of names (as a shop
    spells them) is looked up too. Names at the end go one after the other, the longest first, each with the blank before it.
    The alias join is on unique keys; an item's names are those of its own people, so the list that meets its
    title is bounded by the people it has. ``key`` is unique per row.
    """
    none = F.array().cast("array<string>")
    listed = F.coalesce(F.col(people), none)
    if extra:
        listed = F.concat(listed, F.coalesce(F.col(extra), none))
    spelled = F.flatten(F.transform(listed, lambda n: F.regexp_extract_all(n, F.lit("([^()（）]+)"), 1)))
    index = alias_index(aliases).select("akey", "keywords")
    asked = df.select(key, F.explode(F.array_distinct(F.concat(listed, spelled))).alias("_n")).withColumn("akey", alias_key("_n"))
    known = asked.join(index, "akey").select(key, F.explode("keywords").alias("_k")).where("_k <> ''")
    names = known.groupBy(key).agg(F.array_sort(F.collect_set(F.struct((-F.length("_k")).alias("l"), F.col("_k").alias("k")))).alias("_names"))
    joined = df.join(names, key, "left").withColumn("_names", F.transform(F.coalesce("_names", F.array().cast("array<struct<l:int,k:string>>")), lambda x: x["k"]))

    def shorter(text: Column) -> Column:
        hit = F.get(F.filter("_names", lambda n: text.endswith(F.concat(F.lit(" "), n))), F.lit(0))
        return F.when(hit.isNotNull(), F.substring(text, F.lit(1), F.length(text) - F.length(hit) - 1)).otherwise(text)

    # No more steps than the title has blanks.
    blanks = F.length(title) - F.length(F.replace(F.col(title), F.lit(" "), F.lit("")))
    cut = F.aggregate(F.sequence(F.lit(0), blanks), F.col(title), lambda text, _: shorter(text))
    joined = joined.withColumn("_cut", F.when(F.size("_names") > 0, cut).otherwise(F.col(title)))
    return joined.select(*[c for c in df.columns if c != title], strip_title_affixes("_cut", code, none).alias(title))
