"""Joins of the item and inventory tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogfuse.functions.basics import as_col, first_hit
from catalogfuse.functions.paths import ancestors, file_name, parent_dir
from catalogfuse.operators.phrases import phrase_terms
from catalogfuse.operators.substrings import substring_terms


def missing_items(catalog: DataFrame, local: DataFrame) -> DataFrame:
    """Catalogue codes not held locally, and those held without a subtitle that exists.

    ``catalog(item_code, has_download, has_subtitle, ...)``, ``local(item_code, has_subtitle)``.
    Adds ``absent``, ``absent_download``, ``subtitle_wanted``; rows with none of them are dropped.
    """
    held = local.groupBy("item_code").agg(F.max("has_subtitle").alias("_sub"))
    joined = catalog.join(held, "item_code", "left")
    absent = F.col("_sub").isNull()
    return joined.select(
        *catalog.columns,
        absent.alias("absent"),
        (absent & F.col("has_download")).alias("absent_download"),
        (F.col("has_subtitle") & ~F.coalesce("_sub", F.lit(False))).alias("subtitle_wanted"),
    ).where("absent OR subtitle_wanted")


def file_index(files: DataFrame) -> DataFrame:
    """First path per lower-case file name; folders in sorted order, parents before children."""
    order = F.struct(F.split(parent_dir("path"), "/").alias("d"), F.col("path").alias("p"))
    return (
        files.select(F.lower(file_name("path")).alias("_name"), "path")
        .groupBy("_name")
        .agg(F.min(order).alias("_first"))
        .select("_name", F.col("_first.p").alias("match"))
    )


def attach_sidecars(
    inventory: DataFrame, files: DataFrame, names: Column, key: str = "path", out: str = "sidecar"
) -> DataFrame:
    """First existing file among an ordered list of candidate names, case ignored."""
    wanted = inventory.select(key, F.posexplode(F.transform(names, F.lower)).alias("_prio", "_name"))
    found = (
        wanted.join(file_index(files), "_name").groupBy(key).agg(F.min_by("match", "_prio").alias(out))
    )
    return inventory.join(found, key, "left")


def subtitle_flag(
    inventory: DataFrame, files: DataFrame, names: Column, name_token: Column, record_tag: Column | None = None
) -> DataFrame:
    """``has_sub`` and where it was seen: a local file, the name, or the existing record's tag."""
    joined = attach_sidecars(inventory, files, names, out="_sub")
    cases = [(F.col("_sub").isNotNull(), F.lit("file")), (name_token, F.lit("name"))]
    if record_tag is not None:
        cases.append((F.coalesce(record_tag, F.lit(False)), F.lit("record")))
    seen = first_hit(cases, F.lit(None).cast("string"))
    return joined.select(*inventory.columns, seen.alias("sub_from"), seen.isNotNull().alias("has_sub"))


def subtitle_backfill(
    inventory: DataFrame, store: DataFrame, names: Column
) -> DataFrame:
    """Items without a subtitle, and the file of a subtitle store that would fill each."""
    lacking = inventory.where(~F.col("has_sub"))
    return attach_sidecars(lacking, store, names, out="fill_from")


def subtitle_backfill_report(backfill: DataFrame) -> DataFrame:
    lacking, fillable = F.count(F.lit(1)), F.count("fill_from")
    return backfill.agg(
        lacking.alias("lacking"), fillable.alias("fillable"), (lacking - fillable).alias("still_lacking")
    )


def skip_processed(inventory: DataFrame, ledger: DataFrame, status: str = "ok", key: str = "path") -> DataFrame:
    """Inventory rows whose path has no successful ledger entry."""
    return inventory.join(ledger.where(F.col("status") == status).select(key), key, "left_anti")


def assign_root(df: DataFrame, roots: Sequence[str], path: str = "path", out: str = "root") -> DataFrame:
    """First listed root that is the path or an ancestor of it, component-wise; else the first root.

    Roots are configuration, so this is a projection without any shuffle.
    """
    if not roots:
        raise ValueError("no roots given")
    c = as_col(path)
    trimmed = [r.rstrip("/") for r in roots]
    cases = [((c == r) | c.startswith(r + "/"), F.lit(r)) for r in trimmed]
    return df.withColumn(out, first_hit(cases, F.lit(trimmed[0])))


def assign_root_table(df: DataFrame, roots: DataFrame, path: str = "path", out: str = "root") -> DataFrame:
    """The same for a table ``roots(ord, root)`` too long for configuration: ancestors are exploded
    and equi joined."""
    chain = F.concat(ancestors(path), F.array(F.col(path)))
    first = roots.groupBy("root").agg(F.min("ord").alias("ord"))
    found = (
        df.select(path, F.explode(chain).alias("root")).join(first, "root")
        .groupBy(path).agg(F.min_by("root", "ord").alias("_root"))
    )
    spare = roots.agg(F.min_by("root", "ord")).scalar()
    return df.join(found, path, "left").select(
        *[c for c in df.columns if c != out], F.coalesce("_root", spare).alias(out)
    )


def share_by_code(
    inventory: DataFrame,
    resolve: Callable[[DataFrame], DataFrame],
    shareable: Column | None = None,
    file_tags: Column | None = None,
    drop_tags: Sequence[str] = (),
    key: str = "item_code",
) -> DataFrame:
    """Resolve every distinct code once and give the result to each file with that code.

    ``resolve`` maps a one-column frame of codes to item rows. Files that share a record (``shareable``) get their own tags in
    place of those that belong to a file; a file that may not share stands for itself and has the record as it is.
    Every file comes out: ``shared`` tells which it is, ``resolved`` whether its code has a record at all.
    """
    rows = inventory.withColumn("shared", F.lit(True) if shareable is None else F.coalesce(shareable, F.lit(False)))
    items = resolve(rows.where(F.col(key).isNotNull()).select(key).distinct()).withColumn("_found", F.lit(True))
    joined = rows.join(items, key, "left").withColumn("resolved", F.col("_found").isNotNull()).drop("_found")
    if "tags" not in items.columns:
        return joined
    tags = F.filter("tags", lambda t: ~t.isin(*drop_tags)) if drop_tags else F.col("tags")
    if file_tags is not None:
        tags = F.concat(tags, F.filter(file_tags, lambda t: t.isNotNull() & (t != "")))
    return joined.withColumn("tags", F.when(F.col("shared"), tags).otherwise(F.col("tags")))


def lookup_people(items: DataFrame, people_by_code: DataFrame, unknown: Column, key: str = "item_code") -> DataFrame:
    """People of items whose own list is unknown, from a code -> people table."""
    table = people_by_code.groupBy(key).agg(F.min("people").alias("_found"))
    value = F.when(unknown & F.col("_found").isNotNull(), F.col("_found")).otherwise(F.col("people"))
    return items.join(table, key, "left").select(*[c for c in items.columns if c != "people"], value.alias("people"))


def dictionary_terms(
    df: DataFrame, terms: DataFrame, text: Column | str, key: str, mode: str = "word"
) -> DataFrame:
    """Dictionary terms found in a text, case ignored: rows (key, ord, term), distinct.

    ``terms(ord, term)``. 'word' matches whole words: text and terms are cut into words alike, and the text's distinct
    word n-grams, of the lengths that the terms have, are equi joined to the terms, so cost is linear in the text.
    'substring' matches anywhere, by each term's rarest gram (``operators.substrings``).
    """
    if mode == "word":
        return phrase_terms(df, terms, text, key)
    if mode != "substring":
        raise ValueError(f"unknown mode {mode!r}")
    return substring_terms(df, terms, text, key)
