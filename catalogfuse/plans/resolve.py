"""Whole jobs: resolve a library, and report what is missing from it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogfuse.functions import codes, naming, paths, text, values
from catalogfuse.operators import aliases as A
from catalogfuse.operators.classify import ClassRule, classify_items
from catalogfuse.operators.fusion import fuse_fields
from catalogfuse.operators.lookups import missing_items, skip_processed
from catalogfuse.operators.rows import first_wins_dedupe
from catalogfuse.operators.tags import TagOptions, build_tags, resolution_tags
from catalogfuse.operators.translate import Engine, translate
from catalogfuse.schemas import FUSED_FIELDS, Field


@dataclass(frozen=True)
class LibraryOptions:
    """Configuration of :func:`resolve_library`."""

    noise: Sequence[str] = ()
    code_rules: Sequence[codes.CodeRule] = codes.SHAPE_RULES
    editions: paths.EditionWords = field(default_factory=paths.EditionWords)
    class_rules: Sequence[ClassRule] = ()
    default_type: str = "general"
    fields: Sequence[Field] = FUSED_FIELDS
    tags: TagOptions = field(default_factory=TagOptions)
    language: str | None = None
    file_template: str = "{{number}}{% if title %} {{title}}{% endif %}"
    folder_template: str = "{{studio}}/{{number}}"
    max_name: int = 120
    root: str = "/out"


def inventory_facts(inventory: DataFrame, options: LibraryOptions) -> DataFrame:
    """Everything a path tells about its file. A projection: no shuffle."""
    rows = codes.extract_item_code(inventory, tokens=options.noise, rules=options.code_rules)
    stem = codes.file_stem("path")
    rows = paths.part_number(rows, stem, "item_code", options.noise)
    return rows.withColumns(
        {
            "short_code": codes.short_code("item_code"),
            "letters": codes.code_prefix("item_code"),
            "edition": paths.edition_from_path("path", options.editions),
            "definition": paths.resolution_bucket(paths.height_from_path("path", "item_code", options.noise)),
            "filename": stem,
        }
    )


def clean_items(items: DataFrame) -> DataFrame:
    """Text and number clean-up of fused rows, in the order the later steps rely on."""
    cols = {
        c: text.clean_text(c)
        for c in ("title", "originaltitle", "outline", "originalplot", "series", "maker", "label")
        if c in items.columns
    }
    if "runtime" in items.columns:
        cols["runtime"] = values.normalize_runtime("runtime")
    if "score" in items.columns:
        cols["score"] = values.normalize_score("score")
    out = items.withColumns(cols)
    if "label" in out.columns and "maker" in out.columns:
        out = out.withColumn("label", F.coalesce("label", "maker"))
    return out


def resolve_items(
    observations: DataFrame, priority: DataFrame, options: LibraryOptions, aliases: DataFrame | None = None
) -> DataFrame:
    """Fused, cleaned and canonical item rows."""
    items = clean_items(fuse_fields(observations, priority, options.fields))
    if aliases is not None and options.language:
        for col in ("series", "maker", "label"):
            if col in items.columns:
                items = A.canonicalize(items, col, aliases, options.language)
        if "people" in items.columns:
            items = A.canonicalize_list(items, "people", aliases, options.language, ["item_code"], match_names=False)
    return items


def resolve_library(
    inventory: DataFrame,
    observations: DataFrame,
    priority: DataFrame,
    options: LibraryOptions,
    ledger: DataFrame | None = None,
    aliases: DataFrame | None = None,
) -> DataFrame:
    """Inventory to named, tagged items: one row per file with its target path.

    Every file comes out: ``status`` is 'ok', or 'failed' with a ``reason`` and without a target.
    Codes are resolved once and joined back to their files (a code owning very many files meets a
    one-row item, a join AQE can split). Observations are cut to wanted codes before they are fused.
    """
    todo = inventory if ledger is None else skip_processed(inventory, ledger)
    files = classify_items(inventory_facts(todo, options), options.class_rules, options.default_type)
    wanted = files.select("item_code", "item_type").distinct()
    wanted = wanted.where(F.col("item_code").isNotNull())
    items = resolve_items(observations.join(wanted, "item_code"), priority, options, aliases).withColumn("_found", F.lit(True))
    joined = files.join(items, ["item_code", "item_type"], "left")
    no_code = F.col("item_code").isNull() | (F.col("item_code") == "")
    joined = joined.withColumns(
        {
            "status": F.when(F.col("_found"), "ok").otherwise("failed"),
            "reason": F.when(F.col("_found"), F.lit(None).cast("string")).when(no_code, "no code in the path").otherwise("no source has the code"),
        }
    ).drop("_found")
    joined = joined.withColumns(
        {
            "number": F.col("item_code"),
            "studio": F.col("maker") if "maker" in joined.columns else F.lit(None).cast("string"),
            "actor": F.array_join("people", ",") if "people" in joined.columns else F.lit(None).cast("string"),
            "cnword": F.lit(""),
            "moword": F.lit(""),
        }
    )
    needed = {"tags": "array<string>", "people": "array<string>", "series": "string", "maker": "string", "label": "string"}
    for name, kind in needed.items():
        if name not in joined.columns:
            joined = joined.withColumn(name, F.lit(None).cast(kind))
    if "has_sub" not in joined.columns:
        joined = joined.withColumn("has_sub", F.lit(False))
    tagged = build_tags(joined.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))), options.tags)
    context = naming.naming_context(tagged)
    named = naming.render_names(context, options.file_template, out="_file", max_length=options.max_name)
    named = naming.render_names(named, options.folder_template, out="_folder", target="folder", max_length=options.max_name)
    stem = F.concat("_file", paths.part_suffix("part"))
    target = paths.output_paths(F.lit(options.root), "_folder", stem, "ext")
    keep = [c for c in tagged.columns if c not in ("number", "studio", "actor", "cnword", "moword")]
    return named.select(*keep, F.when(F.col("status") == "ok", target).alias("target"))


@dataclass(frozen=True)
class RunOptions:
    """What :func:`resolve_run` does besides :class:`LibraryOptions`."""

    library: LibraryOptions = field(default_factory=LibraryOptions)
    replacements: Sequence[tuple[str, str]] = ()
    engines: Sequence[Engine] = ()
    translated: Sequence[str] = ("title", "outline")
    target_language: str = "zh"
    bare_people: bool = True
    single_types: Sequence[str] = ()
    file_tags: Sequence[str] = ()
    update_records: bool = False


PEOPLE_LISTS = ("people", "all_people", "directors")
NAME_COLUMNS = ("series", "maker", "label")


def _tidied(items: DataFrame, aliases: DataFrame | None, options: RunOptions) -> DataFrame:
    """Names without brackets, titles without names and codes, text without stray characters."""
    items = clean_items(items)
    if aliases is not None and {"title", "people"} <= set(items.columns):
        # Before the brackets go: what stands in them is a name too.
        items = A.strip_title_names(items, aliases, "item_code")
    if options.bare_people:
        lists = {c: F.filter(text.strip_brackets(F.coalesce(c, F.array().cast("array<string>"))), lambda n: n != "") for c in PEOPLE_LISTS if c in items.columns}
        items = items.withColumns(lists)
    return items


def finished_items(items: DataFrame, aliases: DataFrame | None, options: RunOptions) -> DataFrame:
    """Fused rows to what is written: tidied, translated, tidied again, names and tags canonical, words replaced.

    Translation runs between the two rounds, since a translated title may hold what has to go. ``items`` has one row per item_code.
    """
    items = _tidied(items, aliases, options)
    for column in options.translated if options.engines else ():
        if column in items.columns:
            foreign = text.needs_translation(column, options.target_language)
            items = translate(items, column, options.engines, where=foreign).drop(f"{column}_by")
    items = _tidied(items, aliases, options)
    language = options.library.language
    if aliases is not None and language:
        for column in (c for c in PEOPLE_LISTS if c in items.columns):
            items = A.canonicalize_list(items, column, aliases, language, ["item_code"], match_names=False)
        for column in (c for c in NAME_COLUMNS if c in items.columns):
            items = A.canonicalize(items, column, aliases, language)
        if "tags" in items.columns:
            items = A.canonicalize_list(items, "tags", aliases, language, ["item_code"])
    words = [c for c in ("title", "originaltitle", "outline", "originalplot", *NAME_COLUMNS) if c in items.columns]
    return items.withColumns({c: text.replace_words(c, options.replacements) for c in words}) if options.replacements else items


def resolve_run(
    inventory: DataFrame, observations: DataFrame, priority: DataFrame, options: RunOptions, ledger: DataFrame | None = None,
    aliases: DataFrame | None = None, records: DataFrame | None = None,
) -> DataFrame:
    """A whole run, one row per file that the ledger doesn't call done: facts, item fields, ``target``, ``status`` and ``reason``.

    1. A code with an existing record (``records(item_code, ...)``) keeps it as it is, or is finished anew with ``update_records``.
    2. Other codes are fused and finished once, and joined to their files.
    3. A file that shares its code's record gets its own tags in place of ``file_tags``; files of ``single_types`` and of codes with dots
       stand for themselves and keep the record's tags.
    4. Resolution tags follow the file's definition, then names and targets are made.
    5. Of the files that would land on one target the first keeps it, the others fail.
    """
    library = options.library
    todo = inventory if ledger is None else skip_processed(inventory, ledger)
    files = classify_items(inventory_facts(todo, library), library.class_rules, library.default_type)
    codes_ = files.where(F.col("item_code").isNotNull()).select("item_code", "item_type").distinct()
    fresh = codes_ if records is None else codes_.join(records.select("item_code"), "item_code", "left_anti")
    fused = fuse_fields(observations.join(fresh, "item_code"), priority, library.fields)
    # Finishing is per code; of a code of two types the first is taken there.
    done = finished_items(fused.dropDuplicates(["item_code"]) if "item_type" not in fused.columns else first_wins_dedupe(fused, ["item_code"], ["item_type"]), aliases, options)
    done = done.withColumn("from_record", F.lit(False)).drop("item_type")
    if records is not None:
        kept = records.join(codes_.select("item_code").distinct(), "item_code", "left_semi")
        kept = (finished_items(kept, aliases, options) if options.update_records else kept).withColumn("from_record", F.lit(True))
        done = done.unionByName(kept, allowMissingColumns=True)
    joined = files.join(done, "item_code", "left").withColumn("found", F.col("from_record").isNotNull())
    needed = {"tags": "array<string>", "people": "array<string>", "series": "string", "maker": "string", "label": "string"}
    joined = joined.withColumns({n: F.lit(None).cast(k) for n, k in needed.items() if n not in joined.columns})
    if "has_sub" not in joined.columns:
        joined = joined.withColumn("has_sub", F.lit(False))
    none = F.array().cast("array<string>")
    shared = ~F.col("item_code").contains(".") & ~F.col("item_type").isin(*options.single_types) if options.single_types else ~F.col("item_code").contains(".")
    general = F.filter(F.coalesce("tags", none), lambda t: ~t.isin(*options.file_tags)) if options.file_tags else F.coalesce("tags", none)
    joined = joined.withColumns({"shared": F.coalesce(shared, F.lit(False)), "tags": F.when(F.coalesce(shared, F.lit(False)), general).otherwise(F.coalesce("tags", none))})
    tagged = build_tags(joined, library.tags)
    tagged = tagged.withColumn("tags", resolution_tags("tags", F.coalesce("definition", F.lit(""))))
    tagged = tagged.withColumns(
        {
            "number": F.col("item_code"), "studio": F.col("maker"), "actor": F.array_join(F.coalesce("people", none), ","), "cnword": F.lit(""), "moword": F.lit(""),
        }
    )
    named = naming.render_names(naming.naming_context(tagged), library.file_template, out="_file", max_length=library.max_name)
    named = naming.render_names(named, library.folder_template, out="_folder", target="folder", max_length=library.max_name)
    target = paths.output_paths(F.lit(library.root), "_folder", F.concat("_file", paths.part_suffix("part")), "ext")
    keep = [c for c in tagged.columns if c not in ("number", "studio", "actor", "cnword", "moword", "found")]
    placed = named.select(*keep, "found", F.when(F.col("found"), target["file"]).alias("target"))
    first = placed.where("target is not null").groupBy("target").agg(F.min("path").alias("_first"))
    ended = placed.join(first, "target", "left")
    late = F.col("path") != F.col("_first")
    no_code = F.col("item_code").isNull() | (F.col("item_code") == "")
    reason = F.when(no_code, "no code in the path").when(~F.col("found"), "no source has the code").when(late, "another file has the target")
    return ended.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("failed")).drop("_first", "found").select(*keep, "target", "status", "reason")


def run_ledger(files: DataFrame, ts: Column) -> DataFrame:
    """The ledger rows of a run: append them with ``sources.ledger.ledger_append``."""
    return files.select("path", "item_code", "status", "reason", ts.alias("ts"))


def missing_report(
    catalog: DataFrame, inventory: DataFrame, noise: Sequence[str] = (), rules: Sequence[codes.CodeRule] = codes.SHAPE_RULES
) -> DataFrame:
    """Catalogue items the library lacks, newest first.

    ``inventory(path, has_subtitle)``; both a code and its short form count as held.
    """
    coded = codes.extract_item_code(inventory, tokens=noise, rules=rules)
    both = F.array_compact(F.array("item_code", codes.short_code("item_code")))
    local = coded.select(F.explode(both).alias("item_code"), "has_subtitle")
    return missing_items(catalog, local).orderBy(F.col("date").desc(), F.col("item_code").desc())
