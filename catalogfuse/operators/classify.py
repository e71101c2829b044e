"""Item types by ordered rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogfuse.functions.basics import contains_any, first_hit


@dataclass(frozen=True)
class ClassRule:
    """Items for which any of the given tests holds get ``item_type`` (and one specific ``source``).

    ``unless_path`` words and ``unless_code`` texts veto the rule.
    """

    item_type: str
    source: str | None = None
    editions: Sequence[str] = ()
    code_patterns: Sequence[str] = ()
    path_words: Sequence[str] = ()
    short_code: bool = False
    unless_path: Sequence[str] = ()
    unless_code: Sequence[str] = ()

    def condition(self, code: Column, path: Column, edition: Column, short: Column) -> Column:
        test = F.lit(False)
        if self.editions:
            test = test | F.coalesce(edition.isin(*self.editions), F.lit(False))
        for pattern in self.code_patterns:
            test = test | F.coalesce(code.rlike(pattern), F.lit(False))
        if self.path_words:
            test = test | contains_any(F.lower(path), self.path_words)
        if self.short_code:
            test = test | short.isNotNull()
        for words, c in ((self.unless_path, F.lower(path)), (self.unless_code, code)):
            if words:
                test = test & ~contains_any(c, words)
        return test


def classify_items(
    df: DataFrame,
    rules: Sequence[ClassRule],
    default: str,
    fixed: str | None = None,
    type_sources: DataFrame | None = None,
) -> DataFrame:
    """Add ``item_type``, ``type_source`` ('fixed' or 'auto') and ``only_source``.

    Reads ``item_code, path, edition, short_code``; ``record_code`` and ``record_edition`` of an
    existing record, when present, override the file's. ``type_sources(item_type, source, rank)``
    adds the ordered ``sources`` of the type.
    """
    def over(record: str, own: str) -> Column:
        return F.coalesce(F.nullif(record, F.lit("")), F.col(own)) if record in df.columns else F.col(own)

    code, edition = over("record_code", "item_code"), over("record_edition", "edition")
    if fixed is not None:
        out = df.withColumns(
            {"item_type": F.lit(fixed), "type_source": F.lit("fixed"), "only_source": F.lit(None).cast("string")}
        )
    else:
        hits = [
            (
                r.condition(code, F.col("path"), edition, F.col("short_code")),
                F.struct(F.lit(r.item_type).alias("t"), F.lit(r.source).cast("string").alias("s")),
            )
            for r in rules
        ]
        spare = F.struct(F.lit(default).alias("t"), F.lit(None).cast("string").alias("s"))
        staged = df.withColumn("_c", first_hit(hits, spare))
        out = staged.withColumns(
            {"item_type": F.col("_c.t"), "type_source": F.lit("auto"), "only_source": F.col("_c.s")}
        ).drop("_c")
    if type_sources is None:
        return out
    listed = type_sources.groupBy("item_type").agg(
        F.transform(F.array_sort(F.collect_set(F.struct("rank", "source"))), lambda s: s["source"]).alias("_all")
    )
    sources = F.when(F.col("only_source").isNotNull(), F.array("only_source")).otherwise(F.col("_all"))
    return out.join(listed, "item_type", "left").withColumn("sources", sources).drop("_all")
