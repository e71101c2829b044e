"""Observations from JSON records and from JSON islands in web pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogfuse.functions.basics import as_col, empty_to_null

# Entities unescaped inside a JSON island.
ISLAND_ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def read_json_observations(
    raw: DataFrame, source: str, schema: str, field_map: Mapping[str, str], json: str = "json", keep: Sequence[str] = ()
) -> DataFrame:
    """Source rows to observation columns, tolerant of missing paths.

    The document is parsed once with ``schema`` (DDL); ``field_map`` gives a SQL expression over the
    parsed struct ``d`` per output column. '' and [] become NULL here.
    """
    parsed = raw.withColumn("d", F.from_json(json, schema))
    out = parsed.select(*keep, F.lit(source).alias("source"), *[F.expr(e).alias(n) for n, e in field_map.items()])
    for f in out.schema.fields:
        if f.name in keep or f.name == "source":
            continue
        kind = f.dataType.typeName()
        if kind == "string":
            out = out.withColumn(f.name, F.nullif(f.name, F.lit("")))
        elif kind == "array":
            out = out.withColumn(f.name, empty_to_null(f.name))
    return out


def read_variant_observations(
    raw: DataFrame, source: str, fields: Mapping[str, tuple[str, str] | tuple[str, str, str]], json: str = "json", keep: Sequence[str] = ()
) -> DataFrame:
    """Source rows to observation columns without a schema of the documents.

    ``fields`` gives a JSON path and a type per output column, and where wanted a SQL expression over the value, written ``{v}``. A document
    is parsed once, as a variant, so a field that a source adds needs no change and one that it drops, or fills with another
    type, is NULL. Unreadable documents have NULL in all fields. '' and [] become NULL here.
    """
    parsed = raw.withColumn("_d", F.try_parse_json(json))
    got = {f"_v_{n}": F.try_variant_get("_d", spec[0], spec[1]) for n, spec in fields.items()}
    out = parsed.select(*keep, F.lit(source).alias("source"), *[c.alias(n) for n, c in got.items()])
    columns = []
    for n, spec in fields.items():
        value = F.expr(spec[2].format(v=f"`_v_{n}`")) if len(spec) > 2 else F.col(f"_v_{n}")
        columns.append(value.alias(n))
    out = out.select(*keep, "source", *columns)
    for f in out.schema.fields:
        if f.name not in (*keep, "source"):
            kind = f.dataType.typeName()
            if kind == "string":
                out = out.withColumn(f.name, F.nullif(f.name, F.lit("")))
            elif kind == "array":
                out = out.withColumn(f.name, empty_to_null(f.name))
    return out


def json_shape(raw: DataFrame, json: str = "json", by: Sequence[str] = ()) -> DataFrame:
    """The merged shape of all documents, per group of ``by``, as a type string: what a source sends now. One aggregate."""
    return raw.groupBy(*by).agg(F.schema_of_variant_agg(F.try_parse_json(json)).alias("shape"), F.count(F.lit(1)).alias("documents"))


def json_island(html: Column | str, selector: str = "application/ld+json", by: str = "type") -> Column:
    """Text of the first ``<script by="selector">`` of a page, entities unescaped; NULL if none."""
    pattern = f"(?is)<script[^>]*\\b{by}=[\"']\\Q{selector}\\E[\"'][^>]*>(.*?)</script>"
    text = F.trim(F.regexp_extract(as_col(html), pattern, 1))
    plain = text
    for entity, ch in ISLAND_ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(ch))
    # Entities are escapes only when the island itself is escaped; inside plain JSON they are text.
    return F.nullif(F.when(text.rlike("^[\\[{]\\s*&quot;"), plain).otherwise(text), F.lit(""))


def read_embedded_json(
    pages: DataFrame, schema: str, selector: str = "application/ld+json", by: str = "type", html: str = "html",
    out: str = "data",
) -> DataFrame:
    """Pages with their JSON island parsed to a struct; unreadable islands are NULL."""
    return pages.withColumn(out, F.from_json(json_island(html, selector, by), schema))
