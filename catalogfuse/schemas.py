"""Column layouts of the tables that operators exchange."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

INVENTORY = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("dir", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("ext", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.TimestampType()),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("item_code", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("secs", T.DoubleType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

PRIORITY = "item_type string, field string, source string, rank int"


@dataclass(frozen=True)
class Field:
    """A field to fuse. ``kind``: text, list, release, runtime, year or score; decides what is valid.

    ``language`` restricts multi-language sources to rows of that language.
    """

    name: str
    kind: str = "text"
    language: str | None = None


# The fused fields, in the order that decides which source is consulted first.
FUSED_FIELDS = (
    Field("title"),
    Field("originaltitle"),
    Field("outline"),
    Field("originalplot"),
    Field("people", "list"),
    Field("all_people", "list"),
    Field("thumb"),
    Field("poster"),
    Field("gallery", "list"),
    Field("tags", "list"),
    Field("release", "release"),
    Field("runtime", "runtime"),
    Field("score", "score"),
    Field("directors", "list"),
    Field("series"),
    Field("maker"),
    Field("label"),
    Field("trailer"),
    Field("wanted"),
)
