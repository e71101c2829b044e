"""Registered queries: one per operator, each over whole tables, with the same result in SQL."""

from catalogfuse.workload import (  # noqa: F401
    aliases,
    assets,
    fusion,
    identifiers,
    incremental,
    joins,
    linkage,
    naming,
    people,
    reports,
    rows,
    sources,
    texts,
    urls,
)
from catalogfuse.workload.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
