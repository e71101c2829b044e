"""All queries of this subpackage."""

from __future__ import annotations

from catalogfuse.llm import (  # noqa: F401
    collocations,
    decontaminate,
    exact_dedup,
    hard_negatives,
    hyperminhash,
    jaccard_join,
    line_dedup,
    mixing,
    packing,
    pii,
    sharding,
    suffix_dedup,
    toxicity,
)
from catalogfuse.llm.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
