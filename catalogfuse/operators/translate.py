"""Pluggable translation of text columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Engine = tuple[str, Callable[[list[str]], list[str | None]]]


def translate(df: DataFrame, col: str, engines: Sequence[Engine], where=None, out: str | None = None) -> DataFrame:
    """Translate the texts of ``col``: adds ``<out>`` and ``<out>_by``.

    Each engine gets a batch of distinct texts and returns as many results; a missing result or one
    equal to its input is a failure and goes to the next engine, in the given order. A text no
    engine translates is kept. Every distinct text is sent once, whatever its number of rows.
    """
    out = out or col
    chosen = df if where is None else df.where(where)
    texts = chosen.where(F.coalesce(F.col(col), F.lit("")) != "").select(F.col(col).alias("_src")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            source = batch["_src"].tolist()
            done: dict[int, tuple[str, str]] = {}
            for name, engine in engines:
                todo = [i for i in range(len(source)) if i not in done]
                if not todo:
                    break
                try:
                    results = engine([source[i] for i in todo])
                except Exception:
                    continue
                for i, text in zip(todo, results, strict=True):
                    if text and text.strip() != source[i].strip():
                        done[i] = (text, name)
            yield pd.DataFrame(
                {
                    "_src": source,
                    "_dst": [done.get(i, (None, None))[0] for i in range(len(source))],
                    "_by": [done.get(i, (None, None))[1] for i in range(len(source))],
                }
            )

    translated = texts.mapInPandas(run, "_src string, _dst string, _by string")
    take = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    keep = [F.col(c) for c in df.columns if c != out]
    # Rows that are not to be translated have no key: they stay where they are.
    return df.join(translated, F.when(take, F.col(col)) == F.col("_src"), "left").select(
        *keep,
        F.when(take, F.coalesce("_dst", F.col(col))).otherwise(F.col(col)).alias(out),
        F.when(take, F.col("_by")).alias(f"{out}_by"),
    )
