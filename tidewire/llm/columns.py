"""Columns of the input that bear names which an operator adds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

ASIDE = "tw_aside_"


def aside(docs: DataFrame, taken: list[str], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """keep(docs) with the columns of docs, while its columns named in taken are renamed out of the way."""
    moved = {c: f"{ASIDE}{c}" for c in docs.columns if c in taken}
    kept = keep(docs.withColumnsRenamed(moved))
    return kept.select(*[kept[moved.get(c, c)].alias(c) for c in docs.columns])
