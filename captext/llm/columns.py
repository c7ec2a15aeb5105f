"""Names of columns that operators add."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with plain numbered names for all columns but `used`, so that none clashes, and what gives the names back."""
    plain = docs.toDF(*(c if c in used else f"c{i}" for i, c in enumerate(docs.columns)))
    return plain, lambda out: out.select(*plain.columns).toDF(*docs.columns)
