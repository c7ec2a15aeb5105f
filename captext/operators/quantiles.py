"""Quantiles by key where keys may be few and large: exact ones by ranks over ranges, or from summaries of a bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captext.operators import scan


def quantiles(rows: DataFrame, key: str, value: str, shares: dict[str, float], error: float | None = None, most: int = scan.RANGE) -> DataFrame:
    """key, and for each name in shares the value at that share of the key's rows, between two rows by their distance.

    Exact (error is None): rows are cut by ranges of (key, value) and ranked range by
    range, so that no task holds a key; only the two rows next to each share are
    kept. With an `error`, from summaries of about 1 / error entries that are merged
    before the shuffle, and off by at most `error` of the ranks; these give a value
    of some row. Nulls don't count; a key without values is left out.
    """
    held = rows.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias(value))
    if error is not None:
        return held.groupBy(key).agg(*(F.percentile_approx(value, p, int(1 / error)).alias(name) for name, p in shares.items()))
    parts = scan.ranged(held, key, [value], most)
    ranked = scan.with_total(parts, key, [value], F.lit(1), "_rank")
    sizes = parts.groupBy(key).agg(F.count("*").alias("_n")).select(F.col(key).alias("_k"), "_n")
    ranked = ranked.join(sizes, F.col(key) == F.col("_k"))
    place = {name: (F.col("_n") - 1) * F.lit(p) for name, p in shares.items()}
    wanted = F.array(*(c for at in place.values() for c in ((F.floor(at) + 1), (F.ceil(at) + 1))))
    near = ranked.where(F.array_contains(wanted, F.col("_rank").cast("long")))

    def found(name: str):
        at = place[name]
        low, high = (F.max(F.when(F.col("_rank") == f(at) + 1, F.col(value))) for f in (F.floor, F.ceil))
        part = F.max(at - F.floor(at))
        return (low * (1 - part) + high * part).alias(name)

    return near.groupBy(key).agg(*(found(name) for name in shares))
