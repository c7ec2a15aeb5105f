"""Ordered scans of few and large keys: range partitions in order, what crosses their borders carried over.

A window over a key puts all of its rows in one task. Here a table is cut by
ranges of (key, order), each range is scanned on its own, and one row a range and
key at its border tells the next ranges what came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captext.session import cut

#: Rows of a range at most, and rows for which a range is worth its task.
RANGE = 1 << 20
WORTH = 4096


def ranged(rows: DataFrame, key: str, order: list[str], most: int = RANGE) -> DataFrame:
    """rows with _part, the number of their range of (key, order): no row of a range comes before one of a range before it.

    Rows without a key are left out. The result is cut by a checkpoint, so that its
    ranges stay what they are.
    """
    held = rows.where(F.col(key).isNotNull())
    n, tasks = held.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-n // most), min(tasks, n // WORTH))
    return cut(held.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id()))


def _borders(parts: DataFrame, key: str, **values: Column) -> DataFrame:
    """One row a range and key with aggregates of its rows."""
    return parts.groupBy(key, "_part").agg(*(v.alias(name) for name, v in values.items()))


def with_before(parts: DataFrame, key: str, order: list[str], value: Column, out: str, first: str | None = None) -> DataFrame:
    """ranged() rows with `out`, the `value` of the row before in (key, order), NULL for a key's first row; `first` marks that one.

    Only a range's last value of a key travels: `lag` inside the range, the last
    value of the key's range before at its start.
    """
    inside = Window.partitionBy("_part", key).orderBy(*order)
    at = F.struct(*order)
    ends = _borders(parts, key, _end=F.max_by(F.struct(value.alias("v")), at))
    carried = ends.withColumn("_carried", F.lag("_end").over(Window.partitionBy(key).orderBy("_part"))).select(F.col(key).alias("_k"), F.col("_part").alias("_p"), "_carried")
    rows = parts.withColumn("_before", F.lag(F.struct(value.alias("v"))).over(inside))
    rows = rows.join(carried, (F.col(key) == F.col("_k")) & (F.col("_part") == F.col("_p")), "left")
    before = F.coalesce("_before", "_carried")
    rows = rows.withColumn(out, before["v"])
    if first:
        rows = rows.withColumn(first, before.isNull())
    return rows.drop("_before", "_carried", "_k", "_p")


def with_total(parts: DataFrame, key: str, order: list[str], value: Column, out: str) -> DataFrame:
    """ranged() rows with `out`, the running total of `value` in (key, order), the row's own included."""
    inside = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = _borders(parts, key, _sum=F.sum(value))
    carried = sums.withColumn("_carried", F.sum("_sum").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    carried = carried.select(F.col(key).alias("_k"), F.col("_part").alias("_p"), F.coalesce("_carried", F.lit(0)).alias("_carried"))
    rows = parts.withColumn("_own", F.sum(value).over(inside))
    rows = rows.join(carried, (F.col(key) == F.col("_k")) & (F.col("_part") == F.col("_p")), "left")
    return rows.withColumn(out, F.col("_own") + F.col("_carried")).drop("_own", "_carried", "_k", "_p")


def islands(rows: DataFrame, key: str, order: list[str], on: Column, most: int = RANGE) -> DataFrame:
    """Runs of consecutive rows of a key, in `order`, for which `on` holds: key, first and last (of order's first column), n."""
    parts = ranged(rows.withColumn("_on", F.coalesce(on, F.lit(False))), key, order, most)
    lit = F.col("_on")
    # A run is told from the others of its key by how many rows that are off came before it.
    numbered = with_total(parts, key, order, (~lit).cast("long"), "_run").where(lit)
    return numbered.groupBy(key, "_run").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n")).drop("_run")


def changes(rows: DataFrame, key: str, order: list[str], value: Column, out: str = "before", most: int = RANGE) -> DataFrame:
    """Rows whose `value` isn't that of the key's row before, with that one as `out`; a key's first row is one."""
    parts = with_before(ranged(rows, key, order, most), key, order, value, out, "_first")
    return parts.where(F.col("_first") | ~value.eqNullSafe(F.col(out))).drop("_first", "_part")
