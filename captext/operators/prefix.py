"""Running totals over a whole table without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from captext.session import cut

#: Rows whose running total one task computes.
CHUNK = 4096


def with_starts(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Add `out`, the total of `value` over rows with a smaller `key` (long, not null, unique).

    Rows are ranked by ranges of the key: range partitions give the order, their
    totals (one row each) a second running total.
    """
    parts = max(1, -(-df.count() // CHUNK))
    ranged = cut(df.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.join(totals, "_part").withColumn(out, F.col("_before") + F.coalesce(inside, F.lit(0))).drop("_part", "_before")
