"""Pictures as arrays of luma, row by row: smaller copies, signatures, frames that did not change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def every_nth(luma: Column, width: int, step: int) -> Column:
    """Every `step`-th pixel of every `step`-th row, from the first."""
    at = F.transform(F.sequence(F.lit(0), F.floor((F.size(luma) / width - 1) / step).cast("int")), lambda y: F.transform(F.sequence(F.lit(0), F.lit((width - 1) // step)), lambda x: luma[y * step * width + x * step]))
    return F.flatten(at)


def block_means(luma: Column, width: int, height: int, columns: int, rows: int) -> Column:
    """A copy of `columns` times `rows` pixels, each the mean of its block; blocks differ by a pixel where the sizes don't divide."""
    xs, ys = ([(i * n // parts, max((i + 1) * n // parts, i * n // parts + 1)) for i in range(parts)] for n, parts in ((width, columns), (height, rows)))
    means = []
    for top, bottom in ys:
        for left, right in xs:
            held = [y * width + x for y in range(top, bottom) for x in range(left, right)]
            means.append(F.array(*(F.lit(i) for i in held)))
    mean = lambda held: F.aggregate(held, F.lit(0.0), lambda s, i: s + luma[i]) / F.size(held)
    return F.transform(F.array(*means), mean)


def signature(luma: Column, width: int, height: int, columns: int = 4, rows: int = 4) -> Column:
    """Whole parts of block_means(): equal for pictures that look alike at that size."""
    return F.transform(block_means(luma, width, height, columns, rows), lambda x: F.floor(x).cast("int"))


def reused_results(frames: DataFrame, width: int, height: int, columns: int = 4, rows: int = 4) -> DataFrame:
    """frames (stream_id, seq, luma, text) with changed, and the text of the last frame whose signature changed.

    A recogniser has to read changed frames only; the others reuse what it said.
    """
    w = Window.partitionBy("stream_id").orderBy("seq")
    held = frames.withColumn("_sig", signature(F.col("luma"), width, height, columns, rows))
    held = held.withColumn("changed", F.coalesce(F.lag("_sig").over(w) != F.col("_sig"), F.lit(True)))
    return held.withColumn("text", F.last(F.when(F.col("changed"), F.struct("text")), ignorenulls=True).over(w)["text"]).drop("_sig")
