"""Joins of two streams over time: what operators/fusion.py does on tables, with watermarks.

Each gives every row of its first stream that its table form gives, also those
whose partners may still have come when the input ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captext.operators.fusion import fused_texts
from captext.streaming.live import ANY_ORDER, at, finished


def _ms(n: int) -> str:
    return f"INTERVAL {n} MILLISECONDS"


def fused(spark: SparkSession, speech: DataFrame, subtitles: DataFrame, within: int = 8000, least: float = 0.34, delay: str = ANY_ORDER) -> DataFrame:
    """fusion.fuse_subtitles() of streams: speech (stream_id, seq, t1, text) with the latest subtitle (stream_id, seq, t, text) of its last `within` ms.

    An outer interval join keeps speech without a subtitle; a segment's subtitles
    are then aggregated to the latest one, which the watermark on its end closes.
    """

    def build(ends):
        a = ends.until(speech.select("stream_id", "seq", "t1", "text", at("t1").alias("ta")), "ta", delay)
        b = ends.until(subtitles.select(F.col("stream_id").alias("_sid"), F.col("seq").alias("_n"), F.col("t").alias("_t"), F.col("text").alias("_shown"), at("t").alias("tb")), "tb", delay)
        both = a.join(b, F.expr(f"stream_id = _sid AND tb <= ta AND tb >= ta - {_ms(within)}"), "leftOuter")
        return both.groupBy("ta", "stream_id", "seq").agg(F.first("text").alias("text"), F.max_by("_shown", F.struct("_t", "_n")).alias("_shown")).drop("ta")

    return fused_texts(finished(spark, build, "fused"), least)


def silent(spark: SparkSession, subtitles: DataFrame, speech: DataFrame, within: int = 2500, longest: int = 8000, delay: str = ANY_ORDER) -> DataFrame:
    """fusion.silent_subtitles() of streams, for speech of at most `longest` ms (to which streams are cut): subtitles during whose last `within` ms nobody spoke."""

    def build(ends):
        a = ends.until(subtitles.select("stream_id", "seq", "t", "text", at("t").alias("ta")), "ta", delay)
        b = ends.until(speech.select(F.col("stream_id").alias("_sid"), F.col("t0").alias("_t0"), F.lit(1).alias("_heard"), at("t1").alias("tb")), "tb", delay)
        both = a.join(b, F.expr(f"stream_id = _sid AND tb >= ta - {_ms(within)} AND tb <= ta + {_ms(longest)} AND _t0 <= t"), "leftOuter")
        return both.where("_heard IS NULL").select("stream_id", "seq", "t", "text")

    return finished(spark, build, "silent")


def unechoed(spark: SparkSession, speech: DataFrame, playback: DataFrame, grace: int = 2500, longest: int = 8000, delay: str = ANY_ORDER) -> DataFrame:
    """fusion.without_echo() of streams, for segments and playbacks of at most `longest` ms: segments that touch no playback nor the `grace` ms after one."""

    def build(ends):
        a = ends.until(speech.select("stream_id", "seq", "t0", "t1", "text", at("t0").alias("ta")), "ta", delay)
        b = ends.until(playback.select(F.col("stream_id").alias("_sid"), F.col("t0").alias("_p0"), F.col("t1").alias("_p1"), F.lit(1).alias("_echo"), at("t0").alias("tb")), "tb", delay)
        both = a.join(b, F.expr(f"stream_id = _sid AND tb <= ta + {_ms(longest)} AND tb >= ta - {_ms(longest + grace)} AND t0 < _p1 + {grace} AND t1 > _p0"), "leftOuter")
        return both.where("_echo IS NULL").select("stream_id", "seq", "t0", "t1", "text")

    return finished(spark, build, "unechoed")
