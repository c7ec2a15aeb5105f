"""Answers that outlive a run: a table of what a provider said, appended to by numbered batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from captext.session import scratch

Provider = Callable[[DataFrame], DataFrame]


class Memory:
    """Rows (keys and `answer`, not null) in a folder, a part for each batch that added some.

    A batch replaces its own part, and looks up only what batches of smaller numbers
    know, so running it again changes nothing. Keys are looked up by a join; only distinct
    keys that nobody knows reach the provider.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str):
        self.spark, self.path, self.keys = spark, path, keys
        kinds = spark.createDataFrame([], schema).schema
        self.kinds = StructType([*(f for f in kinds.fields if f.name in (*keys, "answer")), StructField("batch", LongType())])
        # An empty part, so that the folder can be read from the first day.
        spark.createDataFrame([], StructType(self.kinds.fields[:-1])).write.mode("overwrite").parquet(f"{path}/batch=-9999")

    def table(self, before: int | None = None) -> DataFrame:
        """What is known, or was before batch `before`; of two answers to a key the earlier batch's."""
        rows = self.spark.read.schema(self.kinds).parquet(self.path)
        rows = rows if before is None else rows.where(F.col("batch") < before)
        return rows.groupBy(*self.keys).agg(F.min_by("answer", "batch").alias("answer"))

    def answer(self, requests: DataFrame, provider: Provider, batch: int) -> DataFrame:
        """requests with answer ('' where there is none) and hit (known before this batch); what is new is added as `batch`.

        provider(missing keys) gives the keys and answer, NULL for a failure, which is
        not remembered. Keys are not null.
        """
        known = self.table(batch)
        missing = requests.select(*self.keys).distinct().join(known, self.keys, "left_anti")
        new = provider(missing).where(F.col("answer").isNotNull()).select(*self.keys, "answer")
        part = f"{self.path}/batch={batch}"
        new.write.mode("overwrite").parquet(part)
        new = self.spark.read.schema(StructType(self.kinds.fields[:-1])).parquet(part).withColumn("hit", F.lit(False))
        both = known.withColumn("hit", F.lit(True)).unionByName(new)
        out = requests.join(both, self.keys, "left")
        return out.withColumn("answer", F.coalesce("answer", F.lit(""))).withColumn("hit", F.coalesce("hit", F.lit(False)))

    def enrich(self, stream: DataFrame, provider: Provider, path: str | None = None, state: str | None = None) -> DataFrame:
        """answer() of each micro-batch of a stream, to the end of what is there; a batch that runs again replaces its rows and its part of the memory."""
        path, state = path or scratch(self.spark, "enriched"), state or scratch(self.spark, "state")

        def write(rows: DataFrame, number: int) -> None:
            self.answer(rows, provider, number).write.mode("overwrite").parquet(f"{path}/batch={number}")

        stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.parquet(path).drop("batch")
