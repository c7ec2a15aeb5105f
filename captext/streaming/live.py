"""Streams over the tables, and runs of them to the end of what is there."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from captext.session import scratch
from captext.streaming.fold import EPOCH, stream_fold
from captext.streaming.steps import Step

#: The event time of rows that end a stream, and the delay for tables whose rows come in any order.
LAST = "9999-01-01 00:00:00"
ANY_ORDER = "36500 days"

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def at(ms: str | Column) -> Column:
    """The timestamp of a time in ms since EPOCH."""
    return F.timestamp_millis(F.lit(EPOCH) + (F.expr(ms) if isinstance(ms, str) else ms))


def stream_table(spark: SparkSession, d: str, name: str, most_files: int = 1000) -> DataFrame:
    """A file stream of a Parquet table that is a file or a folder, `most_files` to a micro-batch at most."""
    held = spark.read.parquet(f"{d}/{name}.parquet")
    folder = held.inputFiles()[0].rsplit("/", 1)[0].endswith(f"/{name}.parquet")
    reader = spark.readStream.schema(held.schema).option("maxFilesPerTrigger", most_files)
    return reader.parquet(f"{d}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


class Ends:
    """Where streams get an end: `until` gives each a watermark and a folder beside its source, `write` puts a last row in each folder.

    The last rows carry the watermarks past everything, so that windows, joins and
    timers hand out what is open. They don't reach the query themselves. Spark moves
    filters on other columns than the time below the watermark, so filters belong
    before until(), but for those on nulls: a last row has none.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.opened = spark, scratch(spark, "ends"), []

    def until(self, stream: DataFrame, time: str, delay: str = ANY_ORDER) -> DataFrame:
        """stream, with a watermark `delay` behind its timestamp column `time`; rows without a time are left out."""
        path = f"{self.root}/{len(self.opened)}"
        self.opened.append((path, stream.schema, time))
        self.spark.createDataFrame([], stream.schema).write.parquet(path)
        both = stream.unionByName(self.spark.readStream.schema(stream.schema).parquet(path))
        # The filter names the time, so it isn't moved below the watermark.
        return both.withWatermark(time, delay).where(F.col(time) < F.lit(LAST).cast("timestamp"))

    def write(self) -> None:
        for path, schema, time in self.opened:
            row = self.spark.range(1).select(*((F.lit(LAST).cast("timestamp") if f.name == time else _some(f.dataType)).alias(f.name) for f in schema.fields))
            row.write.mode("append").parquet(path)


def _some(kind: DataType) -> Column:
    """A value of a type that isn't null."""
    simple = {"string": "''", "array": "array()", "map": "map()", "date": "date'1970-01-01'", "binary": "x''", "timestamp": "timestamp_seconds(0)", "timestamp_ntz": "timestamp_ntz'1970-01-01'", "boolean": "false"}
    if isinstance(kind, StructType):
        return F.struct(*(_some(f.dataType).alias(f.name) for f in kind.fields))
    return F.expr(simple.get(kind.typeName(), "0")).cast(kind)


@contextmanager
def rocks(spark: SparkSession):
    """The RocksDB state store for queries that start here."""
    name = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, held) if held else spark.conf.unset(name)


def finished(spark: SparkSession, build: Callable[[Ends], DataFrame], name: str, mode: str = "append", state: str | None = None, end: bool = True) -> DataFrame:
    """The rows that the stream build(ends) writes by the end of its input. They stand in the shared folder.

    The query runs over what is there; where streams were opened by ends.until() it
    then goes on from its checkpoint (`state`) over their last rows, unless `end` is False.
    """
    ends = Ends(spark)
    stream = build(ends)
    path, state = scratch(spark, name), state or scratch(spark, "state")
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", state).trigger(availableNow=True)
    with rocks(spark):
        writer.start().awaitTermination()
        if ends.opened and end:
            ends.write()
            writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def folded(stream: DataFrame, key: str, order: list[str], step: Step, delay: str = ANY_ORDER, state: str | None = None, end: bool = True) -> DataFrame:
    """The rows of a stream_fold() by the end of its input; order[0] is the event time in ms since EPOCH."""
    timed = stream.withColumn("_at", at(F.col(order[0])))
    return finished(stream.sparkSession, lambda ends: stream_fold(ends.until(timed, "_at", delay), key, order, step), "fold", state=state, end=end)


def sessions(events: DataFrame, key: str, gap: str, least: float = 0.0) -> DataFrame:
    """A stream's sessions by key, closed by `gap` of silence, that last `least` seconds or more: key, first, last, n. events has a watermark on ts."""
    out = events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    long = F.col("last").cast("double") - F.col("first").cast("double") >= least
    return out.select(key, "first", "last", "n").where(long if least else F.lit(True))


def fresh(rows: DataFrame, at: str, arrived: str, most: int) -> DataFrame:
    """Rows that came at most `most` ms after their own time; late ones are ignored, nothing is held."""
    return rows.where(F.col(arrived) - F.col(at) <= most)


def fan_out(stream: DataFrame, sinks: dict[str, object]) -> dict[str, DataFrame]:
    """Each sink gets its own transformation of every micro-batch, cached once; a batch that runs again replaces itself."""
    spark = stream.sparkSession
    paths = {name: scratch(spark, name) for name in sinks}

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, change in sinks.items():
            change(batch).write.mode("overwrite").parquet(f"{paths[name]}/batch={number}")
        batch.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return {name: spark.read.parquet(path).drop("batch") for name, path in paths.items()}


def alerts(stream: DataFrame, key: str, order: list[str], value: str, path: str | None = None, state: str | None = None) -> DataFrame:
    """Rows of a stream whose `value` isn't that of the key's row before, with that one as `before`; a key's first row is one.

    Keys may be few and large: each micro-batch is scanned by ranges
    (scan.changes()), together with the last row of every key so far, which is all
    that is carried on. A batch that runs again reads what the batch before it left,
    and replaces its own rows. A row that is older than a batch before is placed at
    the start of its key.
    """
    from captext.operators.scan import changes

    spark = stream.sparkSession
    path, state = path or scratch(spark, "alerts"), state or scratch(spark, "state")
    columns = [key, *order, value]

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(*columns, F.lit(False).alias("_old"))
        if number:
            rows = rows.unionByName(spark.read.parquet(f"{path}/last/{number - 1}").withColumn("_old", F.lit(True)))
        changes(rows, key, order, F.col(value)).where("NOT _old").select(*columns, "before").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order, value)).alias("_x")).select(key, "_x.*")
        last.write.mode("overwrite").parquet(f"{path}/last/{number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows").drop("batch")
