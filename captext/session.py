"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def builder(app: str = "captext") -> SparkSession.Builder:
    """A session builder with the settings that the operators expect."""
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """Arrow batches of at most `most` for this session's Python tasks, in place of 64 MB: a batch of texts stands several times in the JVM and in its worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor reaches.

    Where the setting is absent in a local session a temporary folder is made once
    and becomes the session's checkpoint folder; on a cluster that raises
    RuntimeError, as executors don't see each other's local folders.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="captext-"))
        held = spark.sparkContext.getCheckpointDir()
    return held


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/captext-{uuid.uuid4().hex}/{name}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a path that scratch() gave, and its folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df):
    """The same rows from a reliable checkpoint, with the lineage cut."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)
