"""Structured Streaming forms: windows, sessions, resuming by id, and growth of graph tables."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..shared import scratch_path


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Event files of a folder as a stream; the watermark bounds what a late event may still change."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")


def rms_windows(events: DataFrame, width: str = "1 second") -> DataFrame:
    """Root mean square of each tumbling window."""
    return events.groupBy(F.window("ts", width).alias("w")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "rms", "n")


def sessions(events: DataFrame, gap: str = "120 seconds") -> DataFrame:
    """Sessions of each user by start-to-start gaps."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def unseen(rows: DataFrame, key: str = "uid") -> DataFrame:
    """Each id once, as long as the watermark remembers it."""
    return rows.dropDuplicatesWithinWatermark([key])


def grow_graph(stream: DataFrame, path: str, checkpoint: str):
    """Append each micro-batch to a table, with the batch it came in; a batch run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("build_hop", F.lit(number)).write.mode("overwrite").parquet(posixpath.join(path, f"build_hop={number}"))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows_to_table(windows: DataFrame, path: str, checkpoint: str, key: str = "start") -> DataFrame:
    """Write each micro-batch's windows as files, in update mode; the table holds the last state of each.

    A batch run again replaces its own files, so the driver holds nothing and a restart changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(posixpath.join(path, f"batch={number}"))

    done = windows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    done.awaitTermination()
    written = windows.sparkSession.read.schema(StructType([*windows.schema.fields, StructField("batch", LongType())])).option("basePath", path).parquet(path)
    return written.groupBy(key).agg(*[F.max_by(c, "batch").alias(c) for c in windows.columns if c != key])


def run_once(spark: SparkSession, sf_dir: str, width: str = "1 hour") -> DataFrame:
    """Hourly windows of the event table, read as a stream until it is used up."""
    base = scratch_path(spark, "stream")
    # a single file stands for the folder that a stream would watch
    windows = rms_windows(read_events(spark, f"{sf_dir}/events*.parquet"), width)
    return windows_to_table(windows, posixpath.join(base, "table"), posixpath.join(base, "checkpoint"))
