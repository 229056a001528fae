"""Exact duplicates over a stream of arriving files, and control of running jobs."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def content_stream(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """``(path, size, full_hash)`` of files as they arrive below ``folder``."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(folder).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("full_hash"))


def running_groups(stream: DataFrame) -> DataFrame:
    """Groups so far: state is one row for each distinct content, not for each file."""
    sums = stream.groupBy("full_hash").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("file_count"))
    return sums.where("file_count > 1").withColumn("reclaimable_bytes", (F.col("file_count") - 1) * F.col("size"))


def start_groups(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Run over what is there now and stop; the next start goes on from the checkpoint."""
    return running_groups(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class JobControl:
    """Cancel at once, pause between stages: a pipeline calls :meth:`checkpoint` before each of its stages."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.group = spark, f"dupscape-{uuid.uuid4().hex}"
        self._open, self.cancelled = threading.Event(), False
        self._open.set()

    def begin(self, label: str) -> None:
        self.spark.sparkContext.setJobGroup(self.group, label, interruptOnCancel=True)

    def pause(self) -> None:
        self._open.clear()

    def resume(self) -> None:
        self._open.set()

    def cancel(self) -> None:
        self.cancelled = True
        self._open.set()
        self.spark.sparkContext.cancelJobGroup(self.group)

    def checkpoint(self, label: str = "") -> None:
        """Waits while paused; raises once cancelled."""
        self._open.wait()
        if self.cancelled:
            raise InterruptedError(label or "cancelled")
