"""Structured Streaming: watched folders, running counts, rows taken once and event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DETECTIONS = "match_id long, frame_id long, det_id long, class_id int, confidence double, x double, y double, w double, h double, ts double"


def watch(spark: SparkSession, folder: str, schema: str = DETECTIONS, fmt: str = "json", files_each: int = 100) -> DataFrame:
    """New files of a folder, each once; writers move finished files in."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_each).load(folder)


def event_time(detections: DataFrame, late_seconds: int = 0) -> DataFrame:
    """detections with ``time`` from the seconds in ts, counted from the year 2000, and a watermark on it.

    A stream's watermark begins at the epoch, and a row at the watermark is late: seconds counted from there would lose
    a match's first frame.
    """
    return detections.withColumn("time", F.timestamp_seconds(F.col("ts") + 946_684_800)).withWatermark("time", f"{late_seconds} seconds")


def frame_counts(detections: DataFrame, seconds: int = 10) -> DataFrame:
    """Players and balls in each window of event time."""
    return detections.groupBy("match_id", F.window("time", f"{seconds} seconds").alias("w")).agg(
        F.count_if(F.col("class_id") == 0).alias("players"), F.count_if(F.col("class_id") == 1).alias("balls")
    ).select("match_id", F.col("w.start").alias("start"), "players", "balls")


def once_each(metrics: DataFrame, keys: list[str], time: str = "time", late: str = "1 hour") -> DataFrame:
    """Rows whose keys haven't come before within ``late`` of event time (an epoch poller's processed set)."""
    return metrics.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def write_event_files(events: DataFrame, folder: str, checkpoint: str):
    """Each batch with events becomes files under its own number; a batch that is repeated writes the same folder."""
    def save(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            batch.write.mode("overwrite").json(f"{folder}/batch={number}")

    return events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
