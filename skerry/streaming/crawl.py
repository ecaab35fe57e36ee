"""The crawl as a stream (an extension): first-seen URLs and status counts.

State is bounded by the watermark: a URL is remembered for that long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls


def queue_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """The files of a folder, or of what a pattern of paths finds, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def drained(stream: DataFrame, path: str) -> DataFrame:
    """What a stream gives for all that is there now, written under path with its checkpoints, so that a later call goes on from there."""
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoints").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def first_seen(queue: DataFrame, late: str = "1 day") -> DataFrame:
    """The first row of each normal URL within the watermark."""
    rows = queue.withColumns({"at": F.col("added_at").cast("timestamp"), "target": urls.normalised(F.col("url"))})
    return rows.filter("target is not null").withWatermark("at", late).dropDuplicatesWithinWatermark(["target"])


def status_counts(queue: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows by status in windows of time."""
    rows = queue.withColumn("at", F.col("added_at").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", window), F.lower("status").alias("status")).agg(F.count("*").alias("n"))
