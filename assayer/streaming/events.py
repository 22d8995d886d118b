"""Incremental forms of batch operators; extensions beyond what the reference has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events per calendar day and type; a day closes once ``late`` has passed after it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    days = timed.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("count"))
    return days.select(F.date_format(F.col("window.start"), "yyyy-MM-dd").alias("day"), "event_type", "count")


def read_drop(spark: SparkSession, folder: str, schema, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(folder)


def apply_each(stream: DataFrame, change: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Apply a batch function to each arrival of files, then stop; a restart goes on where it was."""
    return stream.writeStream.foreachBatch(change).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts_of_folder(spark: SparkSession, folder: str, schema, checkpoint: str, target: str) -> StreamingQuery:
    """Append closed days of a folder of event files to ``target``."""
    return daily_counts(read_drop(spark, folder, schema)).writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
