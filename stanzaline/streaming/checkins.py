"""Streams over events: a progress log kept up to date, and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lifecycle import last_wins


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def upsert_log(checkins: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Appends each batch's last row of a key; a batch that is replayed replaces itself, since its number is its partition."""

    def write(batch: DataFrame, number: int) -> None:
        last_wins(batch, keys, order).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return checkins.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    return last_wins(spark.read.parquet(path), keys, order).drop("batch")


def window_counts(events: DataFrame, time: str, by: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by tumbling window; rows later than the watermark are dropped, memory is bounded by it."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), by, "n")
