"""Streams of training events: windowed means with a watermark, written as tables. An extension; batch and stream agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def epoch_means(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """(name, start, value, n): the mean of the finite values of each name and window; later rows than ``late`` are dropped."""
    ok = events.where(~F.isnan("value") & (F.abs("value") < float("inf"))).withWatermark("ts", late)
    return ok.groupBy("name", F.window("ts", length)).agg(F.avg("value").alias("value"), F.count("*").alias("n")).select("name", F.col("window.start").alias("start"), "value", "n")


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream of files, in the shape of :func:`epoch_means`."""
    schema = spark.read.parquet(folder).schema
    raw = spark.readStream.schema(schema).parquet(folder)
    return raw.select(F.col("event_type").alias("name"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))


def write_means(means: DataFrame, path: str, checkpoint: str) -> None:
    """Runs the stream over what is there and writes closed windows to a table; a second run goes on from the first."""
    means.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
