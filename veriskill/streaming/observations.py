"""Observations that arrive over time (an extension): a file stream, averaged by hour and cell behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "obs_time timestamp, latitude double, longitude double, value double"


def observation_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def hourly_means(stream: DataFrame, late: str = "6 hours") -> DataFrame:
    """Mean of each cell's hour; hours close `late` after the newest observation, later rows are dropped."""
    hour = F.window("obs_time", "1 hour")
    return stream.withWatermark("obs_time", late).groupBy(hour, "latitude", "longitude").agg(F.avg("value").alias("value"), F.count("*").alias("n")).select(F.col("window.start").alias("obs_time"), "latitude", "longitude", "value", "n")


def keep_hourly(spark: SparkSession, folder: str, table: str, checkpoint: str, late: str = "6 hours") -> StreamingQuery:
    """Closed hours appended to a Parquet table, exactly once by the sink's log; one run over what is there."""
    return hourly_means(observation_stream(spark, folder), late).writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
