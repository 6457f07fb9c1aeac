"""Weighted means of event streams by window, with a watermark for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """The events of a folder as they arrive; the zoneless time becomes an instant of the session's zone."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_mean(events: DataFrame, length: str = "1 day", late: str = "2 days", weight: str = "user_id", value: str = "value") -> DataFrame:
    """Sum of weights, weighted sum and count by window and type: sums add up, so state stays one row a window."""
    w = (F.col(weight) % 5 + 1).cast("double")
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", length).alias("window"), "event_type")
        .agg(F.sum(w * F.col(value)).alias("wx"), F.sum(F.when(F.col(value).isNotNull(), w)).alias("w"), F.count(value).alias("n_events"))
        .select(F.col("window.start").alias("window_start"), "event_type", F.expr("wx / w").alias("weighted_mean"), "n_events")
    )


def run_to_memory(df: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> StreamingQuery:
    """All data there are now, once."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return query
