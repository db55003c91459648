"""Extension: incremental metrics over an append-only run log (the batch system has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_log_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The JSON Lines of a folder as a stream, with an event time ``at``."""
    return spark.readStream.schema(schema).json(path).withColumn("at", F.timestamp_seconds("timestamp"))


def condition_counts(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Records and abstentions per condition and hour; repeated records within the watermark count once."""
    once = stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["run_id", "condition", "case_id"])
    return once.groupBy(F.window("at", "1 hour"), "condition").agg(
        F.count("*").alias("n"), F.count_if("abstained").alias("abstained"), F.avg("confidence").alias("mean_confidence")
    )


def event_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per type and window with their value; late ones within the watermark count."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    )
