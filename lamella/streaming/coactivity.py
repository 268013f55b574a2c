"""Activity by hour as a stream: the base table from which co-activity layers are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the Parquet files of events that appear in a folder."""
    return spark.readStream.schema(EVENTS).parquet(folder)


def hourly_activity(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """(layer, h, node, n): events of each user by type and hour; events later than ``late`` do not count."""
    counted = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("layer"), F.col("user_id").alias("node"))
    return counted.agg(F.count(F.lit(1)).alias("n")).select("layer", F.col("w.start").alias("h"), "node", "n")


def daily_contacts(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """(layer, node, n): events of each user by UTC day."""
    counted = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), F.col("user_id").alias("node"))
    return counted.agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("layer"), "node", "n")
