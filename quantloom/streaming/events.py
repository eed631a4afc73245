"""Streams of records: late data by watermark on when a record became available, windows, sessions, first of each id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def record_stream(spark: SparkSession, path: str, schema: T.StructType, files_each: int = 16) -> DataFrame:
    """Parquet files as they land; the number of files a batch takes is bounded."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def first_of_each(stream: DataFrame, key: str = "event_id", time: str = "ts", late: str = "2 days") -> DataFrame:
    """Drops later records of a key; the state of a key goes when the watermark has passed it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_activity(stream: DataFrame, keys: tuple[str, ...], time: str = "ts", width: str = "1 day", slide: str | None = None, late: str = "2 days", value: str = "value") -> DataFrame:
    """Counts and sums by tumbling or sliding window."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    g = stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("largest"))
    return g.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "total", "largest")


def sessions(stream: DataFrame, keys: tuple[str, ...], time: str = "ts", gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    g = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Writes what there is now and stops."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
