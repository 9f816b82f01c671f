"""Live jobs over build logs (STR-1, 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LOG = "map_id long, seq long, ts timestamp, level string, msg string, type string, node long, path long"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stream of JSON log files."""
    return spark.readStream.schema(LOG).json(path)


def windowed(log: DataFrame, size: str = "1 hour") -> DataFrame:
    """STR-1: warnings and errors per tumbling window, map and type; works on tables as on
    streams that carry a watermark on ``ts``."""
    return log.where(F.col("level").isin("warning", "error")).groupBy(F.window("ts", size).alias("window"), "map_id", "type", "level").agg(F.count("*").alias("n"))


def monitor(log: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """The stream's finished windows; rows later than the watermark are dropped."""
    return windowed(log.withWatermark("ts", late), size)


def keep_windows(log: DataFrame, path: str, checkpoint: str, size: str = "1 hour", late: str = "1 hour") -> StreamingQuery:
    """STR-1 as a stream: appends windows to a table of Parquet files once the watermark has passed their end; takes what files there are
    and ends. Started again with the same checkpoint it goes on from there, and leaves out rows of windows that have ended."""
    rows = monitor(log, size, late).select(F.col("window.start").alias("start"), "map_id", "type", "level", "n")
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def new_missing_nodes(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """STR-2: each map's missing nodes once, within the watermark that bounds the state."""
    missing = log.where(F.col("msg").startswith("Cannot find feature")).withWatermark("ts", late)
    return missing.dropDuplicatesWithinWatermark(["map_id", "node"]).select("map_id", "node", "ts")


def keep_missing_nodes(log: DataFrame, path: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Writes new missing nodes to a table of Parquet files as they come, each batch once."""
    return new_missing_nodes(log, late).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
