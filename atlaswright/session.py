"""The Spark session the operators expect."""

from pyspark.sql import SparkSession


def session(app: str = "atlaswright", **conf: str) -> SparkSession:
    """Adaptive execution, UTC, and the last of repeated map keys winning."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
