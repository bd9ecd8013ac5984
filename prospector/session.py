"""The session that all entry points use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "prospector", **config: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; ANSI mode stays on. config: Spark settings, dots written as double underscores."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in config.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
