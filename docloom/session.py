"""Session defaults for running the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "docloom", **conf: str) -> SparkSession:
    """AQE with skew handling, Arrow, ANSI and UTC; anything else by ``conf`` (dots as double underscores)."""
    builder = SparkSession.builder.appName(name)
    defaults = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.ansi.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.parquet.compression.codec": "zstd",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
