"""Session with the settings that the engine is planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quillon", **options: str) -> SparkSession:
    """AQE with skew joins and coalescing, ANSI on, UTC; `options` win, with dots written as double underscores."""
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | {k.replace("__", "."): v for k, v in options.items()}
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()
