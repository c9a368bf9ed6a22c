"""A session with the settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "colloquy", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution and UTC; everything else is the cluster's."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
