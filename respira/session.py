"""A SparkSession with the settings the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "respira", master: str | None = None, **conf: str) -> SparkSession:
    """UTC session time zone and AQE are what the operators rely on; everything else is tuning."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
