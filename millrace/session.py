"""A SparkSession with the settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """UTC and ANSI on; everything else is left to Spark, which re-plans joins and partitions as it runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", **{k.replace("__", "."): v for k, v in conf.items()}}
    return builder.config(map=settings).getOrCreate()
