"""A session with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "quillforge", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; everything else is the cluster's choice or conf."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"} | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
