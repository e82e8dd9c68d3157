"""Session settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app_name: str = "strandspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, ANSI mode and UTC; ``conf`` overrides by key with dots as ``__``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
