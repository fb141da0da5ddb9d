"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "scriptoria", **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow; the master and sizes are the deployment's business."""
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
