"""Session settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "siftlake", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow; a cluster's own settings win."""
    defaults = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(name).config(map=defaults | conf).getOrCreate()
