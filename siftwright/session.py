"""Sessions with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "siftwright", **conf: str) -> SparkSession:
    """A session with adaptive execution, skew joins and UTC; ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=defaults | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()
