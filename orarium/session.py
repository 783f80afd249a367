"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def prepared(spark: SparkSession) -> SparkSession:
    """Local times are read in their area's zone, instants in UTC; never in the machine's zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def build(app: str = "orarium", **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC; further settings by name (dots as double underscores)."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    }
    builder = SparkSession.builder.appName(app)
    for key, value in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
