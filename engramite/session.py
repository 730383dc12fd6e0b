"""Session factory: UTC, adaptive execution, skew-join splitting."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "engramite", conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the package's defaults; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(name)
    for key, value in (DEFAULTS | (conf or {})).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
