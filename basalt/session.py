"""Sessions with the settings that the engine's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI arithmetic raises on overflow, division by zero and bad casts; AQE re-plans joins and partitions at run time.
SETTINGS = {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}


def session(**settings: str) -> SparkSession:
    """The running session, or a new one; settings use _ for . in names."""
    build = SparkSession.builder
    for k, v in {**SETTINGS, **{k.replace("_", "."): v for k, v in settings.items()}}.items():
        build = build.config(k, v)
    return build.getOrCreate()
