"""Session defaults. A session that already exists (a cluster's, a test's) is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "stayline", cores: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """The active session, or a local one with ``cores`` threads."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    n = cores or os.cpu_count() or 4
    builder = SparkSession.builder.appName(app).master(f"local[{n}]").config("spark.driver.memory", memory)
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(n), **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
