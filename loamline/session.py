"""Session settings the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "loamline", master: str | None = None) -> SparkSession:
    """A session with UTC time, adaptive execution and partitions sized by bytes rather than by a fixed count."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.shuffle.partitions", os.environ.get("LOAMLINE_SHUFFLE_PARTITIONS", "200"))
        .getOrCreate()
    )
