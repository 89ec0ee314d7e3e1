"""Session builder with the settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Splits a hot join key over tasks even where a later grouping by that key needs another shuffle.
SPLIT_HOT_KEYS = "spark.sql.adaptive.forceOptimizeSkewedJoin"


def build_session(app: str = "larder", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC dates.

    ``spark.sql.shuffle.partitions`` is left to the cluster; adaptive execution coalesces
    what turns out small. Extra settings are given as keyword arguments with ``__`` for dots.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config(SPLIT_HOT_KEYS, "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
