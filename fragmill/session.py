"""A session with the settings that the engine's plans assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(cpus: int | None = None, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session; on a cluster, take the cluster's own session instead."""
    n = cpus or os.cpu_count() or 8
    builder = SparkSession.builder.master(f"local[{n}]").appName("fragmill").config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
