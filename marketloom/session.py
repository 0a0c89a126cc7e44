"""Session settings that hold for every plan of this package."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that plans rely on for right results (zone) or for scale (AQE); sizes are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benches."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("marketloom")
    for k, v in {**SETTINGS, "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false", "spark.driver.memory": "8g", **extra}.items():
        b = b.config(k, v)
    return b.getOrCreate()
