"""Session construction for local runs, tests and the bench."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "tesserae", cpus: int | str = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution on.  On a cluster, build your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    )
    return builder.getOrCreate()
