"""Sessions for local runs. On a cluster the session comes from spark-submit."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(
    cpus: int | str = 8, app: str = "tableloom", options: dict[str, str] | None = None
) -> SparkSession:
    """A local session with adaptive execution on and shuffles sized to the cores."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TABLELOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for name, value in (options or {}).items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
