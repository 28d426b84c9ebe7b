"""A local session with the settings that the plans rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "mnemospark", cores: str | None = None, memory: str = "8g") -> SparkSession:
    """UTC, AQE, and as many shuffle partitions as cores; on a cluster, use the session that it gives."""
    n = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
