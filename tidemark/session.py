"""A session with the settings that the plans rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "tidemark", cores: int | None = None, **conf: str) -> SparkSession:
    cores = cores or int(os.environ.get("BENCH_CPUS", "0")) or os.cpu_count() or 4
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.master": f"local[{cores}]",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
