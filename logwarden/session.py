"""Session settings the operators are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Runtime SQL settings. Every one can be changed on a live session, so
#: ``configure`` is safe to call on a session that somebody else created.
RUNTIME_SETTINGS = {
    # Log timestamps are UTC on the wire; day and window boundaries follow.
    "spark.sql.session.timeZone": "UTC",
    # Skewed (key, time bucket) cells are split at run time, small ones merged.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Generated methods above HotSpot's 8000-byte limit are never compiled to
    # machine code; let Spark split such projections instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Spark's default; what an earlier query of the session asked for does not stay.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`RUNTIME_SETTINGS` to ``spark`` and return it."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "logwarden") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("LOGWARDEN_DRIVER_MEMORY", "8g"))
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
