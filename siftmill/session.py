"""Spark sessions with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def local_session(name: str = "siftmill", cores: int | str = "*", memory: str = "6g", partitions: int = 8) -> SparkSession:
    """One JVM, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = configured(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
