"""Spark sessions with the settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def builder(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession.Builder:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pulsegrid")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("PULSEGRID_DRIVER_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    spark = builder(cores, shuffle_partitions).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Makes Python workers find this package where the driver found it (a cluster's executors have it installed)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])
    return spark
