"""The engine's logical tables, bound to the driver's tables: how recordings, markers and runs are read there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000_000, 86_400_000_000  # microseconds


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular samples: channel, event_id, t (microseconds), value, kind."""
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("channel"),
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        "value",
        F.col("event_type").alias("kind"),
    )


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stimulation markers: the samples of kind error."""
    return signal(spark, sf_dir).where(F.col("kind") == "error")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials of runs: run_id, event_number, metric, window, band, dose, response."""
    li = load(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").cast("long").alias("event_number"),
        F.col("l_extendedprice").alias("metric"),
        F.col("l_returnflag").alias("win"),
        F.col("l_linestatus").alias("band"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("contact"),
        F.col("l_quantity").alias("response"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


#: The same for DuckDB.
SIGNAL = "s AS (SELECT user_id AS channel, event_id, epoch_us(ts) AS t, value, event_type AS kind FROM events)"
MARKERS = SIGNAL + ", m AS (SELECT * FROM s WHERE kind = 'error')"
TRIALS = (
    "tr AS (SELECT l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) AS event_number, l_extendedprice AS metric, "
    "l_returnflag AS win, l_linestatus AS band, l_partkey AS part, l_suppkey AS contact, l_quantity AS response, "
    "l_discount AS discount, l_tax AS tax FROM lineitem)"
)
