"""Sinks: all tables of a result written together, or none seen."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def open_store(spark: SparkSession, path: str):
    """The file system that Spark writes a path to."""
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def write_tables(spark: SparkSession, tables: dict[str, DataFrame], path: str, form: str = "parquet", by: dict[str, str] | None = None) -> None:
    """Writes each table to a staging folder beside path, then moves them in; a failure leaves path as it was.

    Tables that are there already are moved aside first and deleted once all new ones are in; if a move fails, new tables
    go and the old ones are moved back; one that cannot be moved back stays in the folder aside, which the error names. by: column that a table is partitioned by. Files are moved with the store that
    Spark writes to.
    """
    root = path.rstrip("/")
    stage, aside = (f"{root}/_{kind}-{uuid.uuid4().hex}" for kind in ("stage", "aside"))
    to_path, store = spark._jvm.org.apache.hadoop.fs.Path, open_store(spark, stage)

    def move(a: str, b: str) -> None:
        store.mkdirs(to_path(b).getParent())
        if not store.rename(to_path(a), to_path(b)):
            raise OSError(f"{a} could not be moved to {b}")

    moved: list[str] = []
    kept: list[str] = []
    try:
        for name, df in tables.items():
            writer = df.write.format(form)
            if form == "csv":
                writer = writer.option("header", True)
            if by and name in by:
                writer = writer.partitionBy(by[name])
            writer.save(f"{stage}/{name}")
        for name in tables:
            if store.exists(to_path(f"{root}/{name}")):
                move(f"{root}/{name}", f"{aside}/{name}")
                kept.append(name)
            move(f"{stage}/{name}", f"{root}/{name}")
            moved.append(name)
    except BaseException:
        for name in moved:
            store.delete(to_path(f"{root}/{name}"), True)
        lost = []
        for name in kept:
            try:
                move(f"{aside}/{name}", f"{root}/{name}")
            except Exception as e:  # the others are still moved back
                lost.append(f"{name} ({e})")
        store.delete(to_path(stage), True)
        if lost:
            raise OSError(f"old tables are left in {aside}: {', '.join(lost)}") from None
        store.delete(to_path(aside), True)
        raise
    store.delete(to_path(stage), True)
    store.delete(to_path(aside), True)


def without_non_finite(df: DataFrame) -> DataFrame:
    """df with nulls for NaN and infinite numbers, as text formats have no words for them."""
    def clean(name: str) -> Column:
        c = F.col(f"`{name}`")
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(name)

    return df.select(*[clean(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema])


def batch_summary(runs: DataFrame, results: DataFrame, run: str, found: str) -> DataFrame:
    """runs with status (ok, empty, error) and what was found: results has run, found (a count) and error (text or null)."""
    joined = runs.join(results.select(run, found, "error"), run, "left")
    status = F.when(F.col("error").isNotNull(), "error").when(F.coalesce(found, F.lit(0)) > 0, "ok").otherwise("empty")
    return joined.withColumn("status", status)
