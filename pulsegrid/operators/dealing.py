"""How rows are dealt to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that one task gets, about; groups of one key stay together.
TASK_ROWS = 500_000
#: Below this many rows a task more of them are not worth it.
LEAST_ROWS = 20_000


def dealt(df: DataFrame, keys: list[str], of: DataFrame | None = None) -> DataFrame:
    """df with rows of equal keys in one partition, in so many partitions that each has about TASK_ROWS rows, however
    large the table is: a partition's memory in sorts and aggregations by the keys then does not grow.

    Small partitions are put together by the bytes that they are shuffled in, which say little about rows; a number given
    here stays. of: a table with about as many rows, and cheaper to count; tables dealt by the same one meet without
    another shuffle.
    """
    rows = (df if of is None else of).count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, -(-rows // TASK_ROWS), min(cores, rows // LEAST_ROWS)), *keys)
