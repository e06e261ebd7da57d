"""Enough tasks for work that costs more than its bytes suggest."""

from __future__ import annotations

from pyspark.sql import DataFrame

BYTES_PER_CORE = 128 * 1024 * 1024
TASKS_PER_CORE = 2


def spread(df: DataFrame) -> DataFrame:
    """Share a small input out over all cores before Python or model work.

    A small table sits in a few row groups and would run on a few cores; moving
    it is cheap. An input of more than ``BYTES_PER_CORE`` per core already has
    more scan splits than cores and is left where it is, unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores * TASKS_PER_CORE) if size < cores * BYTES_PER_CORE else df
