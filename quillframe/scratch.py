"""Intermediate tables on storage every executor can reach."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
WAREHOUSE_DIR = "spark.sql.warehouse.dir"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names.

    Without ``spark.checkpoint.dir`` it is a folder of the warehouse, if the
    executors can share that: a folder of one machine loses data with it, so on
    a cluster a warehouse without a file system of its own raises.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    return shared_warehouse(spark.conf.get(WAREHOUSE_DIR), spark.sparkContext.master)


def shared_warehouse(warehouse: str, master: str) -> str:
    """Scratch folder in the warehouse; raises if only one machine of a cluster has it."""
    scheme = warehouse.split(":", 1)[0] if ":" in warehouse else "file"
    if scheme == "file" and not master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors reach: {warehouse} is local to a machine")
    return f"{warehouse.rstrip('/')}/_scratch"


def _application_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/quillframe-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under one folder per application, which its owner can clear."""
    return f"{_application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts lineage and keeps later reads consistent."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch_owner(spark: SparkSession) -> Iterator[str]:
    """Deletes the application's scratch tables at its end.

    For the code that owns the session: results read lazily from scratch tables
    have to be saved before the block ends.
    """
    folder = _application_folder(spark)
    try:
        yield folder
    finally:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
