"""Sinks: versioned tables, history, descriptions and vector collections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillframe import schemas
from quillframe.functions import paths


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    filesystem, target = _hadoop(spark, path)
    return filesystem.exists(target)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Finished versions of a table, oldest first."""
    filesystem, target = _hadoop(spark, root)
    if not filesystem.exists(target):
        return []
    found = []
    for status in filesystem.listStatus(target):
        match = re.fullmatch(r"v=(\d+)", status.getPath().getName())
        if match and path_exists(spark, f"{root}/v={match[1]}/_SUCCESS"):
            found.append(int(match[1]))
    return sorted(found)


def save_version(df: DataFrame, root: str) -> str:
    """Full overwrite as a new version, so the version being read stays whole.

    A version counts once its ``_SUCCESS`` marker is there; a run that dies half
    way leaves the previous one current.
    """
    done = versions(df.sparkSession, root)
    target = f"{root}/v={(done[-1] if done else 0) + 1}"
    df.write.mode("overwrite").parquet(target)
    return target


def load_version(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Newest finished version, or an empty table before the first run."""
    done = versions(spark, root)
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/v={done[-1]}")


def load_log(spark: SparkSession, root: str, schema: str, key: str, value: str) -> DataFrame:
    """Newest value per key over all finished versions, each of which holds only its own rows."""
    done = versions(spark, root)
    if not done:
        return spark.createDataFrame([], schema)
    parts = [f"{root}/v={n}" for n in done]
    rows = spark.read.option("basePath", root).schema(f"{schema}, v long").parquet(*parts)
    return rows.groupBy(key).agg(F.max_by(value, "v").alias(value))


def compact_log(spark: SparkSession, root: str, schema: str, key: str, value: str) -> None:
    """Writes the newest values as one version, then deletes the older ones.

    For the owner of the table, between runs. A failure half way changes no
    result: the new version counts once complete, and it says what all older
    ones together say.
    """
    old = versions(spark, root)
    if len(old) > 1:
        save_version(load_log(spark, root, schema, key, value), root)
        for n in old:
            filesystem, target = _hadoop(spark, f"{root}/v={n}")
            filesystem.delete(target, True)


def export_manifest_json(manifest: DataFrame, path: str) -> None:
    """One object path -> hash a line, as ``state.load_manifest_json`` reads it."""
    manifest.select(F.to_json(F.create_map("path", "sha256")).alias("value")).write.mode("overwrite").text(path)


def export_summaries_json(summaries: DataFrame, path: str) -> None:
    """One array of one entry a line, as ``state.load_summaries_json`` reads it."""
    entry = F.struct(F.col("path").alias("file"), "description")
    summaries.select(F.to_json(F.array(entry)).alias("value")).write.mode("overwrite").text(path)


def described(summaries: DataFrame, out_dir: str, new_suffix: str = ".txt") -> DataFrame:
    """Rows of the description sink: where each text goes, and its top folder."""
    path = F.col("path")
    return summaries.select(
        "path",
        F.concat(F.lit(out_dir.rstrip("/") + "/"), paths.with_suffix(path, new_suffix)).alias("out_path"),
        "description",
        paths.folder_of(path, 1).alias("top_folder"),
    )


def save_descriptions(summaries: DataFrame, root: str, out_dir: str, run: int = 1) -> None:
    """One table partitioned by run and top folder.

    A repeat with the same number overwrites what was left before, so the number
    changes once these summaries are kept and no longer fresh.

    The rebalance hint lets AQE split a folder that holds most rows and join
    small ones, instead of one writer per folder.
    """
    described(summaries, out_dir).hint("rebalance", "top_folder").write.mode("overwrite").partitionBy(
        "top_folder"
    ).parquet(f"{root}/run={run}")


def backup_rows(prior: DataFrame, at: Column) -> DataFrame:
    """Prior contents stamped to the second; ``at`` is given so runs repeat."""
    return prior.select("path", "content", F.date_format(at, "yyyyMMddHHmmss").alias("stamp"))


def keep_history(prior: DataFrame, at: Column, root: str, run: int = 1) -> None:
    """Prior contents by run and time; a repeated run overwrites what it left before."""
    backup_rows(prior, at).write.mode("overwrite").partitionBy("stamp").parquet(f"{root}/run={run}")


def get_or_create_collection(spark: SparkSession, name: str, location: str | None = None) -> DataFrame:
    """The named vector table; an empty one with the vector schema if absent."""
    if not spark.catalog.tableExists(name):
        where = f" LOCATION '{location}'" if location else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({schemas.VECTORS}) USING parquet{where} "
            "PARTITIONED BY (file_type)"
        )
        if location and path_exists(spark, location):
            spark.catalog.recoverPartitions(name)  # rows an earlier session left there
    return spark.table(name)


def append_to_collection(rows: DataFrame, name: str) -> None:
    columns = rows.sparkSession.table(name).columns
    rows.select(*columns).hint("rebalance", "file_type").write.mode("append").insertInto(name)
