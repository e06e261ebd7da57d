"""Checks and merges before rows enter the vector table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillframe.functions import paths


def batch_verdicts(batches: DataFrame) -> DataFrame:
    """Accept or reject whole batches; the first failing check names the reason."""
    counted = batches.groupBy("batch").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("id").alias("ids"),
        F.count("document").alias("documents"),
        F.count("metadata").alias("metadatas"),
        F.count_if(F.col("document") == "").alias("empty_documents"),
        F.count_distinct("id").alias("distinct_ids"),
    )
    uneven = (F.col("documents") != F.col("ids")) | (F.col("metadatas") != F.col("ids"))
    reason = (
        F.when(uneven, F.lit("length mismatch"))
        .when(F.col("empty_documents") > 0, F.lit("empty document"))
        .when(F.col("distinct_ids") < F.col("ids"), F.lit("duplicate id"))
        .otherwise(F.lit("ok"))
    )
    return counted.select("batch", "rows", (reason == "ok").alias("accepted"), reason.alias("reason"))


def merge_metadata(left: Column, right: Column) -> Column:
    """Union of two maps; the right one wins."""
    return F.map_concat(
        F.map_filter(left, lambda key, _: ~F.map_contains_key(right, key)), right
    )


def metadata_equals(key: str, value: str) -> Column:
    return F.col("metadata")[key] == value


def absent_only(rows: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id the table does not have; stored rows are never replaced."""
    return rows.join(stored.select(key), key, "left_anti")


def not_described(files: DataFrame, summaries: DataFrame) -> DataFrame:
    """Files without a summary, compared on the normalised path."""
    known = summaries.select(paths.normalize(F.col("path")).alias("_path"))
    return files.withColumn("_path", paths.normalize(F.col("path"))).join(
        known, "_path", "left_anti"
    ).select(*files.columns)
