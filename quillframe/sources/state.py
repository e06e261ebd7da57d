"""State files of earlier runs: hash manifest, summaries, ignore rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillframe import schemas
from quillframe.functions.text import strip
from quillframe.sources.storage import path_exists

SUMMARY_JSON = "array<struct<file:string,description:string>>"


def _manifest_rows(values: DataFrame) -> DataFrame:
    return values.select(F.explode(F.from_json("value", "map<string,string>")).alias("path", "sha256"))


def _summary_rows(values: DataFrame) -> DataFrame:
    return values.select(
        F.posexplode(F.from_json("value", SUMMARY_JSON)).alias("ordinal", "entry")
    ).select("ordinal", F.col("entry.file").alias("path"), F.col("entry.description"))


def _documents(spark: SparkSession, path: str, opening: str, closing: str) -> DataFrame:
    """Values of whole files; several values one after the other are several rows."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.split(
        "value", rf"(?<=\{closing})\s*[\r\n]\s*(?=\{opening})")).alias("value"))


def load_manifest_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects path -> hash, one a line, so a large export splits over tasks.

    A missing file is an empty manifest, a line that can't be read gives no row.
    Between runs the manifest is a versioned table, not JSON.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schemas.MANIFEST)
    return _manifest_rows(spark.read.text(path))


def load_manifest_document(spark: SparkSession, path: str) -> DataFrame:
    """``load_manifest_json`` for files whose object spans several lines.

    A file is one value in one task. Objects that follow each other on lines of
    their own are all read; a corrupt object gives no row.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schemas.MANIFEST)
    return _manifest_rows(_documents(spark, path, "{", "}"))


def load_summaries_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of file and description, one a line, with the array position kept."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "ordinal int, " + schemas.SUMMARIES)
    return _summary_rows(spark.read.text(path))


def load_summaries_document(spark: SparkSession, path: str) -> DataFrame:
    """``load_summaries_json`` for files whose array spans several lines."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "ordinal int, " + schemas.SUMMARIES)
    return _summary_rows(_documents(spark, path, "[", "]"))


def parse_ignore_rules(rule_files: DataFrame) -> DataFrame:
    """(dir, content) -> one row per pattern.

    A comment is a line whose first raw character is ``#``; an indented ``#``
    is a pattern.
    """
    lines = rule_files.select("dir", F.explode(F.split("content", "\n")).alias("line"))
    return lines.where(~F.col("line").startswith("#") & (strip(F.col("line")) != "")).select(
        "dir", strip(F.col("line")).alias("pattern")
    )
