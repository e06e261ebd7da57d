"""What has to be done in this run, and what the next run must know."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillframe import schemas
from quillframe.operators import changes
from quillframe.scratch import written
from quillframe.sources import storage


def known_hashes(spark: SparkSession, state_root: str) -> DataFrame:
    """(path, sha256): the newest hash of every path that was ever recorded."""
    return storage.load_log(spark, f"{state_root}/manifest", schemas.MANIFEST, "path", "sha256")


def compact_hashes(spark: SparkSession, state_root: str) -> None:
    storage.compact_log(spark, f"{state_root}/manifest", schemas.MANIFEST, "path", "sha256")


def pending_files(files: DataFrame, state_root: str) -> DataFrame:
    """(path, sha256, size_bytes) of the files the manifest does not know in this form.

    Contents are read and hashed once; the narrow result is written.
    """
    manifest = known_hashes(files.sparkSession, state_root)
    return written(changes.changed(changes.fingerprints(files), manifest), "pending")


def record_hashes(contents: DataFrame, state_root: str) -> DataFrame:
    """Add the hashes of newly written contents, one row per path, as a version of their own.

    What is written grows with ``contents`` only; ``known_hashes`` finds the
    newest per path, ``compact_hashes`` joins the versions now and then.
    """
    spark = contents.sparkSession
    fresh = changes.fingerprints(contents).select("path", "sha256")
    storage.save_version(changes.merge_manifest(fresh.limit(0), fresh), f"{state_root}/manifest")
    return known_hashes(spark, state_root)
