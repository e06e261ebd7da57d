"""Change detection against the hash manifest.

Contents never enter a shuffle here: files are reduced to (path, hash, size)
in the scan, and contents are attached to the survivors last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillframe.functions import paths
from quillframe.functions.text import content_hash, universal_newlines
from quillframe.operators.ordering import with_position

#: So many selected rows may go to every task; beyond, they and the contents are sorted.
FEW_ROWS = 100_000


def fingerprints(files: DataFrame, key: str = "path") -> DataFrame:
    content = F.col("content")
    return files.select(
        key, content_hash(content).alias("sha256"), paths.size_bytes(content).alias("size_bytes")
    )


def changed(current: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Rows whose hash is absent from, or different in, the manifest."""
    return current.join(manifest.select(key, "sha256"), [key, "sha256"], "left_anti")


def run_counters(current: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """One row: found, changed, unchanged, failed (unreadable: empty hash)."""
    known = manifest.select(key, F.col("sha256").alias("_known"))
    failed = F.col("sha256") == ""
    same = F.coalesce(F.col("sha256") == F.col("_known"), F.lit(False))
    return current.join(known, key, "left").agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if(~same & ~failed).alias("changed"),
        F.count_if(same & ~failed).alias("unchanged"),
        F.count_if(failed).alias("failed"),
    )


def merge_manifest(old: DataFrame, new: DataFrame, key: str = "path", order: str | None = None) -> DataFrame:
    """New hashes replace old ones per path; other paths stay. One row per path.

    A path that occurs again in ``new`` has the hash of its largest ``order``;
    the largest hash decides between equal ones and without ``order``. A null
    path is a path like any other.
    """
    place = F.col(order) if order else F.lit(0)
    both = old.select(key, "sha256", F.lit(0).alias("_new"), F.lit(None).alias("_order")).unionByName(
        new.select(key, "sha256", F.lit(1).alias("_new"), place.alias("_order")))
    return both.groupBy(key).agg(F.max_by("sha256", F.struct("_new", "_order", "sha256")).alias("sha256"))


def latest(files: DataFrame, order: str, key: str = "path") -> DataFrame:
    """One row per path, that of the largest ``order``."""
    rest = [c for c in files.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("_row")
    return files.groupBy(key).agg(newest).select(key, "_row.*").select(*files.columns)


def work_order(changed_files: DataFrame, key: str = "path") -> DataFrame:
    """Smallest first, the key as tie-break; the place is a column."""
    return with_position(changed_files, [F.col("size_bytes"), F.col(key)])


def accepted(outputs: DataFrame, content: str = "new_content") -> DataFrame:
    """Outputs worth writing: an empty one means no change."""
    return outputs.where(output_status(F.col(content)) == "accepted")


def output_status(content: Column) -> Column:
    return F.when(F.length(content) > 0, F.lit("accepted")).otherwise(F.lit("no changes"))


def attach_content(selected: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """Bring the content back as text for the selected rows only; unreadable ones drop out.

    ``selected`` is read twice. Few rows go to the contents, which stay where they
    are. Contents are never broadcast: a planner that sees their small file, before
    they are derived or unpacked, would send all of them through the driver.
    """
    readable = files.where(F.col("content").isNotNull())
    contents = readable.select(key, universal_newlines(F.col("content")).alias("content"))
    few = selected.limit(FEW_ROWS + 1).count() <= FEW_ROWS
    return F.broadcast(selected).join(contents, key) if few else selected.join(contents.hint("shuffle_merge"), key)
