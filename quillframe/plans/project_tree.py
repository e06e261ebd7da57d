"""The project tree as listing rows, under the rules that the tree itself holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from quillframe.functions import paths
from quillframe.functions.text import universal_newlines
from quillframe.operators import folders, ignore
from quillframe.sources import state

RULE_FILE = ".gitignore"  # fixed value: name of rule files
IGNORED_SUFFIXES = (".daicache",)  # fixed value: suffixes left out by default


def own_rules(files: DataFrame, rule_file: str = RULE_FILE) -> DataFrame:
    """(dir, pattern) of the rule files among ``files`` (path, content); unreadable ones have none."""
    held = files.where((paths.base_name(F.col("path")) == rule_file) & F.col("content").isNotNull())
    return state.parse_ignore_rules(held.select(
        paths.parent(F.col("path")).alias("dir"), universal_newlines(F.col("content")).alias("content")))


def project_tree(
    files: DataFrame,
    ignored_folders: DataFrame | None = None,
    ignored_suffixes: Sequence[str] = IGNORED_SUFFIXES,
    apply_rules: bool = True,
    root_name: str = "",
) -> DataFrame:
    """(path, is_folder, depth, line) of every entry that no rule leaves out.

    A folder's rule file decides on the entries directly in it, and a folder that
    goes takes everything below along. ``ignored_folders`` (folder) go as wholes;
    if the root is one of them, nothing is left. Suffixes only concern files. A
    folder stays although all its files go. Sorting by ``paths.components(path)``
    and printing ``line`` shows the tree. Only rule files are read: contents of
    others never leave the scan. Repeated paths stay repeated; an empty table
    has no tree.
    """
    every = folders.folders_of(files).select(F.col("folder").alias("path"))
    inner = every.where(F.col("path") != folders.ROOT).withColumn("is_folder", F.lit(True))
    leaves = ignore.without_suffixes(files.select("path"), ignored_suffixes) if ignored_suffixes else files.select("path")
    entries = leaves.withColumn("is_folder", F.lit(False)).unionByName(inner)
    root = every.where(F.col("path") == folders.ROOT).withColumn("is_folder", F.lit(True))
    if apply_rules:
        entries = ignore.without_ignored(entries, own_rules(files))
    if ignored_folders is not None:
        listed = ignored_folders.select(paths.normalize(F.col("folder")).alias("folder")).distinct()
        itself = F.col("is_folder") & (F.col("path") == listed["folder"])
        entries = ignore.without_subtrees(entries, listed).join(listed, itself, "left_anti")
        root = root.join(listed, F.col("path") == listed["folder"], "left_anti")
    label = F.when(F.col("path") == folders.ROOT, F.lit(root_name)).otherwise(paths.base_name(F.col("path")))
    depth = paths.depth(F.col("path"))
    return entries.unionByName(root).select(
        "path", "is_folder", depth.alias("depth"),
        F.concat(F.repeat(F.lit("  "), depth), label, F.when(F.col("is_folder"), F.lit("/")).otherwise(F.lit(""))).alias("line"))
