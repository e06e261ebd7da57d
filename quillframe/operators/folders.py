"""Folder levels, assignment of files to folders, directory totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillframe.functions import paths
from quillframe.operators.ordering import in_parts, with_position

ROOT = ""
FOLDERS_PER_PART = 10_000


def folders_of(files: DataFrame) -> DataFrame:
    """Distinct folders of a file table with their depth, root included."""
    parents = files.select(paths.parent(F.col("path")).alias("folder")).distinct()
    every = parents.select(F.explode(paths.folders_down_to(F.col("folder"))).alias("folder")).distinct()
    return every.select("folder", paths.depth(F.col("folder")).alias("depth"))


def within_depth(folders: DataFrame, max_depth: int) -> DataFrame:
    return folders.where(F.col("depth") <= max_depth)


def folder_levels(folders: DataFrame, per_part: int = FOLDERS_PER_PART) -> DataFrame:
    """Folders grouped by depth as ordered lists.

    A level of up to ``per_part`` folders is one list; a larger one goes on in
    parts 1, 2, ... so no list grows with the corpus.
    """
    numbered = in_parts(with_position(folders, [F.col("folder")], keys=["depth"]), per_part)
    return numbered.groupBy("depth", "part").agg(
        F.array_sort(F.collect_list("folder")).alias("folders")
    )


def deepest_first(folders: DataFrame) -> DataFrame:
    return with_position(folders, [F.col("depth").desc(), F.col("folder")])


def assign_by_depth(files: DataFrame, max_depth: int, per_file: bool = False) -> DataFrame:
    """Deepest folder within ``max_depth``; ``per_file`` makes each file its own group."""
    path = F.col("path")
    return files.withColumn("folder", path if per_file else paths.folder_of(path, max_depth))


def assign_to_listed(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Deepest listed folder containing the file, the root if none does.

    Solved per distinct parent folder, then joined back on the parent.
    """
    parents = files.select(paths.parent(F.col("path")).alias("_parent")).distinct()
    chain = parents.select("_parent", F.explode(paths.folders_down_to(F.col("_parent"))).alias("folder"))
    best = chain.join(folders.select("folder").distinct(), "folder", "left_semi").groupBy("_parent").agg(
        F.max_by("folder", F.length("folder")).alias("folder")
    )
    return (
        files.withColumn("_parent", paths.parent(F.col("path")))
        .join(best, "_parent", "left")
        .select(*files.columns, F.coalesce("folder", F.lit(ROOT)).alias("folder"))
    )


def directory_totals(files: DataFrame) -> DataFrame:
    """Per folder: own files, files and bytes of the subtree, direct children.

    Files are summed per folder first, so the climb to the ancestors handles
    folders; the second step sums per child before summing per folder.
    """
    per_folder = files.groupBy(paths.parent(F.col("path")).alias("_parent")).agg(
        F.count(F.lit(1)).alias("_files"), F.sum("size_bytes").alias("_bytes")
    )
    chain = paths.folders_down_to(F.col("_parent"))
    climbed = per_folder.select("_files", "_bytes", chain.alias("_chain")).select(
        "_files", "_bytes", "_chain", F.posexplode("_chain").alias("_at", "folder")
    )
    child = F.try_element_at("_chain", F.col("_at") + 2)
    per_child = climbed.groupBy("folder", child.alias("_child")).agg(
        F.sum("_files").alias("_files"), F.sum("_bytes").alias("_bytes")
    )
    own = F.col("_child").isNull()
    own_files = F.coalesce(F.sum(F.when(own, F.col("_files"))), F.lit(0))
    return per_child.groupBy("folder").agg(
        own_files.alias("own_files"),
        (own_files + F.count("_child")).alias("children"),
        F.sum("_files").alias("subtree_files"),
        F.sum("_bytes").alias("subtree_bytes"),
    ).select(
        "folder",
        paths.depth(F.col("folder")).alias("depth"),
        paths.base_name(F.col("folder")).alias("name"),
        "own_files",
        "children",
        "subtree_files",
        "subtree_bytes",
    )


def tree_lines(files: DataFrame) -> DataFrame:
    """Listing rows: sorting by ``path`` and printing ``line`` shows the tree."""
    folders = folders_of(files).select(
        F.col("folder").alias("path"), F.concat(paths.base_name(F.col("folder")), F.lit("/")).alias("_label"), "depth"
    )
    leaves = files.select("path", paths.base_name(F.col("path")).alias("_label"), paths.depth(F.col("path")).alias("depth"))
    return folders.unionByName(leaves).select(
        "path", "depth", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("_label")).alias("line")
    )
