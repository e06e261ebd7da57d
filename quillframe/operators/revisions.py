"""Differences between two versions of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def paired(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """(key, old, new) of two content tables with unique keys; a side may be missing.

    A full outer join would lose the placement by key and make ``line_changes``
    shuffle every line; both sides meet in one grouping instead.
    """
    none = F.lit(None).cast("string")
    sides = old.select(key, F.col("content").alias("old"), none.alias("new")).unionByName(
        new.select(key, none.alias("old"), F.col("content").alias("new"))
    )
    return sides.repartition(key).groupBy(key).agg(F.max("old").alias("old"), F.max("new").alias("new"))


def changed_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where(~F.col("old").eqNullSafe(F.col("new")))


def _lines(text: Column, old: int, new: int) -> Column:
    return F.transform(
        F.coalesce(F.split(text, "\n"), F.array().cast("array<string>")),
        lambda line: F.struct(line.alias("line"), F.lit(old).alias("in_old"), F.lit(new).alias("in_new")),
    )


def line_changes(pairs: DataFrame, key: str) -> DataFrame:
    """(key, line, change, lines): lines added or removed, as multisets.

    Only changed pairs are taken apart. One grouping nets the two sides, and
    pairs from ``paired`` or an inner join on the key are already placed for it.
    """
    sides = F.concat(_lines(F.col("old"), 1, 0), _lines(F.col("new"), 0, 1))
    net = changed_pairs(pairs).select(key, F.inline(sides)).groupBy(key, "line").agg(
        (F.sum("in_new") - F.sum("in_old")).alias("_net")
    )
    return net.where(F.col("_net") != 0).select(
        key,
        "line",
        F.when(F.col("_net") > 0, F.lit("added")).otherwise(F.lit("removed")).alias("change"),
        F.abs("_net").alias("lines"),
    )
