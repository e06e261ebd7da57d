"""Connected components of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillframe.scratch import written


def _large_star(links: DataFrame) -> DataFrame:
    """Links every node's larger neighbours to the least of its neighbourhood."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Links every node and its smaller neighbours to the least of these."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b); component is its smallest node.

    Links with a null end and links of a node to itself are ignored; repeated
    links and either direction are the same. Without links there are no rows.

    Each round is two contractions, written to shared storage, and ends in the
    star of every component; the number of rounds grows with the logarithm of
    the longest chain. Minima are combined before the shuffle, and the joins of
    a hub's links are inner joins that AQE can split.
    """
    now = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(now)
    while True:
        now = written(_small_star(_large_star(now)).where("a <> b").distinct(), "links")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(links: DataFrame) -> tuple:
    """Number and digest of the links: equal marks mean that nothing changed."""
    digest = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(digest), F.bit_xor(F.xxhash64("a", "b"))).first())
