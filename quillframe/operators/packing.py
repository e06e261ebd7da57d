"""Token-budget packing and context concatenation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillframe.operators.ordering import joined_in_order

BLOCK_ROWS = 100_000
SEPARATOR = "\n\n"


def pack_ranked(
    ranked: DataFrame, keys: Sequence[str], budget: Column, rank: str = "rank", tokens: str = "tokens"
) -> DataFrame:
    """Keep ranked rows while the running token total fits the budget.

    For groups of bounded size, such as top-k hits. Token counts are not
    negative, so the running total never falls and this stops at the first row
    that does not fit.
    """
    window = Window.partitionBy(*keys).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("running_tokens", F.sum(tokens).over(window)).where(
        F.col("running_tokens") <= budget
    )


def pack_ranked_any_size(
    ranked: DataFrame,
    keys: Sequence[str],
    budget: Column,
    rank: str = "rank",
    tokens: str = "tokens",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``pack_ranked`` for groups of any size.

    Ranks are cut into blocks. Totals per block are summed up first, giving each
    block its starting total; the window then runs inside one block, so a key
    that holds a third of all rows is shared out over its blocks. ``ranked`` is
    read twice: pass narrow rows and attach documents afterwards.
    """
    block = F.floor((F.col(rank) - 1) / block_rows).alias("_block")
    blocked = ranked.select("*", block)
    totals = blocked.groupBy(*keys, "_block").agg(F.sum(tokens).alias("_tokens"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_block").alias("_of_block"),
        F.coalesce(F.sum("_tokens").over(earlier), F.lit(0)).alias("_start"),
    )
    same_block = F.col("_block").eqNullSafe(F.col("_of_block"))
    for k in keys:  # a null key is a group like any other
        same_block &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    inside = (
        Window.partitionBy(*keys, "_block").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        blocked.join(starts, same_block)
        .withColumn("running_tokens", F.col("_start") + F.sum(tokens).over(inside))
        .where(F.col("running_tokens") <= budget)
        .drop("_block", "_start", "_of_block", *[f"_of_{k}" for k in keys])
    )


def context_text(packed: DataFrame, keys: Sequence[str], rank: str = "rank", document: str = "document") -> DataFrame:
    """Each kept document followed by a blank line, in rank order."""
    piece = F.concat(F.col(document), F.lit(SEPARATOR))
    return joined_in_order(packed, keys, rank, piece, "context")
