"""Order-bearing columns without putting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillframe.scratch import written

_ROW_BITS = 33  # layout of monotonically_increasing_id: slot above, row below


def with_position(
    df: DataFrame,
    order: Sequence[Column],
    keys: Sequence[str] = (),
    position: str = "position",
    is_table: bool = False,
) -> DataFrame:
    """Number the rows 1, 2, ... in ``order``, per ``keys`` if given.

    A range sort spreads the rows, however many one key has. Its result is
    written once, so slot sizes and row numbers come from the same sort; the
    start of each slot is a running sum over one row per slot. Pass narrow rows
    and make ``order`` total. A range sort reads its input twice, to sample and
    to sort, so anything that is not a stored table (``is_table``) is written
    before.
    """
    df = df if is_table else written(df, "unsorted")
    numbered = written(
        df.orderBy(*[F.col(key) for key in keys], *order).withColumn(
            "_at", F.monotonically_increasing_id()
        ),
        "sorted",
    )
    slot = F.shiftright("_at", _ROW_BITS)
    row = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    slots = numbered.groupBy(slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_rows"))
    # One row per sort task: bounded by the number of shuffle partitions.
    before = Window.partitionBy(F.lit(0)).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.select(
        "_slot", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    placed = (
        numbered.withColumn("_slot", slot)
        .join(F.broadcast(starts), "_slot")
        .withColumn(position, F.col("_start") + row + 1)
        .drop("_slot", "_start", "_at")
    )
    if not keys:
        return placed
    firsts = placed.groupBy(*keys).agg(F.min(position).alias("_first"))
    matched = placed.alias("p").join(
        firsts.alias("f"),
        [F.col(f"p.{key}").eqNullSafe(F.col(f"f.{key}")) for key in keys],
    )
    return matched.select(
        *[F.col(f"p.{c}") for c in placed.columns if c != position],
        (F.col(f"p.{position}") - F.col("_first") + 1).alias(position),
    )


def in_parts(df: DataFrame, rows_per_part: int, position: str = "position") -> DataFrame:
    """Cut numbered groups into parts of bounded size; small groups are part 0."""
    return df.withColumn("part", F.floor((F.col(position) - 1) / rows_per_part).cast("int"))


def joined_in_order(df: DataFrame, groups: Sequence[str], position: str, piece: Column, name: str, separator: str = "") -> DataFrame:
    """Concatenate the pieces of each (bounded) group by position."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), piece.alias("piece"))))
    return df.groupBy(*groups).agg(
        F.array_join(F.transform(ordered, lambda s: s["piece"]), separator).alias(name)
    )


def first_per_key(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """First row per key. ``min_by`` combines before the shuffle, so a hot key
    sends one row per task; a ranking window would send all of them."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordinal).alias("_row")).select(
        *keys, "_row.*"
    )


def last_definition_wins(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Values of the last definition at the place of the first one."""
    rest = [c for c in df.columns if c not in keys and c != ordinal]
    return df.groupBy(*keys).agg(
        F.min(ordinal).alias(ordinal), F.max_by(F.struct(*rest), ordinal).alias("_row")
    ).select(*keys, ordinal, "_row.*")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best k rows per key; each task keeps k per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
