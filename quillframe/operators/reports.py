"""Approval, per-folder change reports, last messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillframe.functions.text import decision
from quillframe.operators.ordering import in_parts, joined_in_order, with_position

REPORT_HEADER = "Automated docstring additions.\n\n**Files Changed:**\n"  # fixed value
LINES_PER_PART = 50_000


def approved_only(changes: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Changes whose answer is a yes; unclear and missing answers do not pass."""
    yes = decisions.where(decision(F.col("answer"))).select(key)
    return changes.join(yes, key, "left_semi")


def change_reports(changeset: DataFrame, lines_per_part: int = LINES_PER_PART) -> DataFrame:
    """(folder, part, body): header, then one line per file in path order.

    A folder of up to ``lines_per_part`` files is one body. A larger one goes on
    in parts whose bodies, joined in order, are the report.
    """
    numbered = in_parts(with_position(changeset.select("folder", "path"), [F.col("path")], ["folder"]), lines_per_part)
    line = F.concat(F.lit("- `"), F.col("path"), F.lit("`\n"))
    bodies = joined_in_order(numbered, ["folder", "part"], "position", line, "body")
    header = F.when(F.col("part") == 0, F.lit(REPORT_HEADER)).otherwise(F.lit(""))
    return bodies.withColumn("body", F.concat(header, F.col("body")))


def last_messages(messages: DataFrame, role: str | None = None) -> DataFrame:
    """Last message per conversation, of any role unless one is given."""
    chosen = messages if role is None else messages.where(F.col("role") == role)
    return chosen.groupBy("conv_id").agg(
        F.max_by(F.struct("turn", "role", "text"), "turn").alias("_last")
    ).select("conv_id", "_last.*")


def messages_in_order(messages: DataFrame) -> DataFrame:
    """Messages of a table with their place in the conversation, oldest first."""
    order = [F.col("turn"), F.col("role"), F.col("text")]
    return with_position(messages, order, ["conv_id"], is_table=True)
