"""Conversation records: role mapping and step logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from larder.operators import scale

PENDING = "TBD"
SEP = "\n---\n"
ROLES = [("human", "user"), ("ai", "assistant")]


def map_roles(messages: DataFrame, roles: Sequence[tuple[str, str]] = tuple(ROLES)) -> DataFrame:
    """Keep messages of known roles under their new names."""
    pairs = [F.lit(x) for pair in roles for x in pair]
    return messages.filter(F.col("role").isin([a for a, _ in roles])).withColumn(
        "role", F.element_at(F.create_map(*pairs), F.col("role"))
    )


def _line() -> Column:
    return F.concat(F.lit("Tool: "), "tool", F.lit(", Input: "), "tool_input", F.lit("\nOutput: "), "log")


def scratchpad(steps: DataFrame, last: int = 4) -> DataFrame:
    """The last steps of a conversation, pending ones dropped afterwards, joined in order.

    A step is (conv_id, turn, tool, tool_input, log).
    """
    recent = scale.ranked(steps, ["conv_id"], [F.desc("turn")], last).filter(F.col("log") != PENDING)
    # At most `last` rows per conversation.
    return recent.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("turn"), _line().alias("line")))).alias("rows")
    ).select("conv_id", F.array_join(F.transform("rows", lambda r: r["line"]), SEP).alias("scratchpad"))


def full_log(steps: DataFrame) -> DataFrame:
    """All finished steps of a conversation as one text."""
    rows = steps.filter(F.col("log") != PENDING).withColumn("line", _line())
    return scale.concat_ordered(rows, ["conv_id"], "turn", "line", SEP, out="scratchpad")
