"""Sessions of agents: status, transcript, pending tool calls, shared prefixes.

Events have a `kind` (SessionStarted, ModelTurn, ToolCall, ToolResult, Decision, SessionEnded, Put, Delete), a
`stream_name`, a `position`, and a `call_id` for tool events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import running_number

TRANSCRIPT = ("ModelTurn", "ToolCall", "ToolResult", "Decision")


def status(events: DataFrame) -> DataFrame:
    """stream_name, status (NotStarted, Active, Ended), started and ended positions, transcript and pending lengths."""
    edge = F.col("kind").isin("SessionStarted", "SessionEnded")
    out = events.groupBy("stream_name").agg(
        F.max_by("kind", F.when(edge, F.col("position"))).alias("last"),
        F.max(F.when(F.col("kind") == "SessionStarted", F.col("position"))).alias("started"),
        F.max(F.when(F.col("kind") == "SessionEnded", F.col("position"))).alias("ended"),
        F.count(F.when(F.col("kind").isin(*TRANSCRIPT), 1)).alias("entries"),
    )
    name = F.when(
        F.col("last") == "SessionStarted", "Active",
    ).when(F.col("last") == "SessionEnded", "Ended").otherwise("NotStarted")
    return out.select("stream_name", name.alias("status"), "started", "ended", "entries")


def transcript(events: DataFrame) -> DataFrame:
    """The transcript's entries, numbered from 0 in each stream."""
    return running_number(
        events.where(F.col("kind").isin(*TRANSCRIPT)), ["stream_name"],
    ).withColumnRenamed("number", "entry")


def pending_calls(events: DataFrame) -> DataFrame:
    """Tool calls without a later result: stream_name, call_id, position of the call."""
    tools = events.where(F.col("kind").isin("ToolCall", "ToolResult") & F.col("call_id").isNotNull())
    last = tools.groupBy("stream_name", "call_id").agg(
        F.max_by("kind", "position").alias("kind"), F.max("position").alias("position"),
    )
    return last.where("kind = 'ToolCall'").select("stream_name", "call_id", "position")


def shared_prefix(left: DataFrame, right: DataFrame, key: str, label: str, order: str = "position") -> DataFrame:
    """For each key of either side: how many first entries are alike, and each side's length."""
    def side(df: DataFrame, name: str) -> DataFrame:
        rows = running_number(
            df.select(F.col(key), F.col(order).alias("position"), F.col(label).alias("__label")), [key],
        )
        return rows.select(key, (F.col("number") + 1).alias("n"), F.col("__label").alias(name))

    both = side(left, "a").join(side(right, "b"), [key, "n"], "full")
    out = both.groupBy(key).agg(
        F.min(F.when(~F.coalesce(F.col("a") == F.col("b"), F.lit(False)), F.col("n"))).alias("off"),
        F.max("n").alias("most"), F.count("a").alias("left_length"), F.count("b").alias("right_length"),
    )
    return out.select(
        key, (F.coalesce(F.col("off") - 1, F.col("most"))).cast("long").alias("shared"), "left_length", "right_length",
    )
