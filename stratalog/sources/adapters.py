"""Tables as logs: the events, conversations and other tables that queries and tests read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import stream_id
from ..plans.catalog import Branch, Catalog

KINDS = {
    "signup": "SessionStarted", "view": "ToolCall", "click": "ToolResult", "purchase": "Decision",
    "error": "SessionEnded",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog_for(head: int) -> Catalog:
    """main; a leaves it at 40 % of the head; b leaves a at 30 %, below a's own fork; c leaves main at 60 %, archived."""
    return Catalog(
        [
            Branch("a", "a", "main", 4 * head // 10), Branch("b", "b", "a", 3 * head // 10),
            Branch("c", "c", "main", 6 * head // 10, status="archived"),
        ]
    )


def events_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Catalog, int]:
    """The events table as a log with branches, its catalog, and its head (from the file's row count)."""
    events = table(spark, sf_dir, "events")
    head = events.count()
    at, user = F.col("event_id"), F.pmod("user_id", F.lit(7))
    branch = F.when(
        (user == 1) & (at >= 4 * head // 10), "a",
    ).when((user == 2) & (at >= head // 2), "b").when((user == 3) & (at >= 6 * head // 10), "c").otherwise("main")
    log = events.select(
        at.alias("position"),
        (
            F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) * 1000
        ).alias("ts_nanos"),
        branch.alias("branch_id"), F.concat(F.lit("user-"), "user_id").alias("stream_name"),
        stream_id("events", branch, F.concat(F.lit("user-"), "user_id")).alias("stream_id"),
        F.floor(at / 10).cast("long").alias("batch_id"), "user_id", "event_type", "value", F.col("props").alias("body"),
    )
    return log, catalog_for(head), head


def kv_changes(log: DataFrame) -> DataFrame:
    """Puts of value under the body's k; an error deletes it."""
    return log.select(
        "position", F.get_json_object("body", "$.k").cast("long").alias("key"), "value",
        (F.col("event_type") == "error").alias("deleted"),
    )


def view_bodies(log: DataFrame) -> DataFrame:
    """The log with JSON bodies of an id, a kind, and k (a number for even users, a string for odd ones)."""
    k = F.get_json_object("body", "$.k")
    number = F.when(F.col("user_id") % 2 == 0, k).otherwise(F.concat(F.lit('"'), k, F.lit('"')))
    body = F.concat(
        F.lit('{"id":"u'), "user_id", F.lit('","k":'), number, F.lit(',"kind":"'), "event_type", F.lit('"}'),
    )
    return log.withColumn("body", body)


def session_events(log: DataFrame) -> DataFrame:
    kind = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[F.col("event_type")]
    return log.withColumn("kind", kind).withColumn("call_id", F.get_json_object("body", "$.k"))


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as streams: the turn is the revision; all of a conversation is one batch."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(
        F.concat(F.lit("conv-"), "conv_id").alias("stream_name"), F.col("turn").alias("stream_revision"),
        F.col("conv_id").alias("batch_id"), F.col("role").alias("event_type"), F.col("text").alias("body"),
    )
