"""The committed-batch feed: whole batches in global order, filtered by branch, stream and type, in pages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FeedFilter:
    """A batch is wanted if its branch is among the branches (exactly, without inheritance), any of its events is in one
    of the streams, and any of its events is of one of the types; an empty list asks for nothing."""

    branches: Sequence[str] = ()
    streams: Sequence[str] = ()
    types: Sequence[str] = ()

    def predicate(self):
        parts = [
            F.max(F.col(c).isin(*v)).alias(f"__{c}")
            for c, v in (("branch_id", self.branches), ("stream_name", self.streams), ("event_type", self.types)) if v
        ]
        return parts, reduce(
            lambda a, b: a & b,
            [
                F.col(f"__{c}")
                for c, v in (("branch_id", self.branches), ("stream_name", self.streams), ("event_type", self.types))
                if v
            ],
            F.lit(True),
        )


def batches(log: DataFrame, start: int, durable_head: int, wanted: FeedFilter | None = None) -> DataFrame:
    """batch_id, first, last (positions), events: of complete, durable batches from `start` on, in any order."""
    parts, keep = (wanted or FeedFilter()).predicate()
    rows = log.where((F.col("position") >= start) & (F.col("position") < durable_head))
    out = rows.groupBy("batch_id").agg(
        F.min("position").alias("first"), F.max("position").alias("last"), F.count("*").alias("events"), *parts
    )
    return out.where(keep).select("batch_id", "first", "last", "events")


def delivered(log: DataFrame, start: int, durable_head: int, wanted: FeedFilter | None = None) -> DataFrame:
    """All events of the wanted batches (the whole batch, if any of its events fits)."""
    found = batches(log, start, durable_head, wanted).select("batch_id")
    return log.where(
        (F.col("position") >= start) & (F.col("position") < durable_head)
    ).join(found, "batch_id", "left_semi")


def page_of(sizes: Sequence[tuple[int, int]], page_items: int, page_bytes: int) -> int:
    """How many of (items, bytes) fit a page; the first one always does."""
    items = held = taken = 0
    for n, size in sizes:
        if taken and (items + n > page_items or held + size > page_bytes):
            break
        items, held, taken = items + n, held + size, taken + 1
    return taken


def read_stream(spark: SparkSession, path: str, schema: str, max_files: int = 16) -> DataFrame:
    """A log directory as a stream: new commits' files as they appear.  `max_files` bounds a micro-batch as the number
    of batches bounds a page.  Use a checkpointLocation for a durable consumer."""
    return spark.readStream.schema(schema).option(
        "maxFilesPerTrigger", max_files,
    ).option("recursiveFileLookup", "true").parquet(f"{path}/data")


def follow(stream: DataFrame, target: str, checkpoint: str):
    """Copies a stream of events to a follower's table, each event once: rows whose event_id is there are passed over."""

    def ingest(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["event_id"])
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(target)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            fresh = fresh.join(spark.read.parquet(target).select("event_id"), "event_id", "left_anti")
        fresh.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(ingest).option(
        "checkpointLocation", checkpoint,
    ).trigger(availableNow=True).start()


def missing_events(source: DataFrame, follower: DataFrame) -> DataFrame:
    """What a follower has yet to ingest, by event id."""
    return source.join(follower.select("event_id"), "event_id", "left_anti")


def consumer_lag(consumers: DataFrame, durable_head: int, floor: int = 0) -> DataFrame:
    """consumers (consumer_id, position): how far each is behind, and whether the floor has passed it."""
    return consumers.select(
        "consumer_id", "position", (F.lit(durable_head) - F.col("position")).cast("long").alias("lag"),
        (F.col("position") < floor).alias("behind_floor"),
    )
