"""A checkpoint saver's queries: the latest, one by id, the newest before one, and the writes that belong to one.

Rows: thread, checkpoint_id, position, kind ('checkpoint' or 'writes'), body.  Bodies are JSON, so a saver's bytes go into
them as base64 (functions/encoding.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame) -> DataFrame:
    """Each thread's newest checkpoint."""
    held = F.max_by(F.struct("checkpoint_id", "body", "position"), "position").alias("c")
    return rows.where("kind = 'checkpoint'").groupBy("thread").agg(held).select("thread", "c.*")


def by_id(rows: DataFrame, checkpoint_id: str) -> DataFrame:
    return rows.where((F.col("kind") == "checkpoint") & (F.col("checkpoint_id") == checkpoint_id))


def newest_before(rows: DataFrame, before: int | Column | None = None, limit: int | None = None) -> DataFrame:
    """Checkpoints of each thread, newest first (`rank` from 1), of those below a position, at most `limit`."""
    rows = rows.where("kind = 'checkpoint'")
    if before is not None:
        rows = rows.where(F.col("position") < before)
    rows = rows.withColumn(
        "rank", F.row_number().over(Window.partitionBy("thread").orderBy(F.desc("position"))).cast("long"),
    )
    return rows if limit is None else rows.where(F.col("rank") <= limit)


def pending_writes(rows: DataFrame) -> DataFrame:
    """Checkpoints with the bodies of their writes, in order; an empty list if there are none."""
    writes = rows.where("kind = 'writes'").groupBy("thread", "checkpoint_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "body"))).alias("w")
    )
    both = rows.where("kind = 'checkpoint'").join(writes, ["thread", "checkpoint_id"], "left")
    return both.withColumn(
        "writes", F.coalesce(F.transform("w", lambda x: x["body"]), F.array().cast("array<string>")),
    ).drop("w")
