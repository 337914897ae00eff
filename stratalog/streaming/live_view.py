"""Views kept up to date by a stream: each micro-batch is folded and merged into the stored state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.folds import last_writer_wins
from ..operators.views import ViewDefinition
from ..sources.files import Files

KEPT = 2


def latest_state(spark: SparkSession, target: str) -> DataFrame | None:
    """The newest whole version of a live view: key, value, position."""
    names = [n for n in Files(spark, target).names("") if n.startswith("v")]
    whole = [n for n in names if Files(spark, target).exists(f"{n}/_SUCCESS")]
    return spark.read.parquet(f"{target}/{whole[-1]}") if whole else None


def maintain(stream: DataFrame, definition: ViewDefinition, target: str, checkpoint: str):
    """Starts a stream that keeps a view of `stream`'s events in `target`.

    Versions are named after the batch that made them, so that a batch that runs again after a failure writes the same
    version from the same one before it: each event counts once.  The fold is associative: only the batch is folded.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        files = Files(spark, target)
        files.mkdirs()
        files.delete(f"v{number:012d}")
        state = latest_state(spark, target)
        fresh = definition.rows(batch).select("key", "value", "position")
        rows = fresh if state is None else last_writer_wins(state.unionByName(fresh), ["key"], ["value"])
        rows.write.parquet(f"{target}/v{number:012d}")
        for old in [n for n in files.names("") if n.startswith("v")][:-KEPT]:
            files.delete(old)

    return stream.writeStream.foreachBatch(merge).option(
        "checkpointLocation", checkpoint,
    ).trigger(availableNow=True).start()
