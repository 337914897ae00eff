"""Folds of a log into state: last writer wins by position, sessions, and folds of one's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_writer_wins(
    changes: DataFrame, keys: list[str], values: list[str], deleted: Column | None = None, order: str = "position",
) -> DataFrame:
    """Of each key the values of its latest change, without keys whose latest change deletes them; with its position.

    One shuffle of at most one row a key and task: max_by is combined on the map side.
    """
    held = F.struct(*values, (deleted if deleted is not None else F.lit(False)).alias("__gone"))
    state = changes.groupBy(*keys).agg(F.max_by(held, order).alias("__last"), F.max(order).alias(order))
    return state.where("not __last.__gone").select(*keys, *(F.col(f"__last.{v}").alias(v) for v in values), order)


def merge_states(
    *states: DataFrame, keys: list[str], values: list[str], deleted: str | None = None, order: str = "position",
) -> DataFrame:
    """A snapshot and the fold of what follows it, as one state.  Last-writer-wins is associative, so this is exact, if
    the snapshot keeps deleted keys as such (the column `deleted`) or the suffix says which keys it deletes."""
    union = states[0]
    for s in states[1:]:
        union = union.unionByName(s, allowMissingColumns=True)
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else None
    return last_writer_wins(union, keys, values, gone, order)


def changes_with_deletes(
    changes: DataFrame, keys: list[str], values: list[str], deleted: Column, order: str = "position",
) -> DataFrame:
    """The latest change of each key, deletes included: what a snapshot stores."""
    held = F.struct(*values, deleted.alias("deleted"))
    state = changes.groupBy(*keys).agg(F.max_by(held, order).alias("__last"), F.max(order).alias(order))
    return state.select(*keys, *(F.col(f"__last.{v}").alias(v) for v in [*values, "deleted"]), order)


def ordered_fold(
    log: DataFrame,
    keys: list[str],
    schema: str,
    start: Callable[[], object],
    step: Callable[[object, dict], object] | None,
    finish: Callable[[tuple, object], dict],
    order: str = "position",
    run: Callable[[object, pd.DataFrame], object] | None = None,
) -> DataFrame:
    """A fold that needs every event in order: step(state, event) over each key's events, one at a time, or, much faster,
    run(state, events) over stretches of one key's events as they lie in a batch (a key can have several).

    Events stream through a sorted partition; memory holds one state at a time, however long a key's history is.
    """
    columns = log.columns

    def one_by_one(state: object, events: pd.DataFrame) -> object:
        for row in events.itertuples(index=False, name=None):
            state = step(state, dict(zip(columns, row, strict=True)))
        return state

    advance = run or one_by_one

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, done = None, None, []
        for batch in batches:
            if batch.empty:
                continue
            same = batch[keys].eq(batch[keys].shift()) | (batch[keys].isna() & batch[keys].shift().isna())
            heads = [0, *(i for i in (~same.all(axis=1)).to_numpy().nonzero()[0].tolist() if i), len(batch)]
            for low, high in zip(heads, heads[1:]):
                events = batch.iloc[low:high]
                mine = tuple(None if pd.isna(x) else x for x in events.iloc[0][keys])
                if mine != key:
                    if key is not None:
                        done.append(finish(key, state))
                    key, state = mine, start()
                state = advance(state, events)
            if len(done) >= 1000:
                yield pd.DataFrame(done)
                done = []
        if key is not None:
            done.append(finish(key, state))
        if done:
            yield pd.DataFrame(done)

    return log.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(fold, schema)


def exactly_once(log: DataFrame, keys: list[str], step: str) -> DataFrame:
    """Of each key: steps done, the next step, and whether each step came once and none is missing."""
    out = log.groupBy(*keys).agg(
        F.count("*").alias("events"), F.count_distinct(step).alias("steps"), F.max(step).alias("last"),
    )
    return out.select(
        *keys, "steps", (F.col("last") + 1).alias("next_step"),
        ((F.col("events") == F.col("steps")) & (F.col("steps") == F.col("last") + 1)).alias("once"),
    )


def block_digest(log: DataFrame, block: int = 1000) -> DataFrame:
    """Number of positions and order-sensitive digest of each block of positions: combines to a digest of the log."""
    return log.groupBy(F.floor(F.col("position") / block).cast("long").alias("block")).agg(
        F.count("*").alias("events"),
        F.md5(F.array_join(F.array_sort(F.collect_list("position")), ",")).alias("digest"),
    )


def prefix_count(log: DataFrame, marker: Column, block: int = 4096) -> DataFrame:
    """Adds `before`: how many rows with a smaller position are markers.  Three levels, so that no task sees all rows (the
    last one has a row for each block of blocks, 16 million positions by default).

    `log` is read more than once and must give the same positions each time; a row whose block has no sum, which can only
    be if it doesn't, is an error.
    """
    from pyspark.sql import Window

    rows = log.withColumn("__block", F.floor(F.col("position") / block)).withColumn("__mark", marker.cast("long"))
    sums = rows.groupBy("__block").agg(F.sum("__mark").alias("__sum"))
    sums = sums.withColumn("__top", F.floor(F.col("__block") / block))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    running = lambda c, w: F.coalesce(F.sum(c).over(earlier(w)), F.lit(0))
    tops = sums.groupBy("__top").agg(F.sum("__sum").alias("__t"))
    tops = tops.select("__top", running("__t", Window.orderBy("__top")).alias("__above"))
    within = Window.partitionBy("__top").orderBy("__block")
    base = sums.join(tops, "__top").select("__block", (F.col("__above") + running("__sum", within)).alias("__base"))
    out = rows.join(base, "__block", "left")
    lost = F.raise_error(F.lit("prefix_count: the rows changed between two reads")).cast("long")
    out = out.withColumn("__base", F.when(F.col("__base").isNull(), lost).otherwise(F.col("__base")))
    out = out.withColumn(
        "before", F.col("__base") + running("__mark", Window.partitionBy("__block").orderBy("position")),
    )
    return out.drop("__block", "__mark", "__base")


def running_number(log: DataFrame, keys: list[str], block: int = 1 << 16) -> DataFrame:
    """Adds `number`: how many rows of the same keys have a smaller position.  Rows are numbered inside blocks of positions,
    and blocks add up, so that a key which a third of all rows has doesn't come to one task."""
    from pyspark.sql import Window

    rows = log.withColumn("__block", F.floor(F.col("position") / block))
    sums = rows.groupBy(*keys, "__block").agg(F.count("*").alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(
        *(F.col(k).alias(f"__{k}") for k in keys), F.col("__block").alias("__at"),
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"),
    )
    inside = F.row_number().over(Window.partitionBy("__block", *keys).orderBy("position")) - 1
    same = F.col("__block") == F.col("__at")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = rows.withColumn("__inside", inside).join(base, same)
    return out.withColumn("number", F.col("__base") + F.col("__inside")).drop(
        "__block", "__at", "__base", "__inside", *(f"__{k}" for k in keys)
    )
