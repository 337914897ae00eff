"""Indexed views: a fold with a primary key and named, multi-valued secondary indexes; get, range, prefix, by, len."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgumentError, NotFoundError
from ..functions import json_fields as J
from .folds import last_writer_wins


@dataclass(frozen=True)
class ViewDefinition:
    """A portable view of JSON bodies: key field, indexes (name -> field), and a filter on events (field, JSON value).

    The filter applies before the fold: a later event that it passes over leaves an older row as it is.  Keys are JSON
    strings; events with another key, or none, or a body that is no JSON, are passed over; nothing is ever deleted.
    """

    key: str
    indexes: Mapping[str, str] = field(default_factory=dict)
    where: tuple[str, object] | None = None

    def rows(self, log: DataFrame) -> DataFrame:
        """key, value (JSON text), position, and for each index ix_<name>."""
        events = log.where("codec = 'json'") if "codec" in log.columns else log
        events = events.withColumn("__v", J.parsed(F.col("body")))
        if self.where is not None:
            events = events.where(J.equals(F.col("__v"), *self.where))
        events = events.where(J.is_string(F.col("__v"), self.key)).select(
            J.text(F.col("__v"), self.key).alias("key"), F.col("body").alias("value"), "position",
        )
        state = last_writer_wins(events, ["key"], ["value"]).withColumn("__v", J.parsed(F.col("value")))
        return state.select(
            "key", "value", "position",
            *(F.array_compact(F.array(J.index_key(F.col("__v"), f))).alias(f"ix_{n}") for n, f in self.indexes.items())
        )

    def strict(self) -> bool:
        return True


@dataclass(frozen=True)
class TypedView:
    """A view of one's own: Column expressions for the change (op 'put' or 'delete', else passed over), key and value,
    and array-typed index keys of the current value."""

    op: Column
    key: Column
    value: Column
    indexes: Mapping[str, Column] = field(default_factory=dict)

    def rows(self, log: DataFrame) -> DataFrame:
        changes = log.select(
            self.op.alias("op"), self.key.alias("key"), self.value.alias("value"), "position",
        ).where("op in ('put', 'delete') and key is not null")
        state = last_writer_wins(changes, ["key"], ["value"], F.col("op") == "delete")
        return state.select("*", *(c.alias(f"ix_{n}") for n, c in self.indexes.items()))

    def strict(self) -> bool:
        return False


class IndexedView:
    """The queries of a view, over its rows.  All results are in key order where they are lists."""

    def __init__(self, definition: ViewDefinition | TypedView, log: DataFrame):
        self.definition, self.rows = definition, definition.rows(log)

    def get(self, key: object) -> DataFrame:
        return self.rows.where(F.col("key") == F.lit(key))

    def range(
        self, low: object = None, high: object = None, include_low: bool = True, include_high: bool = False,
    ) -> DataFrame:
        out, key = self.rows, F.col("key")
        if low is not None:
            out = out.where(key >= F.lit(low) if include_low else key > F.lit(low))
        if high is not None:
            out = out.where(key <= F.lit(high) if include_high else key < F.lit(high))
        return out.orderBy("key")

    def prefix(self, prefix: str | bytes) -> DataFrame:
        return self.rows.where(F.startswith("key", F.lit(prefix))).orderBy("key")

    def by(self, index: str, key: object) -> DataFrame:
        """Rows whose current value has this index key.  An unknown index has no rows in a typed view, and is an error in
        a portable one."""
        if index not in self.definition.indexes:
            if self.definition.strict():
                raise NotFoundError(f"index {index}")
            return self.rows.limit(0)
        wanted = J.index_key_of(key) if self.definition.strict() else key
        return self.rows.where(F.array_contains(f"ix_{index}", F.lit(wanted))).orderBy("key")

    def index(self, index: str) -> DataFrame:
        """The index itself: index_key, key."""
        if index not in self.definition.indexes:
            raise InvalidArgumentError(f"index {index}")
        return self.rows.select(F.explode(f"ix_{index}").alias("index_key"), "key").distinct()

    def len(self) -> DataFrame:
        return self.rows.agg(F.count("*").alias("len"))


class LayeredView(IndexedView):
    """A view of a stored state and the few rows that a suffix of the log has changed since.

    The state lies sorted by key, and each index sorted by index key, so that look-ups prune to a few row groups (min and
    max, Bloom filters); the suffix is bounded by whoever stores states, and is small enough to be sent to all tasks.
    """

    def __init__(
        self, definition: ViewDefinition, state: DataFrame, indexes: Mapping[str, DataFrame], suffix: DataFrame | None,
    ):
        self.definition, self.state, self.indexes, self.suffix = definition, state, indexes, suffix
        columns = ["key", "value", "position", *(f"ix_{n}" for n in definition.indexes)]
        self.rows = state.select(columns)
        if suffix is not None:
            self.rows = last_writer_wins(
                self.rows.unionByName(suffix.select(columns)), ["key"], columns[1:2] + columns[3:],
            ).select(columns)

    def by(self, index: str, key: object) -> DataFrame:
        if index not in self.definition.indexes:
            raise NotFoundError(f"index {index}")
        wanted = J.index_key_of(key)
        found = self.indexes[index].where(F.col("index_key") == F.lit(wanted)).select("key", "value", "position")
        if self.suffix is not None:
            fresh = self.suffix.where(F.array_contains(f"ix_{index}", F.lit(wanted))).select("key", "value", "position")
            found = found.join(F.broadcast(self.suffix.select("key")), "key", "left_anti").union(fresh)
        return found.orderBy("key")

    def len(self) -> DataFrame:
        keys = self.state.select("key")
        if self.suffix is None:
            return keys.agg(F.count("*").alias("len"))
        # all of the state's keys, and those of the suffix that the state hasn't
        known = keys.join(F.broadcast(self.suffix.select("key")), "key", "left_semi").select("key")
        new = self.suffix.select("key").join(known, "key", "left_anti")
        return keys.agg(F.count("*").alias("n")).union(new.agg(F.count("*").alias("n"))).agg(F.sum("n").alias("len"))


def store_state(view: IndexedView, path: str) -> None:
    """Writes a portable view's rows: `state`, sorted by key, and for each index one table, sorted by index key."""
    columns = ["key", "value", "position", *(f"ix_{n}" for n in view.definition.indexes)]
    save = lambda rows, keys, place: rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option(
        f"parquet.bloom.filter.enabled#{keys[0]}", "true",
    ).option("parquet.bloom.filter.adaptive.enabled", "true").parquet(f"{path}/{place}")
    save(view.rows.select(columns), ["key"], "state")
    state = view.rows.sparkSession.read.schema(view.rows.select(columns).schema).parquet(f"{path}/state")
    for i, n in enumerate(view.definition.indexes):
        save(
            state.select(F.explode(f"ix_{n}").alias("index_key"), "key", "value", "position"), ["index_key", "key"],
            f"index-{i}",
        )


def state_digest(rows: DataFrame) -> list:
    """Number and checksum of a state's rows, in whatever order they are."""
    return list(
        rows.agg(
            F.count("*"), F.bit_xor(F.xxhash64("key", "value", "position")),
            F.coalesce(F.sum(F.pmod(F.xxhash64("key", "value"), F.lit(1 << 31))), F.lit(0)),
        ).first()
    )
