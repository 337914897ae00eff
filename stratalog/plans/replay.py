"""Declarative reads: a plan names branch, window, streams, times and types; compile() turns it into one filter."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import OffsetBeyondHeadError, PositionUnavailableError
from ..functions.ids import content_column, partition_of
from ..limits import PARTITIONS, span
from .catalog import Catalog


@dataclass(frozen=True)
class AllStreams:
    def predicate(self) -> Column | None:
        return None


@dataclass(frozen=True)
class StreamSet:
    """Stream ids (which belong to one branch) and stream names (which a line of branches shares)."""

    ids: Sequence[str] = ()
    names: Sequence[str] = ()

    def predicate(self) -> Column | None:
        return F.col("stream_id").isin(*self.ids) if not self.names else F.col(
            "stream_name"
        ).isin(*self.names) if not self.ids else F.col("stream_id").isin(*self.ids) | F.col(
            "stream_name"
        ).isin(*self.names)


@dataclass(frozen=True)
class PartitionClass:
    """The streams whose id falls into one of `count` hash classes."""

    count: int
    index: int | Sequence[int]

    def predicate(self) -> Column | None:
        span("partitions", self.count, PARTITIONS)
        return partition_of(F.col("stream_id"), self.count).isin(
            *([self.index] if isinstance(self.index, int) else self.index)
        )


@dataclass(frozen=True)
class ReplayPlan:
    """branch None reads all branches, without inheritance; until None is the head; both upper bounds are exclusive."""

    branch: str | None = "main"
    start: int = 0
    after: int | None = None
    until: int | None = None
    streams: AllStreams | StreamSet | PartitionClass = field(default_factory=AllStreams)
    times: tuple[int | None, int | None] = (None, None)
    types: Sequence[str] = ()
    max_events: int | None = None
    #: Hash each event's content again while reading; an event that was changed is an error.
    verify: bool = False

    def first(self) -> int:
        return self.start if self.after is None else max(self.start, self.after + 1)


def visible(catalog: Catalog, branch: str, until: int) -> Column:
    """What a branch sees below `until`: one bound a branch of its line, at most 64, all pushed to the scan."""
    return reduce(
        Column.__or__,
        [(F.col("branch_id") == b) & (F.col("position") < cap) for b, cap in catalog.scopes(branch, until)],
    )


def check_window(start: int, until: int | None, head: int, floor: int = 0) -> int:
    """The resolved end.  An end beyond the head, and a start or end below the floor, are errors; a start beyond the end
    is an empty window."""
    if until is not None and until > head:
        raise OffsetBeyondHeadError(f"offset {until} beyond head {head}")
    if start < floor or (until is not None and until < floor):
        raise PositionUnavailableError(
            f"position {min(start, head if until is None else until)} is unavailable: retained history starts at {floor}, head is {head}"
        )
    return head if until is None else until


def compile_plan(
    plan: ReplayPlan, log: DataFrame, catalog: Catalog, head: int, floor: int = 0, ordered: bool = True,
) -> DataFrame:
    start = plan.first()
    until = check_window(start, plan.until, head, floor)
    wanted = [F.col("position") >= start, F.col("position") < until]
    if plan.branch is not None:
        wanted.append(visible(catalog, plan.branch, until))
    if (streams := plan.streams.predicate()) is not None:
        wanted.append(streams)
    low, high = plan.times
    if low is not None:
        wanted.append(F.col("ts_nanos") >= low)
    if high is not None:
        wanted.append(F.col("ts_nanos") < high)
    if plan.types:
        wanted.append(F.col("event_type").isin(*plan.types))
    out = log.where(reduce(Column.__and__, wanted))
    if plan.verify:
        changed = F.raise_error(
            F.concat(F.lit("the content of the event at position "), F.col("position"), F.lit(" was changed"))
        ).cast("boolean")
        out = out.where(F.when(F.col("content") == content_column(), True).otherwise(changed))
    if plan.max_events is not None:
        return out.orderBy("position").limit(plan.max_events)
    return out.orderBy("position") if ordered else out


@dataclass(frozen=True)
class TimelineDiff:
    ancestor: str
    divergence: int
    shared: DataFrame
    left: DataFrame
    right: DataFrame


def diff(
    log: DataFrame, catalog: Catalog, left: str, right: str, head: int, floor: int = 0, left_until: int | None = None,
    right_until: int | None = None, names: Sequence[str] = (), ordered: bool = True,
) -> TimelineDiff:
    """What two branches share and what each has alone: three lazy reads; the divergence comes from the catalog."""
    ends = [check_window(floor, u, head, floor) for u in (left_until, right_until)]
    ancestor, at = catalog.divergence(left, ends[0], right, ends[1])
    if at < floor:
        raise PositionUnavailableError(f"the timelines part at {at}, retained history starts at {floor}")
    streams = StreamSet(names=names) if names else AllStreams()
    read = lambda branch, start, until: compile_plan(
        ReplayPlan(branch, start, until=until, streams=streams), log, catalog, head, floor, ordered,
    )
    return TimelineDiff(
        ancestor.id, at, read(ancestor.id, floor, at), read(left, at, ends[0]), read(right, at, ends[1]),
    )
