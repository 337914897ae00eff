"""The engine's Python interface: append, replay, views, forks, diff, watch, snapshots, retention."""

from __future__ import annotations

import builtins
import json
import threading
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import (
    CancelledError, ClosedError, ConflictError, EngineError, InvalidArgumentError, NotFoundError,
    PositionUnavailableError, RuntimeMissingError,
)
from .functions.ids import fingerprint, new_id
from .functions.json_fields import index_key_of
from .limits import (
    BOOTSTRAP_BYTES, BRANCH_NAME_BYTES, CONSUMER_ID_BYTES, PAGE_BYTES, PAGE_EVENTS, PARTITIONS, name, span, within,
)
from .operators import retention as R
from .operators.folds import last_writer_wins
from .operators.views import IndexedView, LayeredView, ViewDefinition, state_digest, store_state
from .plans.catalog import Branch
from .plans.replay import PartitionClass, ReplayPlan, StreamSet, check_window, compile_plan
from .plans.replay import diff as plan_diff
from .sources.store import CommitPolicy, LogStore, Receipt, checksum
from .streaming.feed import FeedFilter, delivered, page_of

SNAPSHOTS_KEPT = 2
POLL_SECONDS = 0.05
#: Events since a view's newest stored state from which on a query stores a new one; fewer are folded for each query.
MATERIALISE = 50_000


def row_of(r: Any) -> dict[str, Any]:
    """The shape in which events are returned."""
    return {
        "offset": r["position"], "timestamp_ms": max(r["ts_nanos"], 0) // 1_000_000, "event_id": r["event_id"],
        "batch_id": r["batch_id"], "batch_index": r["batch_index"], "branch_id": r["branch_id"],
        "namespace": r["stream_name"], "stream_revision": r["stream_revision"], "event_type": r["event_type"],
        "schema_version": r["schema_version"], "codec": r["codec"],
        "metadata": {k: bytes(v) for k, v in (r["metadata"] or {}).items()},
        "body": json.loads(r["body"]) if r["codec"] == "json" else bytes(r["payload"]),
    }


def size_of(r: Any) -> int:
    return len(r["payload"]) + sum(len(v) for v in (r["metadata"] or {}).values())


class Reader:
    """Pages of a replay whose end was fixed when it was opened."""

    def __init__(self, db: Database, plan: ReplayPlan, until: int, page_events: int, page_bytes: int):
        span("page_events", page_events, PAGE_EVENTS)
        span("page_bytes", page_bytes, PAGE_BYTES)
        self.db, self.plan, self.until, self.page_events, self.page_bytes = db, plan, until, page_events, page_bytes
        self.continuation, self.state = plan.first(), "open"
        db.readers.add(self)

    def next_page(self) -> dict[str, Any]:
        if self.state == "cancelled":
            raise CancelledError("the reader was cancelled")
        if self.state == "closed":
            raise NotFoundError("the reader is closed")
        rows = self.db.some(
            replace(self.plan, start=self.continuation, after=None, until=self.until), self.page_events + 1,
        )
        taken = page_of([(1, size_of(r)) for r in rows], self.page_events, self.page_bytes)
        self.continuation = rows[taken]["position"] if taken < len(rows) else self.until
        return {
            "records": [row_of(r) for r in rows[:taken]], "continuation": self.continuation,
            "done": self.continuation >= self.until,
        }

    def cancel(self) -> None:
        if self.state == "closed":
            raise NotFoundError("the reader is closed")
        self.state = "cancelled"
        self.db.readers.discard(self)

    def close(self) -> None:
        self.state = "closed"
        self.db.readers.discard(self)


class Watch(Iterator[dict[str, Any]]):
    """Durable batches as they come, event by event; ack() stores the position behind the last event handed out."""

    def __init__(
        self, db: Database, position: int, wanted: FeedFilter, namespace: str | None, consumer: str | None,
        timeout: float | None, page_batches: int, page_bytes: int,
    ):
        span("page_batches", page_batches, PAGE_EVENTS)
        span("page_bytes", page_bytes, PAGE_BYTES)
        self.db, self.position, self.wanted, self.namespace, self.consumer, self.timeout = db, position, wanted, namespace, consumer, timeout
        self.page_batches, self.page_bytes = page_batches, page_bytes
        self.ready: list[dict[str, Any]] = []
        self.seen, self.open = position, True
        db.feeds.add(self)

    def next_page(self) -> list[dict[str, Any]]:
        """Whole batches up to the page's bounds; the first one always fits."""
        head = self.db.store.durable_head
        if self.position >= head:
            return []
        rows: list[Any] = []
        end, events = self.position, PAGE_EVENTS
        while end < head and len(rows) <= PAGE_EVENTS:  # whole files, twice as many positions each time
            start, end = end, self.db.store.window_end(end, head, events)
            log = self.db.store.log(True, start, end)
            rows += delivered(
                log, start, end, self.wanted,
            ).orderBy("position").limit(PAGE_EVENTS + 1 - len(rows)).collect()
            events *= 2
        cut = len(rows) > PAGE_EVENTS
        if cut and rows[0]["batch_id"] == rows[-1]["batch_id"]:  # one batch beyond a page's events: it comes whole
            log = self.db.store.log(True, rows[0]["position"], head)
            rows = log.where(F.col("batch_id") == rows[0]["batch_id"]).orderBy("position").collect()
        found: dict[str, list] = {}
        for r in rows:
            found.setdefault(r["batch_id"], []).append(r)
        groups = builtins.list(found.values())
        if cut and len(groups) > 1:
            groups.pop()  # may be incomplete
        taken = page_of([(1, sum(map(size_of, g))) for g in groups], self.page_batches, self.page_bytes)
        self.position = end if taken == len(groups) and not cut else groups[taken - 1][-1]["position"] + 1
        return [
            row_of(r) for g in groups[:taken] for r in g if self.namespace is None or r["stream_name"] == self.namespace
        ]

    def __next__(self) -> dict[str, Any]:
        until = None if self.timeout is None else time.monotonic() + self.timeout
        while self.open:
            if self.ready:
                event = self.ready.pop(0)
                self.seen = event["offset"] + 1
                return event
            before = self.position
            self.ready = self.next_page()
            if not self.ready:
                self.seen = self.position
                if self.position > before:
                    continue
                left = None if until is None else until - time.monotonic()
                if left is not None and left <= 0:
                    break
                with self.db.advanced:
                    self.db.advanced.wait(POLL_SECONDS if left is None else min(POLL_SECONDS, left))
                if self.db.closed:
                    break
        raise StopIteration

    def ack(self) -> int:
        if self.consumer is None:
            raise InvalidArgumentError("only a watch with a consumer_id can acknowledge")
        at = self.seen if self.ready else self.position
        self.db.store.record({"type": "consumer", "id": self.consumer, "position": at})
        return at

    def close(self) -> None:
        self.open = False
        self.db.feeds.discard(self)

    def __enter__(self) -> Watch:
        return self

    def __exit__(self, *_: object) -> bool:
        self.close()
        return False


class View:
    """Queries of a registered view; results are the latest values, in key order."""

    def __init__(self, db: Database, view_name: str, stale: bool = False):
        self.db, self.name, self.stale = db, view_name, stale

    @property
    def _now(self) -> IndexedView:
        if self.stale and self.name in self.db.cache:
            return self.db.cache[self.name][1]
        return self.db.indexed(self.name)

    def _ask(
        self, query: Callable[[IndexedView], DataFrame], columns: Sequence[str] = ("value",),
    ) -> builtins.list[Any]:
        """A view whose fold fails is marked as failed and raises; appends and other views go on."""
        try:
            rows = query(self._now).select(*columns).collect()
        except EngineError:
            raise
        except Exception as e:
            self.db.failed[self.name] = str(e)
            raise
        self.db.failed.pop(self.name, None)
        return rows

    def _values(self, query: Callable[[IndexedView], DataFrame]) -> builtins.list[Any]:
        return [json.loads(r["value"]) for r in self._ask(query)]

    def get(self, key: str) -> Any:
        found = self._values(lambda v: v.get(key))
        return found[0] if found else None

    def by(self, index: str, key: Any) -> builtins.list[Any]:
        return self._values(lambda v: v.by(index, key))

    def range(self, lo: str, hi: str) -> builtins.list[Any]:
        return self._values(lambda v: v.range(lo, hi))

    def prefix(self, prefix: str) -> builtins.list[Any]:
        return self._values(lambda v: v.prefix(prefix))

    def len(self) -> int:
        return self._ask(lambda v: v.len(), ["len"])[0]["len"]


class Database:
    def __init__(self, spark: SparkSession, path: str, commit: CommitPolicy, snapshots: CommitPolicy):
        self.spark, self.store, self.snapshot_policy = spark, LogStore(spark, path, commit), snapshots
        self.lock, self.advanced, self.closed = threading.RLock(), threading.Condition(), False
        self.readers: set[Reader] = set()
        self.feeds: set[Watch] = set()
        self.plans: dict[str, dict[str, Any]] = {}
        self.runtimes: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.cache: dict[str, tuple[tuple, IndexedView]] = {}
        self.folded, self.snapped_bytes, self.snapped_at = 0, 0, time.monotonic()
        self.failed: dict[str, str] = {}
        self.building: set[str] = set()
        #: Snapshots and states whose rows were compared with their checksum, and whether they are sound.
        self.sound: dict[str, bool] = {}

    # --- plumbing

    def _open(self) -> None:
        if self.closed:
            raise ClosedError("the engine is closed")

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_: object) -> bool:
        self.close()
        return False

    def close(self) -> None:
        if not self.closed:
            self.store.close()
            self.closed = True
            for w in builtins.list(self.feeds):
                w.close()
            with self.advanced:
                self.advanced.notify_all()

    def branch(self, branch_name: str) -> Branch:
        return self.store.catalog.named(branch_name)

    def frame(self, plan: ReplayPlan) -> DataFrame:
        """A replay as a lazy DataFrame: the way to read much."""
        self._open()
        until = check_window(plan.first(), plan.until, self.store.head, self.store.floor)
        return compile_plan(
            plan, self.store.log(start=plan.first(), until=until), self.store.catalog, self.store.head,
            self.store.floor,
        )

    def some(self, plan: ReplayPlan, want: int) -> list[Any]:
        """The first `want` events of a plan whose end is given: opens whole files, twice as many positions each time, until
        it has them."""
        rows: list[Any] = []
        at, events = plan.first(), want
        while at < plan.until and len(rows) < want:
            end = self.store.window_end(at, plan.until, events)
            rows += self.frame(replace(plan, start=at, after=None, until=end, max_events=want - len(rows))).collect()
            at, events = end, 2 * events
        return rows

    # --- appends

    def _append(self, branch: str, namespace: str, events: Sequence[Mapping[str, Any]], **options: Any) -> Receipt:
        with self.lock:
            self._open()
            before = self.store.durable_head
            receipt = self.store.append(branch, namespace, [dict(e) for e in events], **options)
            if self.store.durable_head > before:
                with self.advanced:
                    self.advanced.notify_all()
            self._maybe_snapshot(receipt)
            return receipt

    def append(self, namespace: str, event: Any) -> int:
        return self._append("main", namespace, [{"body": event}]).first_position

    def append_branch(self, branch: str, namespace: str, event: Any) -> int:
        return self._append(self.branch(branch).id, namespace, [{"body": event}]).first_position

    def append_receipt(self, namespace: str, event: Any) -> dict[str, Any]:
        return asdict(self._append("main", namespace, [{"body": event}]))

    def append_batch(
        self, namespace: str, events: Sequence[Mapping[str, Any]], *, branch: str | None = None,
        expected_revision: str | int | None = None, idempotency_key: str | bytes | None = None,
        durability: str = "buffered",
    ) -> dict[str, Any]:
        if isinstance(expected_revision, bool) or not (
            expected_revision in (None, "any", "no_stream") or isinstance(expected_revision, int)
        ):
            raise InvalidArgumentError("expected_revision must be None, 'any', 'no_stream' or a number")
        key = idempotency_key.hex() if isinstance(idempotency_key, bytes) else idempotency_key
        for e in events:
            if not isinstance(e, Mapping) or "body" not in e:
                raise InvalidArgumentError("an event is a mapping with a body")
            if unknown := set(e) - {"body", "event_type", "schema_version", "event_id", "metadata", "codec"}:
                raise InvalidArgumentError(f"unknown fields of an event: {sorted(unknown)}")
        at = "main" if branch is None else self.branch(branch).id
        return asdict(
            self._append(at, namespace, events, expected=expected_revision, idempotency_key=key, durability=durability)
        )

    def ingest_batch(self, rows: Sequence[Mapping[str, Any]]) -> dict[str, Any]:
        """A batch of another log (rows as its replay returns them), once; ids are kept, positions are this log's."""
        first = rows[0]
        alike = all(
            r["batch_id"] == first["batch_id"] and r["namespace"] == first["namespace"]
            and r["branch_id"] == first["branch_id"] and r["offset"] == first["offset"] + i and r["batch_index"] == i
            for i, r in enumerate(rows)
        )
        if not alike:
            raise InvalidArgumentError("a replicated batch is one stream's, with contiguous positions")
        events = [
            {k: r[k] for k in ("body", "event_type", "schema_version", "event_id", "metadata", "codec")} for r in rows
        ]
        return asdict(
            self._append(first["branch_id"], first["namespace"], events, batch_id=first["batch_id"], durability="sync")
        )

    def commit(self) -> int:
        with self.lock:
            self._open()
            head = self.store.commit()
        with self.advanced:
            self.advanced.notify_all()
        return head

    def head(self) -> int:
        self._open()
        return self.store.head

    def durable_head(self) -> int:
        self._open()
        return self.store.durable_head

    def uncommitted_count(self) -> int:
        return len(self.store.buffer)

    def uncommitted_bytes(self) -> int:
        return self.store.held

    def set_commit_policy(
        self, every_bytes: int | None = None, every_count: int | None = None, every_millis: int | None = None,
    ) -> None:
        self.store.policy = CommitPolicy(every_bytes, every_count, every_millis)

    def commit_policy(self) -> CommitPolicy:
        return self.store.policy

    # --- reads

    def records_from(self, position: int) -> DataFrame:
        """All events from a position on, of all branches, in order."""
        return self.frame(ReplayPlan(None, position))

    def system_records(self) -> list[dict[str, Any]]:
        """Branches, views, consumers, bootstraps and anchors, in the order in which they were recorded."""
        return [dict(r) for r in self.store.state.system]

    def open_reader(
        self, namespace: str | None, start: int = 0, end: int | None = None, page_events: int = 256,
        page_bytes: int = 1 << 20, branch: str = "main",
    ) -> Reader:
        self._open()
        at = self.branch(branch).id
        until = check_window(start, end, self.store.head, self.store.floor)
        return Reader(
            self,
            ReplayPlan(at, start, until=until, streams=StreamSet(names=[namespace])) if namespace is not None
            else ReplayPlan(at, start, until=until),
            until, page_events, page_bytes,
        )

    def replay(self, namespace: str, start: int | None = None, end: int | None = None) -> list[dict[str, Any]]:
        return [
            row_of(r)
            for r in self.frame(
                ReplayPlan(
                    "main", self.store.floor if start is None else start, until=end,
                    streams=StreamSet(names=[namespace]),
                )
            ).collect()
        ]

    def replay_each(
        self, namespace: str, call: Callable[[dict[str, Any]], None], start: int = 0, end: int | None = None,
        branch: str | None = None,
    ) -> None:
        """Calls with each event, one partition of them in memory at a time; without a branch, over all branches."""
        for r in self.frame(
            ReplayPlan(branch and self.branch(branch).id, start, until=end, streams=StreamSet(names=[namespace]))
        ).toLocalIterator():
            call(row_of(r))

    def history(self, namespace: str) -> list[dict[str, Any]]:
        return self.replay(namespace)

    def branch_history(self, branch: str, namespace: str) -> list[dict[str, Any]]:
        return [
            row_of(r)
            for r in self.frame(
                ReplayPlan(self.branch(branch).id, self.store.floor, streams=StreamSet(names=[namespace]))
            ).collect()
        ]

    def branch_ancestry(self, branch: str) -> list[dict[str, Any]]:
        return [self._branch(b) for b in self.store.catalog.ancestry(self.branch(branch).id)]

    def branch_named(self, branch: str) -> dict[str, Any]:
        return self._branch(self.branch(branch))

    def branch_children(self, branch: str) -> list[dict[str, Any]]:
        return [self._branch(b) for b in self.store.catalog.children(self.branch(branch).id)]

    def branch_common_ancestor(self, left: str, right: str) -> dict[str, Any]:
        return self._branch(self.store.catalog.common_ancestor(self.branch(left).id, self.branch(right).id))

    @staticmethod
    def _branch(b: Branch) -> dict[str, Any]:
        return {
            "id": b.id, "name": b.name, "parent_id": b.parent, "fork_position": b.fork_position,
            "created_at_unix_nanos": b.created_at, "status": b.status, "metadata": dict(b.metadata),
        }

    def fork(self, namespace: str, at: int, parent: str | None = None) -> str:
        with self.lock:
            self._open()
            made = name("branch name", f"{namespace}-fork-{at}", BRANCH_NAME_BYTES)
            return self.store.fork(self.branch(parent or "main").id, at, made).name

    def fork_branch(
        self, parent: str, at: int, branch_name: str, metadata: dict[str, bytes] | None = None,
    ) -> dict[str, Any]:
        with self.lock:
            self._open()
            return self._branch(self.store.fork(self.branch(parent).id, at, branch_name, metadata))

    def archive_branch(self, branch: str) -> dict[str, Any]:
        with self.lock:
            self._open()
            return self._branch(self.store.archive(self.branch(branch).id))

    def diff(
        self, left: str, right: str, namespace: str | None = None, left_until: int | None = None,
        right_until: int | None = None, page_events: int = 256, page_bytes: int = 1 << 20,
    ) -> dict[str, Any]:
        self._open()
        a, b, floor = self.branch(left).id, self.branch(right).id, self.store.floor
        found = plan_diff(self.store.log(), self.store.catalog, a, b, self.store.head, floor, left_until, right_until)
        streams = StreamSet(names=[namespace]) if namespace is not None else ReplayPlan().streams
        read = lambda branch, start, until: Reader(
            self, ReplayPlan(branch, start, until=until, streams=streams), until, page_events, page_bytes,
        )
        ends = [self.store.head if u is None else u for u in (left_until, right_until)]
        return {
            "common_ancestor": self._branch(self.store.catalog.get(found.ancestor)),
            "divergence_offset": found.divergence, "shared": read(found.ancestor, floor, found.divergence),
            "left": read(a, found.divergence, ends[0]), "right": read(b, found.divergence, ends[1]),
        }

    # --- views

    def _system(self, kind: str) -> list[dict[str, Any]]:
        return [r for r in self.store.state.system if r["type"] == kind]

    def _views(self) -> dict[str, dict[str, Any]]:
        out: dict[str, dict[str, Any]] = {}
        for r in self.store.state.system:
            if r["type"] == "view.registered":
                out[r["name"]] = r
            elif r["type"] == "view.dropped":
                out.pop(r["name"], None)
        return out

    def register_view(
        self, name: str, key: str, indexes: Mapping[str, str] | None = None, where_field: str | None = None,
        where_value: Any = None, partitions: int = 1,
    ) -> None:
        """where_field with a where_value of None is no filter."""
        self._open()
        if not isinstance(name, str) or not name:
            raise InvalidArgumentError("a view has a name")
        span("partitions", partitions, PARTITIONS)
        where = None if where_field is None or where_value is None else [where_field, where_value]
        spec = {
            "type": "view.registered", "name": name, "key": key, "indexes": dict(indexes or {}), "where": where,
            "partitions": partitions,
        }
        old = self._views().get(name)
        if old is None or any(old.get(k) != v for k, v in spec.items()):
            with self.lock:
                self.store.record(spec)
                self.cache.pop(name, None)

    def register_runtime(self, name: str, fold: Callable[[DataFrame], DataFrame]) -> None:
        """A fold of one's own: log -> rows (key, value, position).  Its code is registered anew after each opening."""
        self._open()
        self.runtimes[name] = fold
        if name not in self._views():
            self.store.record(
                {"type": "view.registered", "name": name, "key": None, "indexes": {}, "where": None, "partitions": 1}
            )

    def projection(
        self, fold: Callable[[DataFrame], DataFrame], namespace: str | None = None, branch: str | None = None,
        until: int | None = None,
    ) -> DataFrame:
        """A fold of one's own over the log (of all branches, or of what one branch sees), stopped at a position."""
        streams = StreamSet(names=[namespace]) if namespace is not None else ReplayPlan().streams
        return fold(
            self.frame(ReplayPlan(branch and self.branch(branch).id, self.store.floor, until=until, streams=streams))
        )

    def deregister_view(self, name: str) -> bool:
        self._open()
        if name not in self._views():
            return False
        with self.lock:
            self.store.record({"type": "view.dropped", "name": name})
            self.cache.pop(name, None)
        return True

    def view(self, name: str, consistency: str = "head", position: int | None = None) -> View:
        """consistency: head (all that was appended), stale (the last state that was computed, if there is one), or wait
        (an error if the head is below `position`: nothing blocks)."""
        self._open()
        if name not in self._views():
            raise NotFoundError(f"view {name}")
        if consistency not in ("head", "stale", "wait") or (consistency == "wait") != (position is not None):
            raise InvalidArgumentError("consistency is head, stale, or wait with a position")
        if position is not None and position > self.store.head:
            raise InvalidArgumentError(f"position {position} is beyond the head {self.store.head}")
        return View(self, name, stale=consistency == "stale")

    def view_at(self, name: str, position: int) -> IndexedView:
        """A view as it was at a position."""
        check_window(self.store.floor, position, self.store.head, self.store.floor)
        return self.indexed(name, at=position)

    def _definition(self, name: str) -> ViewDefinition:
        spec = self._views().get(name)
        if spec is None:
            raise NotFoundError(f"view {name}")
        return ViewDefinition(spec["key"], spec["indexes"], tuple(spec["where"]) if spec["where"] else None)

    def _identity(self, name: str) -> str:
        return fingerprint(
            self.store.database_id, {k: v for k, v in self._views()[name].items() if k != "seq"},
            self.store.catalog.fingerprint("main"),
        )

    def indexed(self, name: str, partitions: Sequence[int] | None = None, at: int | None = None) -> IndexedView:
        """A view's rows at the head (or a position), from the newest snapshot that fits and what follows it."""
        self._open()
        spec = self._views().get(name)
        if spec is None:
            raise NotFoundError(f"view {name}")
        head = self.store.head if at is None else at
        stamp = (self._identity(name), head, self.store.state.generation, tuple(partitions or ()))
        if name in self.cache and self.cache[name][0] == stamp:
            return self.cache[name][1]
        if spec["key"] is None:
            if name not in self.runtimes:
                raise RuntimeMissingError(name)
            view = IndexedView.__new__(IndexedView)
            view.definition, view.rows = ViewDefinition("", {}), self.runtimes[name](
                self.frame(ReplayPlan("main", self.store.floor, until=head))
            )
        else:
            view = self._portable(name, spec, head, partitions, at is None)
        self.cache[name] = (stamp, view)
        return view

    def _portable(
        self, name: str, spec: dict[str, Any], head: int, partitions: Sequence[int] | None, latest: bool,
    ) -> IndexedView:
        definition = self._definition(name)
        wanted = None if not partitions else partitions[0] if len(partitions) == 1 else -1
        base = next((s for s in self._stored(name, head) if s["partition"] == wanted and self._sound(s)), None)
        start = base["cursor"] if base else 0
        streams = PartitionClass(spec["partitions"], builtins.list(partitions)) if partitions else ReplayPlan().streams
        rest = self.frame(
            ReplayPlan("main", max(start, self.store.floor) if base else start, until=head, streams=streams)
        )
        suffix = IndexedView(definition, rest)
        if base:
            at = f"{self.store.path}/{base['place']}"
            state = self.spark.read.parquet(f"{at}/state")
            if head - start <= MATERIALISE:
                indexes = {n: self.spark.read.parquet(f"{at}/index-{i}") for i, n in enumerate(definition.indexes)}
                return LayeredView(definition, state, indexes, suffix.rows if head > start else None)
            rows = state.select("key", "value", "position", *(f"ix_{n}" for n in definition.indexes))
            columns = rows.columns
            suffix.rows = last_writer_wins(
                rows.unionByName(suffix.rows.select(columns)), ["key"], columns[1:2] + columns[3:],
            ).select(columns)
        if latest and not partitions and head == self.store.durable_head and head - start > MATERIALISE:
            self.building.add(name)
            try:
                made = self._store(name, suffix, head, "derived", None)
            finally:
                self.building.discard(name)
            for n in self.store.files.names("derived"):
                if n != made["id"] and (m := self._meta("derived", n)) is not None and m["projection"] == name:
                    self.store.files.delete(f"derived/{n}")
            return self._portable(name, spec, head, partitions, False)
        return suffix

    def _store(
        self, projection: str, view: IndexedView, cursor: int, folder: str, partition: int | None,
    ) -> dict[str, Any]:
        """Writes a view's rows with its indexes; it is there when its description is."""
        made = new_id()
        store_state(view, f"{self.store.path}/{folder}/{made}")
        digest = state_digest(self.spark.read.parquet(f"{self.store.path}/{folder}/{made}/state"))
        meta = {
            "id": made, "projection": projection, "cursor": cursor, "created_at_unix_nanos": time.time_ns(),
            "state_bytes": self.store.files.bytes_of(f"{folder}/{made}/state"), "identity": self._identity(projection),
            "partition": partition, "digest": digest,
        }
        self.store.files.write_new(f"{folder}/{made}/meta.json", meta)
        self.sound[made] = True
        return meta

    def _meta(self, folder: str, made: str) -> dict[str, Any] | None:
        if not self.store.files.exists(f"{folder}/{made}/meta.json"):
            return None
        try:
            return {**self.store.files.read(f"{folder}/{made}/meta.json"), "place": f"{folder}/{made}"}
        except EngineError:
            return None

    def _stored(self, projection: str | None, head: int) -> list[dict[str, Any]]:
        """Snapshots and derived states that fit the view, newest cursor first."""
        return [m for m in self._described(("derived", "snapshots"), projection) if m["cursor"] <= head]

    def _sound(self, meta: dict[str, Any]) -> bool:
        """Whether a state's rows have the checksum that its description gives; looked at once.  A damaged one is passed
        over for an older one, or for the log."""
        if meta["id"] not in self.sound:
            try:
                rows = self.spark.read.parquet(f"{self.store.path}/{meta['place']}/state")
                self.sound[meta["id"]] = state_digest(rows) == meta.get("digest")
            except Exception:
                self.sound[meta["id"]] = False
        return self.sound[meta["id"]]

    def query_partitions(self, name: str, partitions: Sequence[int]) -> IndexedView:
        """Exactly the rows that the named hash classes of streams make."""
        return self.indexed(name, partitions)

    def rebuild_projection(self, projection: str) -> None:
        self._definition(projection)
        for s in self._snapshots(projection):
            self.delete_snapshot(s["id"])
        for s in self._described(("derived",), projection):
            self.store.files.delete(s["place"])
        self.failed.pop(projection, None)
        self.cache.pop(projection, None)

    # --- snapshots

    def _snapshots(self, projection: str | None = None) -> list[dict[str, Any]]:
        """Valid ones, newest cursor first."""
        return self._described(("snapshots",), projection)

    def _described(self, folders: Sequence[str], projection: str | None) -> list[dict[str, Any]]:
        """Stored states that fit: another definition, line of branches or database makes one invalid."""
        out, views = [], self._views()
        for folder in folders:
            for n in self.store.files.names(folder):
                meta = self._meta(folder, n)
                if meta is not None and meta["projection"] in views and projection in (
                    None, meta["projection"],
                ) and meta["identity"] == self._identity(
                    meta["projection"]
                ) and self.store.floor <= meta["cursor"] <= self.store.head:
                    out.append(meta)
        return sorted(out, key=lambda m: (-m["cursor"], -m["created_at_unix_nanos"]))

    @staticmethod
    def _shown(meta: dict[str, Any]) -> dict[str, Any]:
        return {k: v for k, v in meta.items() if k not in ("identity", "digest", "place")}

    def create_snapshot(self, projection: str, partition: int | None = None) -> dict[str, Any]:
        """The view's state at the durable head, of all streams or of one hash class; the newest two are kept."""
        with self.lock:
            self._definition(projection)
            self.store.commit()
            meta = self._store(
                projection, self.indexed(projection, None if partition is None else [partition]),
                self.store.durable_head, "snapshots", partition,
            )
            for old in [m for m in self._snapshots(projection) if m["partition"] == partition][SNAPSHOTS_KEPT:]:
                self.delete_snapshot(old["id"])
            self.cache.pop(projection, None)
            return self._shown(meta)

    def list_snapshots(self, projection: str) -> list[dict[str, Any]]:
        self._definition(projection)
        return [self._shown(m) for m in self._snapshots(projection)]

    def verify_snapshot(self, snapshot_id: str) -> dict[str, Any]:
        """Compares the snapshot with its checksum, and with the log folded up to its cursor: from the beginning, or, if the
        log begins later, from the newest sound older snapshot (without one, the checksum is all there is)."""
        found = next((m for m in self._snapshots() if m["id"] == snapshot_id), None)
        if found is None:
            raise NotFoundError(f"snapshot {snapshot_id}")
        self.sound.pop(snapshot_id, None)
        if not self._sound(found):
            raise ConflictError(f"snapshot {snapshot_id} is damaged")
        state = self.spark.read.parquet(f"{self.store.path}/{found['place']}/state").select("key", "value", "position")
        base = None
        if self.store.floor:
            older = (
                m for m in self._snapshots(found["projection"]) if m["cursor"] < found["cursor"]
                and m["partition"] == found["partition"] and self._sound(m)
            )
            base = next(older, None)
        if not self.store.floor or base:
            streams = ReplayPlan().streams if found["partition"] is None else PartitionClass(
                self._views()[found["projection"]]["partitions"], found["partition"],
            )
            log = self.frame(ReplayPlan("main", base["cursor"] if base else 0, until=found["cursor"], streams=streams))
            again = IndexedView(self._definition(found["projection"]), log).rows.select("key", "value", "position")
            if base:
                again = last_writer_wins(
                    again.union(
                        self.spark.read.parquet(
                            f"{self.store.path}/{base['place']}/state"
                        ).select("key", "value", "position")
                    ),
                    ["key"], ["value"],
                )
            if state.exceptAll(again).union(again.exceptAll(state)).limit(1).count():
                raise ConflictError(f"snapshot {snapshot_id} differs from the log")
        return self._shown(found)

    def delete_snapshot(self, snapshot_id: str) -> bool:
        there = self.store.files.exists(f"snapshots/{snapshot_id}")
        self.store.files.delete(f"snapshots/{snapshot_id}")
        self.cache.clear()
        return there

    def delete_all_derived_state(self) -> None:
        self.store.files.delete("snapshots")
        self.store.files.delete("derived")
        self.sound.clear()
        self.cache.clear()

    def _maybe_snapshot(self, receipt: Receipt) -> None:
        self.folded += receipt.last_position - receipt.first_position + 1
        if self.snapshot_policy.due(
            self.store.appended - self.snapped_bytes, self.folded, (time.monotonic() - self.snapped_at) * 1000,
        ):
            self.folded, self.snapped_bytes, self.snapped_at = 0, self.store.appended, time.monotonic()
            for n, spec in self._views().items():
                if spec["key"] is not None:
                    try:
                        self.create_snapshot(n)
                        self.failed.pop(n, None)
                    except Exception as e:  # a view that fails never fails an append
                        self.failed[n] = str(e)

    def projection_status(self, name: str) -> dict[str, Any]:
        if name not in self._views():
            raise NotFoundError(f"view {name}")
        last = next(iter(self._snapshots(name)), None)
        held = next((m["cursor"] for m in self._stored(name, self.store.head)), None)
        seen = self.cache[name][0][1] if name in self.cache else None
        cursor = max((c for c in (held, seen) if c is not None), default=None)
        if name in self.failed:
            status = "failed"
        elif name in self.building or cursor is None:
            status = "building"  # nothing has been computed yet: the first query does
        else:
            status = "ready" if cursor == self.store.head else "stale"
        return {
            "name": name, "status": status, "error": self.failed.get(name),
            "cursor": self.store.floor if cursor is None else cursor, "head": self.store.head,
            "snapshot_cursor": last and last["cursor"],
        }

    # --- feed

    def _consumer(self, consumer_id: str) -> int | None:
        return next((r["position"] for r in reversed(self._system("consumer")) if r["id"] == consumer_id), None)

    def _feed(
        self, namespace: str | None, branch: str | None, start: int | None, consumer_id: str | None,
        timeout: float | None, page_batches: int, page_bytes: int,
    ) -> Watch:
        if consumer_id is not None:
            name("consumer id", consumer_id, CONSUMER_ID_BYTES)
        at = start if start is not None else self._consumer(consumer_id) if consumer_id is not None else None
        if at is None:
            at = self.store.durable_head
        if at > self.store.durable_head or at < self.store.floor:
            wanted = FeedFilter([self.branch(branch).id] if branch else [])
            raise PositionUnavailableError(
                f"position {at} is unavailable: retained history starts at {self.store.floor}, head is {self.store.durable_head}",
                bootstrap=self._bootstrap(consumer_id, wanted) if at < self.store.floor and consumer_id else None,
            )
        return Watch(
            self, at, FeedFilter([self.branch(branch).id] if branch else [], [namespace] if namespace else []),
            namespace, consumer_id, timeout, page_batches, page_bytes,
        )

    def watch(
        self, namespace: str | None = None, branch: str | None = None, start: int | None = None,
        consumer_id: str | None = None, timeout: float | None = None, page_batches: int = 64, page_bytes: int = 1 << 20,
    ) -> Watch:
        """start None goes on from the consumer's checkpoint, or else waits for what comes."""
        self._open()
        return self._feed(namespace, branch, start, consumer_id, timeout, page_batches, page_bytes)

    def clear_consumer_checkpoint(self, consumer_id: str) -> None:
        self.store.record({"type": "consumer", "id": consumer_id, "position": None})

    def _bootstrap(self, consumer_id: str, wanted: FeedFilter) -> dict[str, Any] | None:
        for r in reversed(self._system("bootstrap.feed")):
            if r["consumer_id"] == consumer_id and r["floor"] == self.store.floor and r["branches"] == builtins.list(
                wanted.branches
            ):
                return {
                    "database_id": self.store.database_id, "generation": self.store.state.generation,
                    "resume_from": r["floor"], "streams": [], "event_types": [],
                    **{
                        k: r[k]
                        for k in (
                            "floor", "consumer_id", "checkpoint_id", "branches", "byte_length", "checksum", "codec",
                            "codec_version",
                        )
                    }
                }
        return None

    def register_feed_bootstrap(
        self, consumer_id: str, keep_from: int, checkpoint: bytes, branch: str | None = None, codec: str = "bytes",
        codec_version: int = 1,
    ) -> int:
        name("consumer id", consumer_id, CONSUMER_ID_BYTES)
        within("bootstrap bytes", len(checkpoint), BOOTSTRAP_BYTES)
        floor = R.effective_floor(self.store.segments(), keep_from, self.store.floor)
        branches = [self.branch(branch).id] if branch else []
        self.store.record(
            {
                "type": "bootstrap.feed", "consumer_id": consumer_id, "floor": floor, "data": checkpoint.hex(),
                "checkpoint_id": new_id(), "branches": branches, "byte_length": len(checkpoint),
                "checksum": checksum(checkpoint), "codec": codec, "codec_version": codec_version,
            }
        )
        return floor

    def register_consumer_bootstrap(self, consumer_id: str, keep_from: int, checkpoint: bytes) -> int:
        return self.register_feed_bootstrap(consumer_id, keep_from, checkpoint)

    def register_branch_bootstrap(self, branch: str, keep_from: int, checkpoint: bytes) -> int:
        within("bootstrap bytes", len(checkpoint), BOOTSTRAP_BYTES)
        floor = R.effective_floor(self.store.segments(), keep_from, self.store.floor)
        self.store.record(
            {"type": "bootstrap.branch", "branch": self.branch(branch).id, "floor": floor, "data": checkpoint.hex()}
        )
        return floor

    def branch_bootstrap(self, branch: str) -> bytes | None:
        at = self.branch(branch).id
        return next(
            (bytes.fromhex(r["data"]) for r in reversed(self._system("bootstrap.branch")) if r["branch"] == at), None,
        )

    def consumer_bootstrap(self, consumer_id: str) -> bytes | None:
        return next(
            (
                bytes.fromhex(r["data"]) for r in reversed(self._system("bootstrap.feed"))
                if r["consumer_id"] == consumer_id
            ),
            None,
        )

    def _checked(self, descriptor: Mapping[str, Any]) -> dict[str, Any]:
        wanted = FeedFilter(descriptor.get("branches", []))
        now = self._bootstrap(descriptor.get("consumer_id", ""), wanted)
        if now is None or any(now[k] != descriptor.get(k) for k in now):
            raise InvalidArgumentError("the bootstrap descriptor doesn't fit this log")
        return now

    def fetch_feed_bootstrap(self, descriptor: Mapping[str, Any], maximum_bytes: int) -> bytes:
        found = self._checked(descriptor)
        within("bootstrap bytes", found["byte_length"], maximum_bytes)
        return next(
            bytes.fromhex(r["data"]) for r in self._system("bootstrap.feed")
            if r["checkpoint_id"] == found["checkpoint_id"]
        )

    def resume_watch(
        self, descriptor: Mapping[str, Any], namespace: str | None = None, timeout: float | None = None,
        page_batches: int = 64, page_bytes: int = 1 << 20,
    ) -> Watch:
        found = self._checked(descriptor)
        branch = self.store.catalog.get(found["branches"][0]).name if found["branches"] else None
        return self._feed(
            namespace, branch, found["resume_from"], found["consumer_id"], timeout, page_batches, page_bytes,
        )

    # --- retention

    def retention_floor(self) -> int:
        return self.store.floor

    def plan_retention(self, keep_from: int) -> dict[str, Any]:
        self._open()
        check_window(self.store.floor, keep_from, self.store.head)
        floor = R.effective_floor(self.store.segments(), keep_from, self.store.floor)
        gone = [s for s in self.store.segments() if s.end <= floor]
        blockers: list[dict[str, Any]] = []
        if gone:
            anchor = any(a["floor"] == floor for a in self._system("anchor"))
            blockers += [] if anchor else [{"kind": "anchor_missing"}]
            covered = {r["branch"] for r in self._system("bootstrap.branch") if r["floor"] == floor}
            blockers += [
                {"kind": "branch", "branch": b.name, "fork_position": b.fork_position}
                for b in self.store.catalog.by_id.values() if b.fork_position is not None and b.fork_position < floor
                and b.id not in covered
            ]
            blockers += [
                {"kind": "projection", "projection": n} for n in self._views()
                if not any(s["cursor"] >= floor and s["partition"] is None for s in self._snapshots(n))
            ]
            helped = {r["consumer_id"] for r in self._system("bootstrap.feed") if r["floor"] == floor}
            blockers += [
                {"kind": "consumer", "consumer_id": c["consumer_id"], "position": c["position"]}
                for c in self._consumers(floor) if c["behind_effective_floor"] and c["consumer_id"] not in helped
            ]
            blockers += [
                {"kind": "open_handles", "readers": len(self.readers), "feeds": len(self.feeds)}
            ] if self.readers or self.feeds else []
        plan = {
            "plan_id": fingerprint(self.store.database_id, self.store.state.generation, floor, self.store.head)[:32],
            "requested_floor": keep_from, "effective_floor": floor, "current_floor": self.store.floor,
            "reclaimable_bytes": sum(s.bytes for s in gone),
            "reclaimable_segments": [{"base": s.base, "end": s.end, "bytes": s.bytes} for s in gone],
            "blockers": blockers,
        }
        self.plans[plan["plan_id"]] = plan
        return plan

    def plan_retention_policy(self, policy: str, value: int) -> dict[str, Any]:
        if policy not in R.POLICIES:
            raise InvalidArgumentError(f"policy must be one of {', '.join(R.POLICIES)}")
        if policy != "keep_newer_than" and value < 0:
            raise InvalidArgumentError("the value must not be negative")
        head, floor, met = self.store.head, self.store.floor, True
        if policy == "keep_from":
            chosen = value
        elif policy == "keep_latest_events":
            chosen = R.latest_events_floor(head, floor, value)
        elif policy == "keep_newer_than":
            chosen = R.newer_than_floor(self.store.log(), value, head)
        else:
            chosen, met = R.bytes_floor(self.store.segments(), value, floor)
        plan = self.plan_retention(chosen)
        return {
            "policy": policy, "value": value, "selected_floor": chosen, "target_satisfied": met,
            "explanation": f"{policy} {value} keeps positions from {plan['effective_floor']} on", "plan": plan,
        }

    def create_retention_anchor(self, keep_from: int) -> dict[str, Any]:
        """What is needed to read on when events below the floor are gone: stream revisions, and a snapshot of each view."""
        with self.lock:
            if self.readers or self.feeds:
                raise ConflictError("readers or feeds are open")
            self.store.commit()
            floor = R.effective_floor(self.store.segments(), keep_from, self.store.floor)
            for n, spec in self._views().items():
                if spec["key"] is not None:
                    self.create_snapshot(n)
            self.store.write_anchor()
            self.store.record({"type": "anchor", "floor": floor, "head": self.store.head})
            held = [r for r in self._system("bootstrap.branch") + self._system("bootstrap.feed") if r["floor"] == floor]
            size = self.store.files.bytes_of("anchor")
            return {
                "format_version": 1, "database_id": self.store.database_id, "floor": floor, "head": self.store.head,
                "bytes": size, "checksum": checksum(repr((floor, self.store.head, size)).encode()),
                "projection_checkpoints": len(self._views()), "branch_bootstraps": sum("branch" in r for r in held),
                "consumer_bootstraps": sum("consumer_id" in r for r in held),
                "bootstrap_bytes": sum(len(r["data"]) // 2 for r in held),
                "system_records": len(self.store.state.system),
            }

    def apply_retention(self, plan_id: str) -> dict[str, int]:
        with self.lock:
            old = self.plans.get(plan_id)
            now = self.plan_retention(old["requested_floor"]) if old else None
            if now is None or now["plan_id"] != plan_id:
                raise ConflictError("the plan is unknown, or the log has changed since")
            if now["blockers"]:
                raise ConflictError(f"the plan is blocked: {now['blockers']}")
            freed = self.store.raise_floor(now["effective_floor"])
            self.cache.clear()
            return {"generation": self.store.state.generation, "floor": self.store.floor, "reclaimed_bytes": freed}

    def _consumers(self, floor: int) -> list[dict[str, Any]]:
        last = {r["id"]: r["position"] for r in self._system("consumer")}
        helped = {r["consumer_id"] for r in self._system("bootstrap.feed")}
        return [
            {"consumer_id": c, "position": p, "behind_effective_floor": p < floor, "bootstrap_available": c in helped}
            for c, p in sorted(last.items()) if p is not None
        ]

    def retention_status(self, keep_from: int | None = None) -> dict[str, Any]:
        plan = self.plan_retention(self.store.floor if keep_from is None else keep_from)
        floor = plan["effective_floor"]
        return {
            "database_id": self.store.database_id, "generation": self.store.state.generation, "floor": self.store.floor,
            "durable_head": self.store.durable_head, "requested_floor": plan["requested_floor"],
            "effective_floor": floor, "anchor_ready": any(a["floor"] == floor for a in self._system("anchor")),
            "reclaimable_bytes": plan["reclaimable_bytes"], "reclaimable_segments": plan["reclaimable_segments"],
            "blockers": plan["blockers"], "open_readers": len(self.readers), "open_feeds": len(self.feeds),
            "consumers": self._consumers(floor), "cleanup": {"pending_files": 0},
        }


def open(
    path: str, commit_every_bytes: int | None = None, commit_every_count: int | None = None,
    commit_every_millis: int | None = None, snapshot_every_events: int | None = None,
    snapshot_every_bytes: int | None = None, snapshot_every_millis: int | None = None,
    spark: SparkSession | None = None,
) -> Database:
    session = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return Database(
        session, path, CommitPolicy(commit_every_bytes, commit_every_count, commit_every_millis),
        CommitPolicy(snapshot_every_bytes, snapshot_every_events, snapshot_every_millis),
    )


__all__ = ["Database", "Reader", "View", "Watch", "index_key_of", "open"]
