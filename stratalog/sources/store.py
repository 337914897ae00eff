"""The log store: Parquet files that become part of the log when a manifest entry names them.

A commit writes one sorted file of the buffered events, then the manifest entry; files that no entry names were left by
a writer that died and are invisible, so a batch is there whole or not at all.  Every 64th entry is a checkpoint of all
before it.  Branches, views and consumers are system records inside the entries.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import (
    BatchIdConflictError, BranchArchivedError, CodecError, EventIdConflictError, IdempotencyConflictError,
    InvalidArgumentError, IoError, ManifestError, NotBatchBoundaryError, OffsetBeyondHeadError,
    PositionUnavailableError, RevisionConflictError, UnsupportedFormatError,
)
from ..functions.ids import content_column, content_of, fingerprint, new_id, parse_id, stream_id, stream_id_of
from ..limits import (
    BATCH_BYTES, BATCH_EVENTS, EVENT_TYPE_BYTES, IDEMPOTENCY_KEY_BYTES, METADATA_ENTRIES, METADATA_KEY_BYTES,
    METADATA_VALUE_BYTES, PAYLOAD_BYTES, RESERVED_PREFIX, STREAM_NAME_BYTES, name, within,
)
from ..operators.retention import Segment
from ..plans.catalog import Branch, Catalog
from .files import Files

FORMAT = 1
CHECKPOINT_EVERY = 64
#: Bytes of a file that compact() aims at.
FILE_BYTES = 128 << 20
#: So many small files at the log's end are joined by the commit that finds them.
ROLL_FILES = 256
LOG = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("position", T.LongType()), ("ts_nanos", T.LongType()), ("event_id", T.StringType()),
            ("database_id", T.StringType()), ("branch_id", T.StringType()), ("stream_id", T.StringType()),
            ("stream_name", T.StringType()), ("stream_revision", T.LongType()), ("batch_id", T.StringType()),
            ("batch_index", T.LongType()), ("event_type", T.StringType()), ("schema_version", T.LongType()),
            ("codec", T.StringType()), ("metadata", T.MapType(T.StringType(), T.BinaryType())),
            ("payload", T.BinaryType()), ("body", T.StringType()), ("idempotency_key", T.StringType()),
            ("request", T.StringType()), ("content", T.StringType()),
        )
    ]
)


@dataclass(frozen=True)
class Receipt:
    batch_id: str
    first_position: int
    last_position: int
    stream_id: str
    previous_revision: int | None
    current_revision: int
    durability: str


@dataclass
class CommitPolicy:
    """Commit when any threshold is met; time is noticed at the next append."""

    every_bytes: int | None = None
    every_count: int | None = None
    every_millis: int | None = None

    def due(self, held_bytes: int, count: int, millis: float) -> bool:
        return any(
            limit is not None and now >= limit
            for limit, now in ((self.every_bytes, held_bytes), (self.every_count, count), (self.every_millis, millis))
        )


@dataclass
class State:
    """What the manifest entries add up to."""

    database_id: str = ""
    head: int = 0
    floor: int = 0
    generation: int = 0
    files: list[dict] = field(default_factory=list)
    system: list[dict] = field(default_factory=list)

    def take(self, entry: dict) -> None:
        if entry.get("format") != FORMAT:
            raise UnsupportedFormatError(f"manifest format {entry.get('format')}, this build reads {FORMAT}")
        if "state" in entry:
            for k, v in entry["state"].items():
                setattr(self, k, v)
            return
        self.database_id = entry.get("database_id", self.database_id)
        for f in entry.get("files", ()):
            if f["base"] != self.head:
                raise ManifestError(f"a file begins at {f['base']}, the head is {self.head}")
            self.files.append(f)
            self.head = f["end"]
        if "swap" in entry:
            gone = set(entry["swap"]["old"])
            self.files = sorted(
                [f for f in self.files if f["path"] not in gone] + entry["swap"]["new"], key=lambda f: f["base"],
            )
        self.system += [{"seq": len(self.system) + i, **r} for i, r in enumerate(entry.get("system", ()))]
        if "floor" in entry:
            self.floor, self.generation = entry["floor"], entry["generation"]
            self.files = [f for f in self.files if f["base"] >= self.floor]


class LogStore:
    def __init__(self, spark: SparkSession, path: str, policy: CommitPolicy | None = None, read_only: bool = False):
        self.spark, self.path, self.policy = spark, path.rstrip("/"), policy or CommitPolicy()
        self.files, self.read_only = Files(spark, self.path), read_only
        if read_only and not self.files.exists("manifest"):
            raise InvalidArgumentError(f"there is no log in {self.path}")
        if not read_only:
            self.files.mkdirs()
            self.files.lock()
        try:
            self.state, self.entry = State(), 0
            for n in () if read_only else ("manifest", "data"):
                self.files.mkdirs(n)
            self._load()
            if not self.state.database_id:
                self._publish({"database_id": new_id()})
        except BaseException:
            self.files.unlock()
            raise
        self.buffer: list[dict] = []
        self.held = 0
        #: Payload bytes appended since the log was opened.
        self.appended = 0
        self.since = time.monotonic()
        self.revisions: dict[tuple[str, str], int | None] = {}

    # --- manifest

    def _load(self) -> None:
        names = [n for n in self.files.names("manifest") if n.endswith(".json")]
        numbers = [int(n.removesuffix(".json")) for n in names]
        start = max((n for n in numbers if n % CHECKPOINT_EVERY == 0), default=0)
        for n in numbers:
            if n >= start:
                self.state.take(self.files.read(f"manifest/{n:012d}.json"))
                self.entry = n + 1
        catalog = Catalog()
        for r in self.state.system:
            self._fold(catalog, r)
        self.catalog = catalog

    @staticmethod
    def _fold(catalog: Catalog, record: dict) -> None:
        if record["type"] == "branch.created":
            b = dict(record["branch"])
            b["metadata"] = {k: bytes.fromhex(v) for k, v in b.get("metadata", {}).items()}
            catalog.add(Branch(**b))
        elif record["type"] == "branch.archived":
            catalog.archive(record["id"])

    def _publish(self, entry: dict) -> None:
        self.files.renew()
        entry = {"format": FORMAT, **entry}
        if self.entry and self.entry % CHECKPOINT_EVERY == 0:
            self.state.take(entry)
            self.files.write_new(f"manifest/{self.entry:012d}.json", {"format": FORMAT, "state": asdict(self.state)})
        else:
            self.files.write_new(f"manifest/{self.entry:012d}.json", entry)
            self.state.take(entry)
        self.entry += 1

    def record(self, *records: dict) -> None:
        """Durable system records.  Whatever is buffered is committed first, as they may name its positions."""
        self.commit()
        self._publish({"system": list(records)})
        self._folded(list(records))

    def refresh(self) -> None:
        """For a reader: takes what a writer has published since."""
        self.state, self.entry = State(), 0
        self._load()

    # --- reads

    @property
    def database_id(self) -> str:
        return self.state.database_id

    @property
    def head(self) -> int:
        return self.state.head + len(self.buffer)

    @property
    def durable_head(self) -> int:
        return self.state.head

    @property
    def floor(self) -> int:
        return self.state.floor

    def log(self, durable_only: bool = False, start: int = 0, until: int | None = None) -> DataFrame:
        """Committed and buffered events; files outside [start, until) aren't opened."""
        paths = [
            f"{self.path}/{f['path']}" for f in self.state.files if f["end"] > start
            and (until is None or f["base"] < until)
        ]
        out = self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)
        if self.buffer and not durable_only:
            out = out.unionByName(
                self.spark.createDataFrame([tuple(r[c] for c in LOG.names) for r in self.buffer], LOG)
            )
        return out

    def window_end(self, start: int, until: int, events: int) -> int:
        """The end of the first whole files from `start` on that hold so many positions; files hold whole batches."""
        for f in self.state.files:
            if f["end"] >= start + events:
                return min(f["end"], until)
        return until

    def segments(self) -> list[Segment]:
        return [Segment(f["base"], f["end"], f["bytes"], f["path"]) for f in self.state.files]

    def revision(self, branch: str, stream: str) -> int | None:
        """Of a stream on a branch itself; streams start anew on each branch."""
        key = (branch, stream)
        if key not in self.revisions:
            mine = (F.col("branch_id") == branch) & (F.col("stream_name") == stream)
            found = [self.log(durable_only=True).where(mine).agg(F.max("stream_revision")).first()[0]]
            if self._anchor_path():
                found.append(self._anchor().where(mine).agg(F.max("__rev")).first()[0])
            self.revisions[key] = max((x for x in found if x is not None), default=None)
        return self.revisions[key]

    def is_batch_boundary(self, at: int) -> bool:
        if at in (0, self.head) or at == self.floor:
            return True
        if at > self.head:
            return False
        ids = [r["batch_id"] for r in self.buffer if r["position"] in (at - 1, at)]
        if len(ids) < 2:
            ids += [
                r[0]
                for r in self.log(True, at - 1, at + 1).where(
                    F.col("position").isin(at - 1, at)
                ).select("batch_id").collect()
            ]
        return len(set(ids)) == 2

    # --- appends

    def append(
        self, branch: str, stream: str, events: list[dict], expected: str | int | None = None,
        idempotency_key: str | None = None, batch_id: str | None = None, durability: str = "buffered",
    ) -> Receipt:
        """One atomic batch: all checks come before anything is written."""
        if durability not in ("buffered", "flush", "sync"):
            raise InvalidArgumentError("durability must be buffered, flush or sync")
        name("stream name", stream, STREAM_NAME_BYTES)
        if not events:
            raise InvalidArgumentError("a batch has one event at least")
        within("batch", len(events), BATCH_EVENTS)
        if idempotency_key is not None:
            name("idempotency key", idempotency_key, IDEMPOTENCY_KEY_BYTES)
        rows = [self._row(e) for e in events]
        within("batch bytes", sum(len(r["payload"]) for r in rows), BATCH_BYTES)
        given = [r["event_id"] for r in rows if r["event_id"]]
        if len(set(given)) != len(given):
            raise EventIdConflictError("an event id occurs twice in the batch")
        if self.catalog.get(branch).status == "archived":
            raise BranchArchivedError(branch)
        request = fingerprint(branch, stream, expected, batch_id, [(r["event_id"], r["content"]) for r in rows])
        if idempotency_key is not None and (
            old := self._find(
                (F.col("branch_id") == branch) & (F.col("idempotency_key") == idempotency_key),
                lambda r: r["branch_id"] == branch and r["idempotency_key"] == idempotency_key,
            )
        ):
            if old[0]["request"] != request:
                raise IdempotencyConflictError(idempotency_key)
            return self._receipt(old[0]["batch_id"])
        previous = self.revision(branch, stream)
        wanted = expected in (None, "any") or (expected == "no_stream" and previous is None) or (
            not isinstance(expected, str) and expected == previous
        )
        if not wanted:
            raise RevisionConflictError(f"expected {expected}, actual {previous}")
        if given and (old := self._find(F.col("event_id").isin(given), lambda r: r["event_id"] in set(given))):
            known = {r["event_id"]: r for r in old}
            if len(given) < len(rows) or len(known) < len(given) or len({r["batch_id"] for r in old}) > 1 or any(
                known[r["event_id"]]["content"] != r["content"] for r in rows
            ):
                raise EventIdConflictError("event ids exist with other content or in other batches")
            return self._receipt(old[0]["batch_id"])
        if batch_id is not None and self._find(
            F.col("batch_id") == parse_id(batch_id), lambda r: r["batch_id"] == batch_id,
        ):
            raise BatchIdConflictError(batch_id)
        batch, now, first = batch_id or new_id(), time.time_ns() // 1_000_000 * 1_000_000, self.head
        stream_id = stream_id_of(self.database_id, branch, stream)
        for i, r in enumerate(rows):
            r |= {
                "position": first + i, "ts_nanos": now, "event_id": r["event_id"] or new_id(),
                "database_id": self.database_id, "branch_id": branch, "stream_id": stream_id, "stream_name": stream,
                "stream_revision": (-1 if previous is None else previous) + 1 + i, "batch_id": batch, "batch_index": i,
                "idempotency_key": idempotency_key, "request": request,
            }
            self.held += len(r["payload"])
            self.appended += len(r["payload"])
        self.buffer += rows
        self.revisions[branch, stream] = rows[-1]["stream_revision"]
        if durability != "buffered" or self.policy.due(
            self.held, len(self.buffer), (time.monotonic() - self.since) * 1000,
        ):
            self.commit()
        done = {"buffered": "buffered", "flush": "flushed", "sync": "synced"}[durability]
        return Receipt(batch, first, first + len(rows) - 1, stream_id, previous, rows[-1]["stream_revision"], done)

    @staticmethod
    def _row(event: dict) -> dict:
        codec, kind, version = event.get("codec", "json"), event.get(
            "event_type", "application.json",
        ), event.get("schema_version", 1)
        name("event type", kind, EVENT_TYPE_BYTES)
        metadata = {k: v.encode() if isinstance(v, str) else bytes(v) for k, v in (event.get("metadata") or {}).items()}
        within("metadata entries", len(metadata), METADATA_ENTRIES)
        for k, v in metadata.items():
            if k.startswith(RESERVED_PREFIX):
                raise InvalidArgumentError(f"metadata keys that begin with {RESERVED_PREFIX} are reserved")
            within("metadata key bytes", len(k.encode()), METADATA_KEY_BYTES)
            within("metadata value bytes", len(v), METADATA_VALUE_BYTES)
        if codec == "json":
            try:
                body = json.dumps(
                    event.get("body"), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False,
                )
            except (TypeError, ValueError) as e:
                raise CodecError(str(e)) from None
            payload = body.encode()
        elif codec == "bytes":
            body, payload = None, bytes(event["body"])
        else:
            raise CodecError(f"codec {codec}")
        within("payload bytes", len(payload), PAYLOAD_BYTES)
        given = event.get("event_id")
        content = content_of(kind, version, codec, metadata, payload)
        return {
            "event_id": None if given is None else parse_id(given), "event_type": kind, "schema_version": version,
            "codec": codec, "metadata": metadata, "payload": bytearray(payload), "body": body, "content": content,
        }

    def _find(self, column, test) -> list:
        """Matching events among the buffered ones, else among the committed ones (by a pushed-down filter)."""
        return [r for r in self.buffer if test(r)] or self.log(durable_only=True).where(column).select(
            "event_id", "batch_id", "request", "content",
        ).collect()

    def _receipt(self, batch: str) -> Receipt:
        """The receipt of an earlier batch, rebuilt from the log."""
        rows = [r for r in self.buffer if r["batch_id"] == batch]
        if rows:
            first, last = rows[0], rows[-1]
        else:
            mine = self.log(durable_only=True).where(F.col("batch_id") == batch).select(
                "position", "stream_id", "stream_revision",
            )
            first, last = mine.orderBy("position").first(), mine.orderBy(F.desc("position")).first()
        before = first["stream_revision"] - 1
        return Receipt(
            batch, first["position"], last["position"], first["stream_id"], None if before < 0 else before,
            last["stream_revision"], "buffered",
        )

    def commit(self) -> int:
        """Makes the buffered events durable; the durable head."""
        if self.read_only:
            raise InvalidArgumentError("the log is open for reading")
        if self.buffer:
            base, end = self.durable_head, self.head
            path = f"data/{base:020d}-{new_id()[:8]}"
            rows = self.spark.createDataFrame(
                [tuple(r[c] for c in LOG.names) for r in self.buffer], LOG,
            ).coalesce(1).sortWithinPartitions("position")
            self._write(rows, path)
            self._publish({"files": [{"path": path, "base": base, "end": end, "bytes": self.files.bytes_of(path)}]})
            self.buffer, self.held = [], 0
            small = 0
            for f in reversed(self.state.files):
                if f["bytes"] >= FILE_BYTES // 4:
                    break
                small += 1
            if small >= ROLL_FILES:
                self.compact(keep=True)  # a lazy read may still name the old files; vacuum() deletes them
        self.since = time.monotonic()
        return self.durable_head

    def _write(self, rows: DataFrame, path: str) -> None:
        writer = rows.write.option("parquet.bloom.filter.enabled#event_id", "true").option(
            "parquet.bloom.filter.enabled#stream_name", "true",
        ).option(
            "parquet.bloom.filter.enabled#idempotency_key", "true",
        ).option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(f"{self.path}/{path}")

    def append_frame(
        self, rows: DataFrame, branch: str = "main", records: Callable[[int], list[dict]] | None = None,
        expected: int | None = None,
    ) -> int:
        """Bulk load: rows (stream_name, event_type, body JSON text, and an `ord` to order them by) become one commit.

        The rows are written once, in ranges of `ord`; their places in those files are their positions, so nothing that is
        planned twice can number them differently.  Nothing is published unless there are as many rows as the source has
        (`expected`, if it is known) and every position occurs once.  Returns the head.  Rows may bring a branch_id each
        (else all are on `branch`), and an event_id, which is their batch's id, too; other rows come in batches of
        BATCH_EVENTS.  `records` makes system records of the number of events, published in the same entry.
        """
        from ..operators.folds import running_number

        self.commit()
        base, tag = self.head, new_id()[:8]
        if "branch_id" not in rows.columns:
            rows = rows.withColumn("branch_id", F.lit(branch))
        own = "event_id" in rows.columns
        rows = rows.select("ord", "branch_id", "stream_name", "event_type", "body", *(["event_id"] if own else []))
        aside, path = f"staging/{tag}", f"data/{base:020d}-{tag}"
        rows.repartitionByRange("ord").sortWithinPartitions("ord").write.parquet(f"{self.path}/{aside}")
        there = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{aside}")
        parts = self._parts(there.select("ord", F.col("_metadata.file_name").alias("file")), "ord")
        starts, count, last = [], 0, None
        for file, low, high, n in parts:
            if last is not None and low < last:
                raise IoError("the ranges of a bulk load overlap")
            starts.append((file, base + count, len(starts)))
            count, last = count + n, high
        if count != (rows.count() if expected is None else expected):
            raise IoError(f"a bulk load wrote {count} rows, its source has another number")
        system = records(count) if records else []
        if not count:
            self.files.delete(aside)
            if system:
                self._publish({"system": system})
                self._folded(system)
            return self.head
        offsets = self.spark.createDataFrame(starts, "__file string, __base long, __place int")
        placed = there.select(
            "*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"),
        ).join(F.broadcast(offsets), "__file")
        placed = placed.withColumn("position", F.col("__base") + F.col("__row")).drop(
            "ord", "__file", "__base", "__row", "__place",
        )
        known = self.log(durable_only=True).groupBy("branch_id", "stream_name").agg(
            F.max("stream_revision").alias("__rev")
        )
        if self._anchor_path():
            known = known.union(self._anchor()).groupBy("branch_id", "stream_name").agg(F.max("__rev").alias("__rev"))
        numbered = running_number(placed, ["branch_id", "stream_name"])
        if base:
            numbered = numbered.join(known, ["branch_id", "stream_name"], "left")
        else:
            numbered = numbered.withColumn("__rev", F.lit(None).cast("long"))
        numbered = numbered.withColumn("stream_revision", F.coalesce("__rev", F.lit(-1)) + F.col("number") + 1)
        now, at = time.time_ns() // 1_000_000 * 1_000_000, F.col("position") - base
        hashed = lambda *c: F.substring(F.sha2(F.concat_ws("/", F.lit(new), *c), 256), 1, 32)
        new = new_id()
        made = {
            "ts_nanos": F.lit(now), "event_id": F.col("event_id") if own else hashed("position"),
            "database_id": F.lit(self.database_id),
            "stream_id": stream_id(F.lit(self.database_id), F.col("branch_id"), F.col("stream_name")),
            "batch_id": F.col("event_id") if own else hashed(F.lit("batch"), F.floor(at / BATCH_EVENTS)),
            "batch_index": F.lit(0) if own else F.pmod(at, F.lit(BATCH_EVENTS)), "schema_version": F.lit(1),
            "codec": F.lit("json"), "metadata": F.create_map().cast("map<string,binary>"),
            "payload": F.col("body").cast("binary"), "idempotency_key": F.lit(None), "request": F.lit(None),
        }
        # each file holds whole batches
        per = -(-count // (len(starts) * BATCH_EVENTS)) * BATCH_EVENTS
        numbered = numbered.withColumn("__place", F.floor(at / per).cast("int"))
        full = numbered.withColumns(made).withColumn("content", content_column()).select(
            "__place", *(F.col(f.name).cast(f.dataType) for f in LOG)
        )
        self._write(
            full.repartitionById(len(starts), F.col("__place")).drop("__place").sortWithinPartitions("position"), path,
        )
        written = self.spark.read.schema(LOG).parquet(f"{self.path}/{path}").select(
            "position", F.col("_metadata.file_name").alias("file"),
        )
        digest = lambda c: F.bit_xor(F.xxhash64(c))
        got = written.agg(F.count("*"), F.min("position"), F.max("position"), digest("position")).first()
        want = self.spark.range(base, base + count).agg(digest("id")).first()[0]
        if tuple(got) != (count, base, base + count - 1, want):
            raise IoError(
                f"a bulk load of {count} rows wrote {got[0]} positions from {got[1]} to {got[2]}, not each once"
            )
        files, at = [], base
        for file, low, high, n in self._parts(written, "position"):
            if low != at or high != at + n - 1:
                raise IoError("the files of a bulk load aren't in the order of their positions")
            files.append(
                {"path": f"{path}/{file}", "base": low, "end": high + 1, "bytes": self.files.bytes_of(f"{path}/{file}")}
            )
            at = high + 1
        self._publish({"files": files, **({"system": system} if system else {})})
        self._folded(system)
        self.files.delete(aside)
        self.revisions.clear()
        return self.head

    @staticmethod
    def _parts(rows: DataFrame, order: str) -> list[tuple]:
        """(file, least, greatest, number of rows) of each part file, in order: one row a file."""
        found = rows.groupBy("file").agg(
            F.min(order).alias("low"), F.max(order).alias("high"), F.count("*").alias("n"),
        ).collect()
        return sorted(
            ((r["file"], r["low"], r["high"], r["n"]) for r in found),
            key=lambda x: [int(n) for n in re.match(r"part-(\d+).*?c(\d+)", x[0]).groups()],
        )

    def _folded(self, records: list[dict]) -> None:
        for r in records:
            self._fold(self.catalog, r)

    def _anchor(self) -> DataFrame:
        """branch_id, stream_name, __rev of events that retention has deleted."""
        return self.spark.read.parquet(f"{self.path}/{self._anchor_path()}").select(
            "branch_id", "stream_name", F.col("revision").alias("__rev"),
        )

    # --- branches, retention, upkeep

    def fork(self, parent: str, at: int, branch_name: str, metadata: dict[str, bytes] | None = None) -> Branch:
        self.catalog.get(parent)
        if at > self.head:
            raise OffsetBeyondHeadError(f"offset {at} beyond head {self.head}")
        if at < self.floor:
            raise PositionUnavailableError(f"position {at} is unavailable: retained history starts at {self.floor}")
        if not self.is_batch_boundary(at):
            raise NotBatchBoundaryError(f"position {at} is not a committed batch boundary")
        branch = Branch(new_id(), branch_name, parent, at, time.time_ns(), "active", dict(metadata or {}))
        Catalog([b for b in self.catalog.by_id.values() if b.parent is not None]).add(branch)  # all checks, before the record
        self.record(
            {
                "type": "branch.created",
                "branch": {**asdict(branch), "metadata": {k: v.hex() for k, v in branch.metadata.items()}},
            }
        )
        return self.catalog.get(branch.id)

    def archive(self, branch: str) -> Branch:
        if self.catalog.get(branch).status == "archived":
            return self.catalog.get(branch)
        if self.catalog.get(branch).parent is None:
            raise InvalidArgumentError("the root branch can't be archived")
        self.record({"type": "branch.archived", "id": branch})
        return self.catalog.get(branch)

    def raise_floor(self, floor: int) -> int:
        """Publishes a floor, then deletes the files below it; the bytes freed.  Stream revisions are kept in an anchor."""
        gone = [f for f in self.state.files if f["end"] <= floor]
        self._publish({"floor": floor, "generation": self.state.generation + 1})
        for f in gone:
            self.files.delete(f["path"])
        return sum(f["bytes"] for f in gone)

    def _anchor_path(self) -> str | None:
        """The newest whole anchor: one that a writer left half-way has no _SUCCESS and is passed over."""
        whole = [n for n in self.files.names("anchor") if self.files.exists(f"anchor/{n}/_SUCCESS")]
        return f"anchor/{whole[-1]}" if whole else None

    def write_anchor(self) -> None:
        """The last revision of every stream, so that revisions go on when old events are gone.  Each anchor is a folder of
        its own, named in rising order; the one before is deleted only when the new one is whole."""
        rows = self.log().groupBy("branch_id", "stream_name").agg(F.max("stream_revision").alias("__rev"))
        before = self.files.names("anchor")
        if self._anchor_path():
            rows = rows.union(self._anchor()).groupBy("branch_id", "stream_name").agg(F.max("__rev").alias("__rev"))
        made = f"anchor/{self.entry:012d}-{time.time_ns():020d}"
        rows.withColumnRenamed("__rev", "revision").write.option(
            "mapreduce.fileoutputcommitter.marksuccessfuljobs", "true",
        ).parquet(f"{self.path}/{made}")
        for old in before:
            self.files.delete(f"anchor/{old}")

    def compact(self, target: int = FILE_BYTES, keep: bool = False) -> int:
        """Joins neighbouring small files, up to `target` bytes a new file (one task each); the number of files that went.
        With `keep`, the old files stay on disk until vacuum()."""
        if not keep:
            self.commit()
        groups: list[list[dict]] = [[]]
        for f in self.state.files:
            if groups[-1] and sum(x["bytes"] for x in groups[-1]) + f["bytes"] > target:
                groups.append([])
            groups[-1].append(f)
        old = [g for g in groups if len(g) > 1]
        new = []
        for g in old:
            path = f"data/{g[0]['base']:020d}-{new_id()[:8]}"
            self._write(
                self.spark.read.schema(LOG).parquet(
                    *(f"{self.path}/{f['path']}" for f in g)
                ).repartitionByRange(1, "position").sortWithinPartitions("position"),
                path,
            )
            new.append({"path": path, "base": g[0]["base"], "end": g[-1]["end"], "bytes": self.files.bytes_of(path)})
        if new:
            self._publish({"swap": {"old": [f["path"] for g in old for f in g], "new": new}})
            for f in [] if keep else [f for g in old for f in g]:
                self.files.delete(f["path"])
        return sum(map(len, old)) - len(new)

    def verify(self) -> dict[str, int]:
        """Events, and faults in the whole log: positions that are missing or repeated or other than the manifest says, batches
        with gaps, streams with gaps."""
        log = self.log(durable_only=True)
        positions = log.agg(
            F.count("*").alias("n"), F.count_distinct("position").alias("d"), F.min("position").alias("lo"),
            F.max("position").alias("hi"),
        ).first()
        gaps = lambda keys, order, first: log.groupBy(*keys).agg(
            F.count("*").alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi"),
        ).where(
            (F.col("hi") - F.col("lo") + 1 != F.col("n"))
            | (F.col("lo") != first if first is not None else F.lit(False))
        ).count()
        there = positions["n"] or 0
        absent = 0 if not there else positions["hi"] - positions["lo"] + 1 - positions["d"]
        begin = self.state.files[0]["base"] if self.state.files else self.durable_head
        wrong = abs(self.durable_head - begin - there) + (
            there > 0 and (positions["lo"], positions["hi"]) != (begin, self.durable_head - 1)
        )
        return {
            "events": there, "positions": max(absent + there - positions["d"], wrong),
            "batches": gaps(["batch_id"], "batch_index", 0),
            "streams": gaps(["branch_id", "stream_name"], "stream_revision", None if self.floor else 0),
        }

    def vacuum(self) -> list[str]:
        """Deletes data that no manifest entry names (left by writers that died)."""
        named = {f["path"] for f in self.state.files} | {"/".join(f["path"].split("/")[:2]) for f in self.state.files}
        orphans = [
            f"{place}/{n}" for place in ("data", "staging") for n in self.files.names(place)
            if f"{place}/{n}" not in named
        ]
        # files of a bulk load that were joined with others
        for folder in sorted({f["path"].rpartition("/")[0] for f in self.state.files if f["path"].count("/") > 1}):
            orphans += [
                f"{folder}/{n}" for n in self.files.names(folder) if n.startswith("part-")
                and f"{folder}/{n}" not in named
            ]
        for o in orphans:
            self.files.delete(o)
        return orphans

    def close(self) -> None:
        if not self.read_only:
            self.commit()
            self.files.unlock()


def checksum(data: bytes) -> int:
    return int.from_bytes(sha256(data).digest()[:4], "big")
