"""Imports of older logs: deterministic ids, resumable, verifiable; branches made from fork markers on request."""

from __future__ import annotations

import json
import re
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MigrationError, MigrationIncompleteError
from ..functions.ids import import_id, import_id_of
from ..operators.folds import prefix_count
from ..plans.catalog import ROOT, Branch, Catalog
from .store import LogStore

#: The key of a JSON fork marker: two underscores, the name of the log that made it, and this ending.
FORK = re.compile("__[A-Za-z0-9]+_fork__")
FORKED_FROM = "forked_from="


@dataclass(frozen=True)
class ImportReport:
    events: int
    skipped: int
    head: int


@dataclass(frozen=True)
class Fork:
    """A marker record: its stream leaves `parent` (a stream) at the source's offset `at`."""

    child: str
    parent: str
    at: int
    offset: int


def source_id(rows: DataFrame) -> str:
    """The same for the same rows, in whatever order and place."""
    kept = [c for c in ("offset", "namespace", "event_type", "body") if c in rows.columns]
    row = rows.select(
        F.xxhash64(*kept).alias("h"), F.xxhash64(F.lit(1), *kept).alias("g"),
    ).agg(F.count("*"), F.expr("bit_xor(h)"), F.expr("bit_xor(g)")).first()
    return "/".join(map(str, row))


def fork_of(body: str) -> tuple[str, int] | None:
    """(parent stream, offset) that a record's body names: a JSON fork marker, or a session's start with a config_hash
    forked_from=PARENT@OFFSET; None for other bodies."""
    try:
        value = json.loads(body)
    except ValueError:
        return None
    if not isinstance(value, dict):
        return None
    mark = next((v for k, v in value.items() if FORK.fullmatch(k)), None)
    if isinstance(mark, dict):
        parent, at = mark.get("parent"), mark.get("at")
        return (parent, at) if isinstance(parent, str) and type(at) is int and at >= 0 else None
    text = value.get("config_hash")
    if value.get("kind") == "SessionStarted" and isinstance(text, str) and text.startswith(FORKED_FROM):
        parent, found, at = text.removeprefix(FORKED_FROM).rpartition("@")
        return (parent, int(at)) if found and re.fullmatch("[0-9]+", at) else None
    return None


def forks_of(rows: DataFrame) -> list[Fork]:
    """All fork markers of the source by offset, checked.  As branches, they are as many as the driver's catalog holds."""
    named = F.col("body").rlike(f'"{FORK.pattern}"') | F.get_json_object(
        "body", "$.config_hash",
    ).startswith(FORKED_FROM)
    some = rows.where(named).select("offset", "namespace", "body").orderBy("offset")
    forks = [Fork(r["namespace"], *mark, r["offset"]) for r in some.toLocalIterator() if (mark := fork_of(r["body"]))]
    children, known = {f.child for f in forks}, set()
    for f in forks:
        if f.child in known:
            raise MigrationError(f"several fork markers for stream {f.child}")
        if f.at > f.offset:
            raise MigrationError(f"fork position {f.at} lies behind its marker at {f.offset}")
        if f.parent in children and f.parent not in known:
            raise MigrationError(f"the parent {f.parent} of stream {f.child} is itself forked later")
        known.add(f.child)
    return forks


def _typed(rows: DataFrame) -> DataFrame:
    return rows if "event_type" in rows.columns else rows.withColumn("event_type", F.lit("application.json"))


def _counted(rows: DataFrame, forks: list[Fork], marker: str) -> DataFrame:
    """rows with `position`, `gone` (marker records: fork markers, and events of the marker's type), and `before`."""
    spark = rows.sparkSession
    marks = spark.createDataFrame([(f.offset,) for f in forks], "position long")
    rows = rows.join(F.broadcast(marks.withColumn("fork", F.lit(True))), "position", "left")
    rows = rows.withColumn(
        "gone", F.coalesce(F.col("event_type") == marker, F.lit(False)) | F.col("fork").isNotNull(),
    ).drop("fork")
    return prefix_count(rows, F.col("gone"))


def branches_of(rows: DataFrame, forks: list[Fork], source: str, marker: str) -> list[Branch]:
    """A branch for each fork, its position less the number of dropped records before it; parents come first."""
    if not forks:
        return []
    spark, typed = rows.sparkSession, _typed(rows).select(F.col("offset").alias("position"), "event_type")
    gone = _counted(typed, forks, marker).where("gone").select(
        (2 * F.col("position") + 1).alias("position"), F.lit(None).cast("long").alias("fork"),
    )
    asked = spark.createDataFrame([(2 * f.at, f.offset) for f in forks], "position long, fork long")
    before = {
        r["fork"]: r["before"]
        for r in prefix_count(
            gone.union(asked), F.col("fork").isNull(),
        ).where("fork is not null").select("fork", "before").collect()
    }
    ids, canonical, out, now = {}, {}, [], time.time_ns()
    for f in forks:
        ids[f.child], canonical[f.child] = import_id(source, f.offset), canonical.get(f.parent, f.parent)
        metadata = {"legacy_stream": f.child.encode(), "session_stream": canonical[f.child].encode()}
        out.append(
            Branch(ids[f.child], f.child, ids.get(f.parent, ROOT), f.at - before[f.offset], now, "active", metadata)
        )
    Catalog(out)  # all checks, before anything is written
    return out


def source_rows(
    rows: DataFrame, marker: str | None = None, forks: list[Fork] | None = None, source: str | None = None,
) -> DataFrame:
    """rows (offset, namespace, body; event_type if there is one) with `ord`, the offset, and event ids made of the source
    and the offset.  With a marker: without fork markers and events of that type, `ord` less the number of these before
    it; a forked stream's events are on its branch, under the name of the stream that its line of forks began with."""
    source = source_id(rows) if source is None else source
    rows = _typed(rows).select(
        F.col("offset").alias("position"), F.col("namespace").alias("stream_name"), "event_type", "body",
        import_id_of(source, F.col("offset")).alias("event_id"),
    )
    if marker is None:
        return rows.withColumnRenamed("position", "ord").withColumn("branch_id", F.lit(ROOT))
    forks = forks_of(
        rows.select(F.col("position").alias("offset"), F.col("stream_name").alias("namespace"), "body")
    ) if forks is None else forks
    canonical: dict[str, str] = {}
    for f in forks:
        canonical[f.child] = canonical.get(f.parent, f.parent)
    moved = rows.sparkSession.createDataFrame(
        [(f.child, import_id(source, f.offset), canonical[f.child]) for f in forks],
        "stream_name string, branch string, canonical string",
    )
    kept = _counted(rows, forks, marker).where("not gone").join(F.broadcast(moved), "stream_name", "left")
    return kept.select(
        (F.col("position") - F.col("before")).alias("ord"), F.coalesce("canonical", "stream_name").alias("stream_name"),
        "event_type", "body", "event_id", F.coalesce("branch", F.lit(ROOT)).alias("branch_id"),
    )


def run(store: LogStore, rows: DataFrame, marker: str | None = None) -> ImportReport:
    """Imports into an empty log, in one entry: the events, the branches, and the record that the import is done.  A run that
    was broken off left nothing, and is run again; events without that record are refused."""
    if store.head:
        done = [r for r in store.state.system if r["type"] == "imported"]
        if not done:
            raise MigrationIncompleteError("the destination holds events that no import has finished")
        return ImportReport(done[-1]["events"], done[-1]["skipped"], store.head)
    total, source = rows.count(), source_id(rows)
    forks = [] if marker is None else forks_of(rows)
    branches = [] if marker is None else branches_of(rows, forks, source, marker)
    made = [
        {"type": "branch.created", "branch": {**asdict(b), "metadata": {k: v.hex() for k, v in b.metadata.items()}}}
        for b in branches
    ]
    finish = lambda events: [*made, {"type": "imported", "events": events, "skipped": total - events}]
    head = store.append_frame(
        source_rows(rows, marker, forks, source), records=finish, expected=total if marker is None else None,
    )
    return ImportReport(head, total - head, head)


def verify(store: LogStore, rows: DataFrame, marker: str | None = None) -> None:
    """Compares every imported event, its branch and id, and every branch with the source."""
    source = source_id(rows)
    forks = [] if marker is None else forks_of(rows)
    columns = ["position", "branch_id", "stream_name", "event_type", "body", "event_id"]
    want = source_rows(rows, marker, forks, source).withColumnRenamed("ord", "position").select(columns)
    got = store.log().select(columns)
    off = want.exceptAll(got).union(got.exceptAll(want)).limit(1).count()
    if off:
        raise MigrationError("the import differs from its source")
    for b in [] if marker is None else branches_of(rows, forks, source, marker):
        there = store.catalog.by_id.get(b.id)
        if there is None or (
            there.name, there.parent, there.fork_position, there.metadata,
        ) != (b.name, b.parent, b.fork_position, b.metadata):
            raise MigrationError(f"branch {b.name} differs from its marker")
