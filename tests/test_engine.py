"""The engine: appends and their conflicts, reads, views, feed, snapshots, retention, crashes."""

import os
import random
import signal
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

import stratalog.engine as engine
from stratalog import errors as E
from stratalog.sources.store import LogStore

HEX = "0123456789abcdef" * 2


@pytest.fixture
def db(spark, tmp_path):
    d = engine.open(str(tmp_path / "log"), spark=spark)
    yield d
    d.close()


def bodies(rows):
    return [r["body"] for r in rows]


def test_round_trip_and_reopen(spark, tmp_path):
    path = str(tmp_path / "log")
    values = [None, True, 3, 2.5, "é", [1, [2]], {"b": 1, "a": {"c": None}}]
    with engine.open(path, spark=spark) as d:
        for v in values:
            d.append("s", v)
        d.append("t", "other")
        assert (d.head(), d.durable_head(), d.uncommitted_count()) == (8, 0, 8) and bodies(d.history("s")) == values
        assert d.commit() == 8 and d.uncommitted_bytes() == 0
        with pytest.raises(E.LockedError):
            engine.open(path, spark=spark)
    with pytest.raises(E.ClosedError):
        d.append("s", 1)
    with engine.open(path, spark=spark) as d:
        rows = d.history("s")
        assert bodies(rows) == values and [
            r["stream_revision"] for r in rows
        ] == list(range(7)) and [r["offset"] for r in rows] == list(range(7))
        assert d.append_receipt("s", 1)["previous_revision"] == 6
        assert set(rows[0]) == {
            "offset", "timestamp_ms", "event_id", "batch_id", "batch_index", "branch_id", "namespace",
            "stream_revision", "event_type", "schema_version", "codec", "metadata", "body",
        }


def test_batches_and_conflicts(db):
    first = db.append_batch(
        "s",
        [
            {"body": 1, "event_id": HEX, "metadata": {"m": b"\x00\xff"}, "event_type": "t", "schema_version": 2},
            {"body": 2},
        ],
        expected_revision="no_stream", durability="sync",
    )
    assert (
        first["first_position"], first["last_position"], first["previous_revision"], first["current_revision"],
        first["durability"],
    ) == (0, 1, None, 1, "synced")
    row = db.history("s")[0]
    assert row["metadata"] == {
        "m": b"\x00\xff"
    } and row["event_type"] == "t" and row["schema_version"] == 2 and row["event_id"] == HEX
    with pytest.raises(E.RevisionConflictError):
        db.append_batch("s", [{"body": 3}], expected_revision="no_stream")
    with pytest.raises(E.RevisionConflictError):
        db.append_batch("s", [{"body": 3}], expected_revision=0)
    db.append_batch("s", [{"body": 3}], expected_revision=1)
    retry = db.append_batch(
        "s", [{"body": 1, "event_id": HEX, "metadata": {"m": b"\x00\xff"}, "event_type": "t", "schema_version": 2}],
    )
    assert retry["batch_id"] == first["batch_id"] and retry["durability"] == "buffered"
    for bad in (
        [{"body": 9, "event_id": HEX}], [{"body": 1, "event_id": HEX}, {"body": 2, "event_id": HEX}],
        [
            {"body": 1, "event_id": HEX, "metadata": {"m": b"\x00\xff"}, "event_type": "t", "schema_version": 2},
            {"body": 5},
        ],
    ):
        with pytest.raises(E.EventIdConflictError):
            db.append_batch("s", bad)
    for bad in (
        {"events": []}, {"events": [{"body": 1}], "expected_revision": True}, {"events": [{"nobody": 1}]},
        {"events": [{"body": 1, "event_id": "xy"}]}, {"events": [{"body": 1}], "durability": "never"},
        {"events": [{"body": 1, "metadata": {"stratalog.x": b""}}]},
    ):
        with pytest.raises(E.InvalidArgumentError):
            db.append_batch("s", **bad)
    with pytest.raises(E.CodecError):
        db.append("s", float("nan"))
    with pytest.raises(E.ResourceLimitError):
        db.append_batch("s", [{"body": 1}] * 4097)
    with pytest.raises(ValueError):
        db.append("", 1)
    assert bodies(db.history("s")) == [1, 2, 3]


@pytest.mark.parametrize("commit", [False, True])
def test_idempotency(db, commit):
    one = db.append_batch("s", [{"body": 1}], idempotency_key="k", expected_revision="no_stream")
    if commit:
        db.commit()
    assert db.append_batch(
        "s", [{"body": 1}], idempotency_key="k", expected_revision="no_stream",
    )["first_position"] == one["first_position"]
    with pytest.raises(E.IdempotencyConflictError):
        db.append_batch("s", [{"body": 2}], idempotency_key="k", expected_revision="no_stream")
    branch = db.fork("s", 1)
    assert db.append_batch("s", [{"body": 9}], branch=branch, idempotency_key="k")["first_position"] == 1
    assert db.head() == 2


def test_streams_follow_a_model(spark, tmp_path):
    """Random appends, conflicts and reopenings against a dictionary."""
    r, path = random.Random(4), str(tmp_path / "log")
    model, keys, log = {}, {}, []
    d = engine.open(path, spark=spark)
    for _ in range(40):
        if r.random() < 0.08:
            d.close()
            d = engine.open(path, spark=spark)
        stream, count = r.choice("ab"), r.randint(1, 3)
        expected = r.choice([None, "no_stream", model.get(stream, -1), 5])
        expected = None if expected == -1 else expected
        key, content = r.choice([None, None, "k1", "k2"]), r.randint(0, 1)
        want = (stream, expected, count, content)
        try:
            got = d.append_batch(
                stream, [{"body": [content, i]} for i in range(count)], expected_revision=expected, idempotency_key=key,
            )
        except E.IdempotencyConflictError:
            assert keys[key][0] != want
            continue
        except E.RevisionConflictError:
            assert key not in keys and not (
                expected is None or (expected == "no_stream" and stream not in model) or expected == model.get(stream)
            )
            continue
        if key in keys:
            assert keys[key] == (want, got["first_position"])
            continue
        assert got["first_position"] == len(log)
        model[stream] = model.get(stream, -1) + count
        log += [(stream, [content, i]) for i in range(count)]
        if key:
            keys[key] = (want, got["first_position"])
        assert got["current_revision"] == model[stream]
    for s in "ab":
        assert bodies(d.history(s)) == [b for x, b in log if x == s]
    d.close()


def test_group_commit(spark, tmp_path):
    with engine.open(str(tmp_path / "a"), commit_every_count=2, spark=spark) as d:
        d.append("s", 1)
        assert d.durable_head() == 0
        d.append("s", 2)
        assert d.durable_head() == 2
    with engine.open(str(tmp_path / "b"), commit_every_bytes=10, spark=spark) as d:
        d.append("s", "x" * 20)
        assert d.durable_head() == 1
    with engine.open(str(tmp_path / "c"), commit_every_millis=30, spark=spark) as d:
        d.append("s", 1)
        time.sleep(0.05)
        d.append("s", 2)
        assert d.durable_head() == 2


def test_readers(db):
    for i in range(7):
        db.append("s" if i % 2 == 0 else "t", "x" * i)
    reader = db.open_reader("s", page_events=2)
    db.append("s", "late")
    pages = []
    while True:
        page = reader.next_page()
        pages.append([r["offset"] for r in page["records"]])
        if page["done"]:
            break
    assert pages == [[0, 2], [4, 6]]
    assert [len(db.open_reader("s", page_bytes=1).next_page()["records"])] == [1]
    with pytest.raises(E.OffsetBeyondHeadError):
        db.open_reader("s", 0, 99)
    with pytest.raises(E.InvalidArgumentError):
        db.open_reader("s", page_events=0)
    reader.cancel()
    with pytest.raises(E.CancelledError):
        reader.next_page()
    reader.close()
    with pytest.raises(E.NotFoundError):
        reader.next_page()
    seen = []
    db.replay_each("s", lambda r: seen.append(r["offset"]), 2)
    assert seen == [2, 4, 6, 7] and [r["offset"] for r in db.replay("s", 2, 6)] == [2, 4]


def test_branches(db):
    db.append_batch("s", [{"body": 1}, {"body": 2}])
    db.append("s", 3)
    with pytest.raises(E.NotBatchBoundaryError):
        db.fork("s", 1)
    with pytest.raises(E.OffsetBeyondHeadError):
        db.fork("s", 4)
    a = db.fork("s", 2)
    assert a == "s-fork-2"
    with pytest.raises(E.BranchExistsError):
        db.fork("s", 2)
    db.append_branch(a, "s", "a")
    db.append("s", 4)
    b = db.fork_branch(a, 0, "b")["name"]
    db.append_branch(b, "s", "b")
    assert bodies(
        db.branch_history(a, "s")
    ) == [1, 2, "a"] and bodies(db.branch_history(b, "s")) == ["b"] and bodies(db.history("s")) == [1, 2, 3, 4]
    assert [x["name"] for x in db.branch_ancestry(b)] == ["main", a, "b"]
    d = db.diff("main", a, "s")
    assert d["divergence_offset"] == 2 and [
        bodies(d[k].next_page()["records"]) for k in ("shared", "left", "right")
    ] == [[1, 2], [3, 4], ["a"]] and d["common_ancestor"]["name"] == "main"
    assert db.archive_branch(a)["status"] == "archived" == db.archive_branch(a)["status"]
    with pytest.raises(E.BranchArchivedError):
        db.append_branch(a, "s", 1)
    with pytest.raises(E.InvalidArgumentError):
        db.archive_branch("main")
    with pytest.raises(KeyError):
        db.branch_history("nope", "s")
    assert bodies(db.branch_history(a, "s")) == [1, 2, "a"]


def test_views(db):
    for v in (
        {"id": "k1", "kind": "a", "n": 1}, {"id": "k2", "kind": "b", "n": "1"}, {"id": "k3", "kind": "a"},
        {"id": "user1", "kind": None}, {"id": 5, "kind": "a"}, {"kind": "a"}, "text", {"id": "k1", "kind": "c", "n": 2},
    ):
        db.append("s", v)
    db.register_view("v", "id", {"kind": "kind", "n": "n"})
    v = db.view("v")
    assert v.get("k1") == {"id": "k1", "kind": "c", "n": 2} and v.get("zz") is None and v.len() == 4
    assert [
        x["id"] for x in v.range("k1", "k3")
    ] == ["k1", "k2"] and [x["id"] for x in v.prefix("k")] == ["k1", "k2", "k3"]
    assert [
        x["id"] for x in v.by("kind", "a")
    ] == ["k3"] and [x["id"] for x in v.by("n", 1)] == ["k2"] == [x["id"] for x in v.by("n", "1")] and [
        x["id"] for x in v.by("kind", None)
    ] == ["user1"]
    with pytest.raises(E.NotFoundError):
        v.by("nope", 1)
    db.register_view("w", "id", where_field="kind", where_value="a")
    assert db.view("w").get("k1")["n"] == 1 and db.view("w").len() == 2
    db.append("s", {"id": "k9", "kind": "a"})
    assert db.view("w").len() == 3 and v.len() == 5
    assert db.deregister_view("w") and not db.deregister_view("w")
    with pytest.raises(E.NotFoundError):
        db.view("w")
    db.register_view("p", "id", partitions=4)
    assert sum(db.query_partitions("p", [k]).len().first()[0] for k in range(4)) == 5
    branch = db.fork("s", 1)
    db.append_branch(branch, "s", {"id": "hidden"})
    assert v.get("hidden") is None


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "log")
    with engine.open(path, spark=spark) as d:
        d.register_view("v", "id", {"k": "k"})
        for i in range(6):
            d.append("s", {"id": f"i{i % 3}", "k": i})
            if i % 2:
                d.create_snapshot("v")
        snaps = d.list_snapshots("v")
        assert [s["cursor"] for s in snaps] == [6, 4] and d.verify_snapshot(snaps[0]["id"])["cursor"] == 6
        d.append("s", {"id": "i0", "k": 99})
        before = [d.view("v").get(f"i{i}") for i in range(3)] + d.view("v").by("k", 99)
        d.delete_all_derived_state()
        assert d.list_snapshots("v") == [] and [
            d.view("v").get(f"i{i}") for i in range(3)
        ] + d.view("v").by("k", 99) == before
        made = d.create_snapshot("v")
        d.register_view("v", "id", {})
        assert d.list_snapshots("v") == [] and d.view("v").len() == 3
        assert d.delete_snapshot(made["id"]) and not d.delete_snapshot(made["id"])
        d.rebuild_projection("v")
        with pytest.raises(E.NotFoundError):
            d.create_snapshot("nope")
    with engine.open(path, snapshot_every_events=2, spark=spark) as d:
        d.append("s", {"id": "a"})
        d.append("s", {"id": "b"})
        assert len(d.list_snapshots("v")) == 1 and d.projection_status("v")["status"] == "ready"


@pytest.mark.parametrize("schedule", [{"snapshot_every_bytes": 20}, {"snapshot_every_millis": 1}])
def test_snapshots_by_bytes_or_time(spark, tmp_path, schedule):
    with engine.open(str(tmp_path / "log"), spark=spark, **schedule) as d:
        d.register_view("v", "id", {})
        d.append("s", {"id": "a"})
        d.append("s", {"id": "b"})
        assert d.list_snapshots("v") and d.projection_status("v")["status"] == "ready"


def test_views_in_time_and_by_class(db):
    for i in range(12):
        db.append(f"s{i % 4}", {"id": f"i{i % 4}", "n": i})
    db.register_view("v", "id", partitions=3)
    assert db.view_at("v", 4).len().first()[0] == 4 and db.view_at("v", 2).len().first()[0] == 2
    with pytest.raises(E.OffsetBeyondHeadError):
        db.view_at("v", 99)
    v, stale = db.view("v"), db.view("v", "stale")
    assert v.get("i0")["n"] == 8
    db.append("s0", {"id": "i0", "n": 99})
    assert stale.get("i0")["n"] == 8 and v.get("i0")["n"] == 99 and stale.get("i0")["n"] == 99
    assert db.view("v", "wait", 13).len() == 4
    for bad in (("wait", None), ("head", 1), ("wait", 14), ("soon", None)):
        with pytest.raises(E.InvalidArgumentError):
            db.view("v", *bad)
    for k in range(3):
        before = sorted(map(tuple, db.query_partitions("v", [k]).rows.select("key", "position").collect()))
        made = db.create_snapshot("v", k)
        assert made["partition"] == k and db.verify_snapshot(made["id"])["id"] == made["id"]
        assert sorted(map(tuple, db.query_partitions("v", [k]).rows.select("key", "position").collect())) == before
    assert v.len() == 4
    db.set_commit_policy(every_count=1)
    db.append("s", 1)
    assert db.uncommitted_count() == 0 and db.commit_policy().every_count == 1
    assert db.records_from(12).count() == 2 and {r["type"] for r in db.system_records()} == {"view.registered"}
    assert db.projection(lambda log: log.groupBy("stream_name").count(), until=12).count() == 4
    a = db.fork("s0", 4)
    assert [
        c["name"] for c in db.branch_children("main")
    ] == [a] and db.branch_common_ancestor(a, "main")["name"] == "main" == db.branch_named("main")["name"]


def test_watch(db):
    db.append_batch("a", [{"body": 1}, {"body": 2}])
    db.append("b", 3)
    db.append("a", 4)
    assert list(db.watch(start=0, timeout=0.05)) == []
    db.commit()
    with db.watch(start=0, timeout=0.05, page_batches=1) as w:
        assert [r["body"] for r in w] == [1, 2, 3, 4]
    w = db.watch("a", start=0, timeout=0.05, consumer_id="c")
    assert next(w)["body"] == 1
    assert w.ack() == 1
    assert [r["body"] for r in db.watch("a", consumer_id="c", timeout=0.05)] == [2, 4]
    rest = [r["body"] for r in w]
    assert rest == [2, 4] and w.ack() == 4
    w.close()
    tail = db.watch(timeout=0.05)
    db.append("b", 5)
    db.commit()
    assert [r["body"] for r in tail] == [5]
    branch = db.fork("a", 2)
    db.append_branch(branch, "a", "own")
    db.commit()
    assert [r["body"] for r in db.watch(branch=branch, start=0, timeout=0.05)] == ["own"]
    with pytest.raises(E.PositionUnavailableError):
        db.watch(start=99)
    with pytest.raises(E.InvalidArgumentError):
        db.watch(start=0).ack()


def test_replication(spark, tmp_path, db):
    db.append_batch("s", [{"body": 1, "event_type": "t"}, {"body": 2}])
    rows = db.history("s")
    with engine.open(str(tmp_path / "follower"), spark=spark) as f:
        f.append("x", 0)
        first = f.ingest_batch(rows)
        assert first["first_position"] == 1 and f.ingest_batch(rows)["first_position"] == 1 and f.head() == 3
        assert [
            r["event_id"] for r in f.history("s")
        ] == [r["event_id"] for r in rows] and f.history("s")[0]["batch_id"] == rows[0]["batch_id"]
        with pytest.raises(E.InvalidArgumentError):
            f.ingest_batch(rows[1:])


def test_retention(spark, tmp_path):
    path = str(tmp_path / "log")
    with engine.open(path, spark=spark) as d:
        d.register_view("v", "id")
        for i in range(6):
            d.append("s", {"id": f"i{i}"})
            if i % 2:
                d.commit()
        d.watch(start=0, timeout=0.01, consumer_id="slow").ack()
        branch = d.fork("s", 2)
        for w in list(d.feeds):
            w.close()
        plan = d.plan_retention(5)
        assert plan["effective_floor"] == 4 and {b["kind"] for b in plan["blockers"]} >= {
            "anchor_missing", "branch", "projection",
        }
        with pytest.raises(E.ConflictError):
            d.apply_retention(plan["plan_id"])
        assert d.register_branch_bootstrap(branch, 5, b"state") == 4 and d.branch_bootstrap(branch) == b"state"
        assert d.register_consumer_bootstrap("slow", 5, b"boot") == 4 and d.consumer_bootstrap("slow") == b"boot"
        assert d.create_retention_anchor(5)["floor"] == 4
        plan = d.plan_retention(5)
        assert plan["blockers"] == []
        done = d.apply_retention(plan["plan_id"])
        assert done["floor"] == 4 and done["reclaimed_bytes"] > 0 and d.retention_floor() == 4
        with pytest.raises(E.ConflictError):
            d.apply_retention("0" * 32)
        assert bodies(d.history("s")) == [{"id": "i4"}, {"id": "i5"}] and d.view("v").len() == 6
        with pytest.raises(E.PositionUnavailableError):
            d.replay("s", 0)
        with pytest.raises(E.PositionUnavailableError) as raised:
            d.watch(consumer_id="slow", start=0)
        boot = raised.value.bootstrap
        assert d.fetch_feed_bootstrap(boot, 100) == b"boot" and len(list(d.resume_watch(boot, timeout=0.05))) == 2
        with pytest.raises(E.ResourceLimitError):
            d.fetch_feed_bootstrap(boot, 1)
        with pytest.raises(E.InvalidArgumentError):
            d.fetch_feed_bootstrap({**boot, "floor": 0}, 100)
        for policy, value in (
            ("keep_latest_events", 1), ("keep_newer_than", 0), ("target_log_bytes", 1), ("keep_from", 4),
        ):
            assert d.plan_retention_policy(policy, value)["plan"]["effective_floor"] == 4
        with pytest.raises(ValueError):
            d.plan_retention_policy("forever", 1)
        assert d.retention_status()["anchor_ready"]
    with engine.open(path, spark=spark) as d:
        assert d.retention_floor() == 4 and d.view("v").len() == 6 and d.append_receipt("s", 1)[
            "previous_revision"
        ] == 5


def test_compaction_and_bulk_load(spark, tmp_path):
    with engine.open(str(tmp_path / "log"), spark=spark) as d:
        for i in range(4):
            d.append("s", i)
            d.commit()
        assert d.store.compact() == 3 and bodies(d.history("s")) == [0, 1, 2, 3]
        rows = spark.range(1000).selectExpr(
            "id ord", "concat('b', id % 3) stream_name", "'t' event_type", "cast(id as string) body",
        )
        assert d.store.append_frame(rows) == 1004
        assert [
            r["stream_revision"] for r in d.replay("b1", 4, 20)
        ] == list(range(5)) and bodies(d.replay("b1", 4, 20)) == [1, 4, 7, 10, 13]
        assert d.append_receipt("b1", 0)["previous_revision"] == 332


def test_manifest_checkpoints(spark, tmp_path):
    path = str(tmp_path / "log")
    store = LogStore(spark, path)
    for i in range(140):
        store._publish({"system": [{"type": "consumer", "id": "c", "position": i}]})
    store.close()
    again = LogStore(spark, path)
    assert [r["position"] for r in again.state.system] == list(range(140))
    again.close()


CRASH = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
import stratalog.engine as engine
d = engine.open({path!r}, spark=spark)
for i in range(10000):
    d.append_batch("s", [{{"body": [i, k]}} for k in range(3)], durability="sync")
    print("done", i, flush=True)
"""


def test_killed_writer_leaves_whole_batches(spark, tmp_path):
    root, path = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), str(tmp_path / "log")
    child = subprocess.Popen(
        [sys.executable, "-c", CRASH.format(root=root, path=path)], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL,
        text=True, start_new_session=True,
    )
    acked = -1
    for line in child.stdout:
        acked = int(line.split()[1])
        if acked == 3:
            break
    time.sleep(0.2)
    os.killpg(child.pid, signal.SIGKILL)
    child.wait()
    os.makedirs(os.path.join(path, "data", "99999-orphan"))
    with engine.open(path, spark=spark) as d:
        rows = bodies(d.history("s"))
        n = len(rows) // 3
        assert rows == [[i, k] for i in range(n) for k in range(3)] and n > acked
        assert "data/99999-orphan" in d.store.vacuum()
        d.append("s", "next")


def test_bulk_load_keeps_every_row(spark, tmp_path):
    """A million rows in no order, from 16 files, into 8 ranges: each position once, in the order of `ord`."""
    n, before = 1_000_000, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        shuffled = spark.range(n).select(F.pmod(F.col("id") * 7_368_787, F.lit(n)).alias("ord"))
        body = F.concat(F.lit('{"id":"'), "ord", F.lit('"}'))
        # a third of all rows is one stream's
        stream = F.when(F.col("ord") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("ord") % 1000))
        shuffled.select(
            "ord", stream.alias("stream_name"), F.lit("t").alias("event_type"), body.alias("body"),
        ).repartition(16).write.parquet(str(tmp_path / "source"))
        rows = spark.read.parquet(str(tmp_path / "source"))
        store = LogStore(spark, str(tmp_path / "log"))
        assert store.append_frame(rows.where(f"ord < {n // 4}")) == n // 4
        assert store.append_frame(rows.where(f"ord >= {n // 4}")) == n
        log = store.log()
        wrong = log.where(F.get_json_object("body", "$.id").cast("long") != F.col("position"))
        assert (log.count(), log.select("position").distinct().count(), wrong.count()) == (n, n, 0)
        assert store.verify() == {"events": n, "positions": 0, "batches": 0, "streams": 0}
        assert log.where("stream_name = 'hot'").agg(F.max("stream_revision")).first()[0] == len(range(0, n, 3)) - 1
        assert log.where("stream_name = 'hot' and stream_revision <> position / 3").count() == 0
        # the manifest lists the files with their ranges: a window opens those that it needs
        files = store.state.files
        assert len(files) > 8 and all(a["end"] == b["base"] for a, b in zip(files, files[1:]))
        assert 0 < len(store.log(start=n - 10).inputFiles()) < 3
        assert not store.files.names("staging") and not store.vacuum()
        store.close()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_bulk_load_publishes_nothing_that_is_not_whole(spark, tmp_path):
    from stratalog.errors import IoError

    store = LogStore(spark, str(tmp_path / "log"))
    rows = spark.range(100).select(
        F.col("id").alias("ord"), F.lit("s").alias("stream_name"), F.lit("t").alias("event_type"),
        F.lit("{}").alias("body"),
    )
    with pytest.raises(IoError):
        store.append_frame(rows, expected=101)
    assert store.head == 0 and not store.state.files
    assert store.vacuum()
    assert store.append_frame(rows.limit(0)) == 0
    assert store.append_frame(rows) == 100 and store.append_frame(rows) == 200
    assert store.verify()["positions"] == 0 and store.revision("main", "s") == 199
    store.close()


def test_running_counts_of_a_hot_key(spark):
    from stratalog.operators.folds import prefix_count, running_number

    rows = spark.range(5000).select(F.col("id").alias("position"), F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("k"))
    got = running_number(rows, ["k"], block=64).collect()
    seen = {}
    for r in sorted(got, key=lambda r: r["position"]):
        assert r["number"] == seen.get(r["k"], 0)
        seen[r["k"]] = r["number"] + 1
    assert len(got) == 5000
    marked = prefix_count(rows, F.col("k").isNull(), block=8).collect()
    assert len(marked) == 5000 and all(r["before"] == -(-r["position"] // 3) for r in marked)


def bulk(spark, n, streams=7, name="s"):
    key = F.concat(F.lit("k"), F.lpad((F.col("id") * 31 % (n // 3)).cast("string"), 7, "0"))
    body = F.concat(
        F.lit('{"id":"'), key, F.lit('","kind":"'), F.col("id") % 5, F.lit('","n":'), F.col("id"), F.lit("}"),
    )
    return spark.range(n).select(
        F.col("id").alias("ord"), F.concat(F.lit(name), F.col("id") % streams).alias("stream_name"),
        F.lit("t").alias("event_type"), body.alias("body"),
    )


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    """A log of 60,000 events in several files, and some appended behind them."""
    path = str(tmp_path_factory.mktemp("loaded") / "log")
    d = engine.open(path, spark=spark)
    d.store.append_frame(bulk(spark, 60_000))
    d.append_batch(
        "s1", [{"body": {"id": "k0000001", "kind": "9", "n": -1}}, {"body": {"id": "new", "kind": "1", "n": -2}}],
        durability="sync",
    )
    yield d
    d.close()


def test_pages_read_their_files_only(loaded, monkeypatch):
    """A page opens the files that hold it; a replay by pages is the whole replay."""
    opened, log = [], loaded.store.log
    monkeypatch.setattr(loaded.store, "log", lambda *a, **k: opened.append(log(*a, **k)) or opened[-1])
    reader = loaded.open_reader("s3", page_events=500)
    first = reader.next_page()
    assert len(first["records"]) == 500 and not first["done"]
    assert sum(len(x.inputFiles()) for x in opened) < len(loaded.store.state.files)
    got = [r["offset"] for r in first["records"]]
    while not first["done"]:
        first = reader.next_page()
        got += [r["offset"] for r in first["records"]]
    reader.close()
    assert got == [i for i in range(60_000) if i % 7 == 3]
    sparse = loaded.open_reader("nobody")
    assert sparse.next_page() == {"records": [], "continuation": 60_002, "done": True}
    sparse.close()


def test_feed_pages_hold_whole_batches(loaded, monkeypatch):
    """Bulk loads come in batches of bounded size; a page never tears one, and opens its files only."""
    opened, log = [], loaded.store.log
    monkeypatch.setattr(loaded.store, "log", lambda *a, **k: opened.append(log(*a, **k)) or opened[-1])
    watch = loaded.watch(start=0, page_batches=2, timeout=0)
    page = watch.next_page()
    assert sum(len(x.inputFiles()) for x in opened) < len(loaded.store.state.files)
    sizes, offsets = [], []
    while page:
        batches = {}
        for r in page:
            batches.setdefault(r["batch_id"], []).append(r["batch_index"])
        assert len(batches) <= 2 and all(b == list(range(len(b))) for b in batches.values())
        sizes += [len(b) for b in batches.values()]
        offsets += [r["offset"] for r in page]
        page = watch.next_page()
    watch.close()
    assert offsets == list(range(60_002)) and sizes == [4096] * 14 + [60_000 - 14 * 4096, 2]
    assert loaded.fork("s1", 4096)


def test_a_batch_beyond_a_page_comes_whole(spark, tmp_path, monkeypatch):
    with engine.open(str(tmp_path / "log"), spark=spark) as d:
        d.append_batch("s", [{"body": i} for i in range(50)])
        d.append_batch("s", [{"body": i} for i in range(3)])
        d.commit()
        monkeypatch.setattr(engine, "PAGE_EVENTS", 20)
        watch = d.watch(start=0, page_batches=9, timeout=0)
        assert [len(watch.next_page()) for _ in range(3)] == [50, 3, 0]
        watch.close()


def test_views_are_stored_and_pruned(spark, loaded):
    """Look-ups go to a stored state, sorted by key and by index key, and to the few events behind it; answers are those of
    the fold of the whole log."""
    loaded.register_view("big", "id", {"kind": "kind"})
    v = loaded.view("big")
    whole = engine.IndexedView(loaded._definition("big"), loaded.records_from(0))
    assert v.get("k0000001") == {
        "id": "k0000001", "kind": "9", "n": -1,
    } and v.get("new")["n"] == -2 and v.get("nope") is None
    assert len(loaded.store.files.names("derived")) == 1 and not loaded.list_snapshots("big")
    loaded.append("s1", {"id": "k0000002", "kind": "9", "n": -3})
    assert v.get("k0000002")["n"] == -3 and v.len() == 20_001
    assert sorted(x["id"] for x in v.by("kind", "9")) == ["k0000001", "k0000002"]
    assert [
        x["id"] for x in v.range("k0000001", "k0000004")
    ] == ["k0000001", "k0000002", "k0000003"] and len(v.prefix("k000001")) == 10
    for kind in "01":
        want = [r["key"] for r in whole.by("kind", kind).select("key").collect() if r["key"] not in ("k0000002",)]
        assert [x["id"] for x in v.by("kind", kind)] == want
    layered = loaded.indexed("big")
    plan = layered.get("k0000005")._jdf.queryExecution().toString()
    assert "EqualTo(key,k0000005)" in plan.replace(" ", "")
    assert "EqualTo(index_key,9)" in layered.by("kind", "9")._jdf.queryExecution().toString().replace(" ", "")
    assert sorted(map(tuple, layered.index("kind").collect())) == sorted(
        (r["index_key"], r["key"])
        for r in engine.IndexedView(loaded._definition("big"), loaded.records_from(0)).index("kind").collect()
    )
    assert loaded.projection_status("big")["status"] == "ready"
    loaded.append("s1", {"id": "k0000002", "kind": "1"})
    assert loaded.projection_status("big")["status"] == "stale"
    loaded.commit()


def test_damaged_snapshots_are_passed_over(spark, tmp_path):
    path = str(tmp_path / "log")
    with engine.open(path, spark=spark) as d:
        d.register_view("v", "id", {"k": "k"})
        made = []
        for i in range(3):
            d.append("s", {"id": f"i{i}", "k": i})
            made.append(d.create_snapshot("v"))
        d.append("s", {"id": "i9", "k": 9})
        d.commit()
    state = os.path.join(path, "snapshots", made[2]["id"], "state")
    spark.createDataFrame(
        [("i0", "{}", 0, ["x"])], "key string, value string, position long, ix_k array<string>",
    ).write.mode("overwrite").parquet(state)
    with engine.open(path, spark=spark) as d:
        assert d.view("v").len() == 4 and d.view("v").get("i2")["k"] == 2 and [
            x["id"] for x in d.view("v").by("k", 2)
        ] == ["i2"]
        with pytest.raises(E.ConflictError):
            d.verify_snapshot(made[2]["id"])
        assert d.verify_snapshot(made[1]["id"])["cursor"] == 2
    for root, _, names in os.walk(os.path.join(path, "snapshots", made[1]["id"], "state")):
        for n in names:
            os.remove(os.path.join(root, n))
    with engine.open(path, spark=spark) as d:
        assert d.view("v").len() == 4  # no sound snapshot is left: from the log


def test_snapshots_above_a_floor_are_verified(spark, tmp_path):
    path = str(tmp_path / "log")
    with engine.open(path, spark=spark) as d:
        d.register_view("v", "id")
        for i in range(4):
            d.append_batch("s", [{"body": {"id": f"i{i}"}}], durability="sync")
        plan = d.create_retention_anchor(3) and d.plan_retention(3)
        assert plan["blockers"] == [] and d.apply_retention(plan["plan_id"])["floor"] == 3
        d.append_batch("s", [{"body": {"id": "z"}}], durability="sync")
        made = d.create_snapshot("v")
        assert d.verify_snapshot(made["id"])["cursor"] == 5 and d.view("v").len() == 5
        place = os.path.join(path, "snapshots", made["id"], "state")
        rows = spark.read.parquet(place).where("key <> 'i0'").collect()
        spark.createDataFrame(rows, "key string, value string, position long").write.mode("overwrite").parquet(place)
        with pytest.raises(E.ConflictError):
            d.verify_snapshot(made["id"])
        assert d.store.revision("main", "s") == 4


def test_a_broken_anchor_leaves_the_one_before(spark, tmp_path):
    path = str(tmp_path / "log")
    with engine.open(path, spark=spark) as d:
        for i in range(4):
            d.append_batch("s", [{"body": i}], durability="sync")
        plan = d.create_retention_anchor(3) and d.plan_retention(3)
        d.apply_retention(plan["plan_id"])
        good = d.store._anchor_path()
    os.makedirs(os.path.join(path, "anchor", "999999999999-broken"))
    open(os.path.join(path, "anchor", "999999999999-broken", "part-0.parquet"), "w").close()
    with engine.open(path, spark=spark) as d:
        assert d.store._anchor_path() == good and d.store.revision("main", "s") == 3
        assert d.append_batch("s", [{"body": 9}], expected_revision=3)["current_revision"] == 4


def test_failing_views_fail_alone(db):
    db.register_view("good", "id")
    db.register_runtime(
        "bad",
        lambda log: log.select(
            F.col("stream_name").alias("key"), F.raise_error(F.lit("no")).cast("string").alias("value"), "position",
        ),
    )
    assert db.projection_status("good")["status"] == "building"
    db.append("s", {"id": "a"})
    with pytest.raises(Exception, match="no"):
        db.view("bad").get("s")
    assert db.projection_status("bad")["status"] == "failed" and "no" in db.projection_status("bad")["error"]
    db.append("s", {"id": "b"})
    assert db.view("good").len() == 2 and db.projection_status("good")["status"] == "ready"
    db.register_runtime(
        "bad", lambda log: log.select(F.col("stream_name").alias("key"), F.lit("1").alias("value"), "position"),
    )
    db.append("s", {"id": "c"})
    assert db.view("bad").get("s") == 1 and db.projection_status("bad")["status"] != "failed"


def test_replays_verify_content(spark, tmp_path):
    path = str(tmp_path / "log")
    with engine.open(path, spark=spark) as d:
        d.append_batch(
            "s",
            [
                {"body": {"é": 1}, "metadata": {"b": b"\x00", "a!": b"\xff", "a": b""}, "schema_version": 3},
                {"body": b"\x01\x02", "codec": "bytes"},
            ],
        )
        d.store.append_frame(bulk(spark, 30))
        assert d.frame(engine.ReplayPlan(verify=True)).count() == 32
        where = os.path.join(path, d.store.state.files[0]["path"])
        rows = spark.read.parquet(where).withColumn("body", F.lit("{}")).withColumn(
            "payload", F.lit("{}").cast("binary"),
        ).collect()
        schema = spark.read.parquet(where).schema
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(where)
        assert d.frame(engine.ReplayPlan()).count() == 32
        with pytest.raises(Exception, match="was changed"):
            d.frame(engine.ReplayPlan(verify=True)).collect()


def test_small_files_are_joined_by_a_commit(spark, tmp_path, monkeypatch):
    from stratalog.sources import store as S

    monkeypatch.setattr(S, "ROLL_FILES", 5)
    with engine.open(str(tmp_path / "log"), commit_every_count=1, spark=spark) as d:
        held = d.records_from(0)
        for i in range(12):
            d.append("s", i)
        assert len(d.store.state.files) < 5 and bodies(d.history("s")) == list(range(12)) and held.count() == 0
        assert d.store.verify()["positions"] == 0 and len(
            d.store.vacuum()
        ) >= 8 and bodies(d.history("s")) == list(range(12))


def test_locks_off_local_disks(spark, tmp_path, monkeypatch):
    """A lock that is a file: one writer at a time; one left behind is taken over when its lease has run out, and the writer
    that lost it publishes nothing more."""
    from stratalog.sources import files as S

    monkeypatch.setattr(S.Files, "local", lambda self: None)
    path = str(tmp_path / "log")
    first = LogStore(spark, path)
    with pytest.raises(E.LockedError):
        LogStore(spark, path)
    monkeypatch.setattr(S, "LEASE", -1)
    first.files.renew()
    second = LogStore(spark, path)
    second.append("main", "s", [{"body": 1}])
    assert second.commit() == 1
    first.append("main", "s", [{"body": 2}])
    with pytest.raises(E.LockedError):
        first.commit()
    first.files.unlock()
    assert second.files.exists("LOCK")
    second.close()
    assert not second.files.exists("LOCK")


def test_encodings():
    from stratalog.functions import encoding as C

    data = bytes(range(256))
    assert C.from_base64(C.to_base64(data)) == data == C.from_hex(C.to_hex(data)) and C.to_base64(b"ab") == "YWI="
    for wrong in (lambda: C.from_base64("a"), lambda: C.from_base64("YW I="), lambda: C.from_hex("xy")):
        with pytest.raises(E.CodecError):
            wrong()
