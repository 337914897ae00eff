"""Sessions, checkpoints, imports and the command line."""

import json

import pytest

import stratalog.engine as engine
from stratalog import agent
from stratalog.__main__ import main
from stratalog.errors import MigrationError, MigrationIncompleteError
from stratalog.operators import checkpoints
from stratalog.sources import importer
from stratalog.sources.store import LogStore


def test_session(spark, tmp_path):
    with engine.open(str(tmp_path / "log"), spark=spark) as d:
        assert agent.session_view(d, "s").status == "NotStarted"
        for e in (
            agent.session_started("a1"), agent.model_turn("User", "hi"), agent.tool_call("c1", "find"),
            agent.tool_call("c2", "read"), agent.tool_result("c1", 1), agent.decision("go"), agent.put("k", 1),
            agent.put("k", 2), agent.put("j", 3), agent.delete("j"),
        ):
            d.append("s", e)
        fork = d.fork("s", 5)
        d.append_branch(fork, "s", agent.session_ended("done"))
        d.append("s", agent.tool_call("c1", "again"))
        s = agent.session_view(d, "s")
        assert (s.status, s.agent_id, s.pending, [e["kind"] for e in s.transcript]) == (
            "Active", "a1", ["c2", "c1"], ["ModelTurn", "ToolCall", "ToolCall", "ToolResult", "Decision", "ToolCall"],
        )
        assert agent.session_view(d, "s", fork).status == "Ended" and agent.session_view(d, "s", fork).pending == ["c2"]
        assert agent.session_view(d, "s", until=4).pending == ["c1", "c2"]
        assert [(r["key"], r["value"]) for r in agent.kv_view(d).collect()] == [("k", "2")]
        assert agent.kv_view(d, until=9).count() == 2
        with pytest.raises(ValueError):
            agent.model_turn("Nobody", "")


def test_checkpoints(spark):
    rows = spark.createDataFrame(
        [
            ("t", "a", 0, "checkpoint", "A"), ("t", "a", 1, "writes", "w2"), ("t", "b", 2, "checkpoint", "B"),
            ("t", "a", 3, "writes", "w1"), ("u", "c", 4, "checkpoint", "C"),
        ],
        "thread string, checkpoint_id string, position long, kind string, body string",
    )
    assert {(r["thread"], r["checkpoint_id"]) for r in checkpoints.latest(rows).collect()} == {("t", "b"), ("u", "c")}
    assert [r["body"] for r in checkpoints.by_id(rows, "a").collect()] == ["A"]
    assert {
        (r["checkpoint_id"], r["rank"]) for r in checkpoints.newest_before(rows, 4).collect()
    } == {("b", 1), ("a", 2)}
    assert checkpoints.newest_before(rows, limit=1).count() == 2
    assert {
        r["checkpoint_id"]: list(r["writes"]) for r in checkpoints.pending_writes(rows).collect()
    } == {"a": ["w2", "w1"], "b": [], "c": []}


def test_import(spark, tmp_path, capsys):
    source, path = str(tmp_path / "old"), str(tmp_path / "log")
    spark.range(5000).selectExpr(
        "id offset", "concat('n', id % 3) namespace", "if(id % 10 = 3, 'branch.marker', 't') event_type",
        "concat('{\"i\":', id, '}') body",
    ).repartition(4).write.parquet(source)
    assert main(["import-branches", source, path], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"events": 4500, "skipped": 500, "head": 4500}
    assert main(["import-branches", source, path], spark) == 0
    assert main(["verify", path], spark) == 0 and main(["show", path], spark) == 0 and main(
        ["compact", path], spark,
    ) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[1]) == {
        "events": 4500, "positions": 0, "batches": 0, "streams": 0,
    }
    store = LogStore(spark, path)
    rows = spark.read.parquet(source)
    importer.verify(store, rows, "branch.marker")
    with pytest.raises(MigrationError):
        importer.verify(store, rows.where("offset < 4000"), "branch.marker")
    store.close()
    other = LogStore(spark, str(tmp_path / "other"))
    other.append("main", "s", [{"body": 1}])
    with pytest.raises(MigrationIncompleteError):
        importer.run(other, rows)
    other.close()


def test_import_of_forks(spark, tmp_path):
    """Two markers of either form, a fork of a fork, and a record of the marker's type that names no fork."""
    mark = lambda parent, at: json.dumps({"__old_fork__": {"parent": parent, "at": at}})
    bodies = [
        ("s", "0"), ("s", "1"), ("other", mark("s", "1")), ("t", mark("s", 2)), ("s", "4"), ("t", "5"),
        ("x", '"branch.marker"'), ("u", json.dumps({"kind": "SessionStarted", "config_hash": "forked_from=t@6"})),
        ("u", "8"), ("t", "9"), ("u", "10"), ("s", "11"),
    ]
    rows = spark.createDataFrame(
        [(i, n, "branch.marker" if n == "x" else "t", b) for i, (n, b) in enumerate(bodies)],
        "offset long, namespace string, event_type string, body string",
    )
    seen = []
    for place in ("one", "two"):
        store = LogStore(spark, str(tmp_path / place))
        assert importer.run(store, rows, "branch.marker") == importer.ImportReport(9, 3, 9)
        importer.verify(store, rows, "branch.marker")
        t, u = (store.catalog.named(n) for n in "tu")
        # offsets 0 1 2 4 5 8 9 10 11 are positions 0 to 8 now; the marker at 3 lies before u's fork at 6
        assert (t.parent, t.fork_position, u.parent, u.fork_position) == ("main", 2, t.id, 5)
        assert u.metadata == {"legacy_stream": b"u", "session_stream": b"s"}
        log = sorted(
            store.log().select("position", "branch_id", "stream_name", "stream_revision", "event_id").collect()
        )
        names = {b.id: b.name for b in store.catalog.by_id.values()}
        assert [(names[r[1]], *r[2:4]) for r in log] == [
            ("main", "s", 0), ("main", "s", 1), ("main", "other", 0), ("main", "s", 2), ("t", "s", 0), ("u", "s", 0),
            ("t", "s", 1), ("u", "s", 1), ("main", "s", 3),
        ]
        assert store.verify() == {"events": 9, "positions": 0, "batches": 0, "streams": 0}
        assert all(store.is_batch_boundary(i) for i in range(10))
        seen.append([r["event_id"] for r in log])
        store.close()
        again = LogStore(spark, str(tmp_path / place))
        assert again.catalog.named("u") == u
        again.close()
    assert seen[0] == seen[1] and len(set(seen[0])) == 9
    for bad in (
        [("a", mark("s", 1)), ("a", mark("s", 1))], [("a", mark("s", 3))], [("a", mark("b", 0)), ("b", mark("s", 0))],
    ):
        wrong = spark.createDataFrame(
            [(0, "s", "0")] + [(i + 1, *b) for i, b in enumerate(bad)], "offset long, namespace string, body string",
        )
        with pytest.raises(MigrationError):
            importer.forks_of(wrong)
