"""The log as a stream, and a follower that takes each event once."""

import stratalog.engine as engine
from stratalog.sources.store import LOG
from stratalog.streaming.feed import FeedFilter, batches, delivered, follow, read_stream


def test_stream_and_follow(spark, tmp_path):
    path, target, check = str(tmp_path / "log"), str(tmp_path / "copy"), str(tmp_path / "check")
    with engine.open(path, spark=spark) as d:
        for i in range(3):
            d.append("s", i)
            d.commit()
        for extra in (0, 2):
            for i in range(extra):
                d.append("s", 10 + i)
            d.commit()
            q = follow(read_stream(spark, path, LOG), target, check)
            q.awaitTermination(60)
            assert q.exception() is None
            assert sorted(r["position"] for r in spark.read.parquet(target).collect()) == list(range(3 + extra))


def test_batch_filters(spark):
    rows = [
        (0, "x", "main", "a", "wanted"), (1, "x", "main", "a", "other"), (2, "y", "main", "b", "ignored"),
        (3, "z", "f", "a", "wanted"),
    ]
    log = spark.createDataFrame(
        rows, "position long, batch_id string, branch_id string, stream_name string, event_type string",
    )
    got = lambda **k: sorted(r["batch_id"] for r in batches(log, 0, 4, FeedFilter(**k)).collect())
    assert got() == ["x", "y", "z"] and got(types=["wanted"]) == ["x", "z"] and got(
        branches=["main"]
    ) == ["x", "y"] and got(streams=["a"], branches=["f"]) == ["z"]
    assert delivered(log, 0, 4, FeedFilter(types=["wanted"], branches=["main"])).count() == 2
    assert [r["batch_id"] for r in batches(log, 0, 3).collect() if r["last"] >= 3] == []


def test_live_view_equals_the_fold(spark, tmp_path):
    from stratalog.operators.views import IndexedView, ViewDefinition
    from stratalog.streaming.live_view import latest_state, maintain

    path, target, check = str(tmp_path / "log"), str(tmp_path / "view"), str(tmp_path / "check")
    definition = ViewDefinition("id", where=("kind", "a"))
    assert latest_state(spark, target) is None
    with engine.open(path, spark=spark) as d:
        for part in range(3):
            for i in range(4):
                d.append("s", {"id": f"k{i % 3}", "kind": "a" if (i + part) % 2 else "b", "n": part * 10 + i})
                d.commit()
            q = maintain(read_stream(spark, path, LOG, max_files=3), definition, target, check)
            q.awaitTermination(120)
            assert q.exception() is None
            want = IndexedView(definition, d.store.log()).rows.select("key", "value", "position")
            got = latest_state(spark, target).select("key", "value", "position")
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
