"""Branch arithmetic and plans against models that keep every record's visibility by hand."""

import pytest
from hypothesis import HealthCheck, example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalog.errors import (
    BranchExistsError, BranchNotFoundError, InvalidArgumentError, InvalidBranchAncestryError, OffsetBeyondHeadError,
    PositionUnavailableError,
)
from stratalog.functions.ids import millis, partition_of, partition_of_id, stream_id, stream_id_of
from stratalog.functions.json_fields import equals, index_key, is_string, parsed
from stratalog.operators.retention import Segment, bytes_floor, effective_floor, latest_events_floor
from stratalog.plans.catalog import Branch, Catalog
from stratalog.plans.replay import PartitionClass, ReplayPlan, StreamSet, check_window, compile_plan, diff
from stratalog.streaming.feed import page_of


def history(steps):
    """Appends and forks in order; for each branch the positions it sees, kept as forks copy their parents' lists."""
    catalog, seen, records = Catalog(), {"main": []}, []
    for kind, who, frac in steps:
        names = sorted(seen)
        branch = names[who % len(names)]
        if kind == "append":
            records.append((len(records), branch))
            seen[branch].append(len(records) - 1)
        elif len(seen) < 8:
            at = int(frac * len(records))
            made = f"f{len(seen)}"
            catalog.add(Branch(made, made, branch, at))
            seen[made] = [p for p in seen[branch] if p < at]
    return catalog, seen, records


STEPS = st.lists(
    st.tuples(st.sampled_from(["append", "append", "fork"]), st.integers(0, 9), st.floats(0, 1)), max_size=40,
)
#: A fork of a that lies below a's own fork point.
BELOW = [("append", 0, 0.0)] * 3 + [("fork", 0, 1.0), ("append", 0, 0.0), ("fork", 0, 0.3), ("append", 1, 0.0)]


@settings(max_examples=150, deadline=None)
@given(STEPS)
@example(BELOW)
def test_scopes(steps):
    catalog, seen, records = history(steps)
    for b in seen:
        for until in {0, len(records) // 2, len(records)}:
            caps = dict(catalog.scopes(b, until))
            assert [p for p, at in records if at in caps and p < caps[at]] == [p for p in seen[b] if p < until]


@settings(max_examples=150, deadline=None)
@given(STEPS)
@example(BELOW)
def test_divergence_is_where_visible_records_part(steps):
    catalog, seen, records = history(steps)
    head = len(records)
    for a in seen:
        for b in seen:
            ancestor, at = catalog.divergence(a, head, b, head)
            assert [p for p in seen[a] if p < at] == [p for p in seen[b] if p < at]
            if a != b:
                assert not {p for p in seen[a] if p >= at} & {p for p in seen[b] if p >= at}
            assert ancestor.id in {x.id for x in catalog.ancestry(a)} & {x.id for x in catalog.ancestry(b)}
            caps = dict(catalog.scopes(ancestor.id, at))
            assert [p for p, own in records if own in caps and p < caps[own]] == [p for p in seen[a] if p < at]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(STEPS)
@example(BELOW)
def test_frames_follow_the_model(spark, steps):
    catalog, seen, records = history(steps)
    head = len(records)
    log = spark.createDataFrame([(p, b) for p, b in records], "position long, branch_id string")
    for b in seen:
        assert [r[0] for r in compile_plan(ReplayPlan(b), log, catalog, head).collect()] == seen[b]
    left, right = max(seen), "main"
    d = diff(log, catalog, left, right, head)
    assert [r[0] for r in d.shared.collect()] + [r[0] for r in d.left.collect()] == seen[left]
    assert [r[0] for r in d.shared.collect()] + [r[0] for r in d.right.collect()] == seen[right]


def test_catalog_errors():
    c = Catalog([Branch("a", "a", "main", 0)])
    for bad, error in (
        (Branch("a", "x", "main", 0), BranchExistsError), (Branch("x", "a", "main", 0), BranchExistsError),
        (Branch("x", "x", "nope", 0), BranchNotFoundError), (Branch("x", "", "main", 0), InvalidArgumentError),
        (Branch("x", "x"), InvalidBranchAncestryError),
    ):
        with pytest.raises(error):
            c.add(bad)
    with pytest.raises(InvalidArgumentError):
        c.archive("main")
    for i in range(62):
        c.add(Branch(f"d{i}", f"d{i}", f"d{i - 1}" if i else "a", 0))
    with pytest.raises(InvalidBranchAncestryError):
        c.add(Branch("deep", "deep", "d61", 0))
    assert [b.name for b in c.children("main")] == ["a"] and c.common_ancestor("d3", "d7").id == "d3"


def test_windows():
    assert check_window(5, None, 3) == 3 and check_window(0, 3, 3) == 3
    with pytest.raises(OffsetBeyondHeadError):
        check_window(0, 4, 3)
    for start, until in ((1, None), (1, 3), (5, 1)):
        with pytest.raises(PositionUnavailableError):
            check_window(start, until, 9, 2)


def test_plan_selectors(spark):
    ids = [stream_id_of("d", "main", f"s{i}") for i in range(30)]
    log = spark.createDataFrame(
        [(i, "main", f"s{i % 30}", ids[i % 30], i * 10, "t" if i % 2 else "u") for i in range(90)],
        "position long, branch_id string, stream_name string, stream_id string, ts_nanos long, event_type string",
    )
    run = lambda **k: [r[0] for r in compile_plan(ReplayPlan(**k), log, Catalog(), 90).select("position").collect()]
    assert run(after=9, until=12) == [10, 11] and run(start=80, max_events=3) == [80, 81, 82]
    assert run(streams=StreamSet(names=["s1"])) == [1, 31, 61] == run(streams=StreamSet(ids=[ids[1]]))
    assert run(times=(100, 130)) == [10, 11, 12] and run(
        types=("t",), until=4,
    ) == [1, 3] and run(start=50, until=20) == []
    parts = [run(streams=PartitionClass(4, k)) for k in range(4)]
    assert sorted(sum(parts, [])) == list(range(90)) and all(
        partition_of_id(ids[p % 30], 4) == k for k in range(4) for p in parts[k]
    )
    got = log.select(
        "stream_id", partition_of(F.col("stream_id"), 7).alias("p"),
        stream_id("d", "main", F.col("stream_name")).alias("again"),
    ).collect()
    assert all(r["p"] == partition_of_id(r["stream_id"], 7) and r["again"] == r["stream_id"] for r in got)


def test_plans_prune(spark, tmp_path):
    spark.range(1000).selectExpr(
        "id position", "'main' branch_id", "id ts_nanos", "'x' body",
    ).write.parquet(str(tmp_path / "l"))
    plan = compile_plan(
        ReplayPlan(start=10, until=20), spark.read.parquet(str(tmp_path / "l")), Catalog(), 1000, ordered=False,
    ).select("position")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(position,10)" in plan and "body" not in plan


def test_json(spark):
    bodies = [
        '{"k":1}', '{"k":"1"}', '{"k":null}', "{}", "no json", '{"k":1.5}', '{"k":[1,2]}', '{"k":"null"}', '{"k":true}',
        None,
    ]
    v = parsed(F.col("b"))
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string").select(
        "i", is_string(v, "k").alias("s"), index_key(v, "k").alias("x"), equals(v, "k", 1).alias("one"),
        equals(v, "k", "1").alias("str"), equals(v, "k", None).alias("nil"), equals(v, "k", True).alias("yes"),
    ).orderBy("i").collect()
    assert [r["s"] for r in rows] == [False, True, False, False, False, False, False, True, False, False]
    assert [r["x"] for r in rows] == ["1", "1", "null", None, None, "1.5", "[1,2]", "null", "true", None]
    assert [[i for i, r in enumerate(rows) if r[c]] for c in ("one", "str", "nil", "yes")] == [[0], [1], [2], [8]]
    assert [
        r[0]
        for r in spark.createDataFrame(
            [(-5,), (0,), (1_999_999,), (2_000_000,)], "n long",
        ).select(millis(F.col("n"))).collect()
    ] == [0, 0, 1, 2]


def test_retention_arithmetic():
    segments = [Segment(0, 10, 100), Segment(10, 20, 50), Segment(20, 30, 30)]
    assert [effective_floor(segments, p, 0) for p in (0, 9, 10, 25, 30)] == [0, 0, 10, 20, 20]
    assert latest_events_floor(30, 10, 5) == 25 and latest_events_floor(30, 10, 99) == 10
    assert bytes_floor(segments, 80, 0) == (10, True) and bytes_floor(
        segments, 1000, 0,
    ) == (0, True) and bytes_floor(segments, 5, 0) == (20, False) and bytes_floor([], 5, 7) == (7, True)


def test_pages():
    assert page_of([], 5, 5) == 0 and page_of([(9, 9)], 5, 5) == 1 and page_of(
        [(1, 2), (1, 2), (1, 2)], 9, 4,
    ) == 2 and page_of([(1, 1)] * 9, 3, 99) == 3
