"""Every query of the catalogue against its SQL."""

import duckdb
import pytest

from stratalog.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want))


def test_shared_prefix_of_every_stream(spark, sf_dir):
    """Main against a, stream by stream, in plain Python."""
    from stratalog.queries import events_log, visible

    log, catalog, head = events_log(spark, sf_dir)
    sides = []
    for branch in ("main", "a"):
        lists = {}
        for r in log.where(visible(catalog, branch, head)).select("stream_name", "position").orderBy("position").collect():
            lists.setdefault(r["stream_name"], []).append(r["position"])
        sides.append(lists)
    want = set()
    for s in set(sides[0]) | set(sides[1]):
        a, b = sides[0].get(s, []), sides[1].get(s, [])
        shared = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        want.add((s, shared, len(a), len(b)))
    got = QUERIES["shared_prefix_len"](spark, sf_dir).select("stream_name", "shared", "left_length", "right_length")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {s for s, *_ in want} == {r[0] for r in log.select("stream_name").distinct().collect()}
