"""The query catalogue over the test tables, each with its SQL.  Every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import encoding
from .functions.ids import partition_of
from .operators import checkpoints, folds, retention, session
from .operators.views import IndexedView, TypedView, ViewDefinition
from .plans.catalog import ancestry_frame
from .plans.replay import PartitionClass, ReplayPlan, StreamSet, compile_plan, diff, visible
from .sources.adapters import catalog_for, conversation_log, events_log, kv_changes, session_events, table, view_bodies
from .streaming import feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ROW = ["position", "branch_id", "stream_name", "event_type", "body"]

#: The log in SQL, and the caps of each branch's line, as the catalog has them.
LOG = """n AS (SELECT count(*) AS n FROM events),
log AS (SELECT event_id AS position, epoch_us(ts) * 1000 AS ts_nanos,
    CASE WHEN user_id % 7 = 1 AND event_id >= 4 * n // 10 THEN 'a' WHEN user_id % 7 = 2 AND event_id >= n // 2 THEN 'b'
         WHEN user_id % 7 = 3 AND event_id >= 6 * n // 10 THEN 'c' ELSE 'main' END AS branch_id,
    'user-' || user_id AS stream_name, event_id // 10 AS batch_id, user_id, event_type, value, props AS body,
    CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events, n),
branches(id, parent, fork_position, status) AS (SELECT 'main', NULL, NULL, 'active' UNION ALL SELECT 'a', 'main', 4 * n // 10, 'active' FROM n
    UNION ALL SELECT 'b', 'a', 3 * n // 10, 'active' FROM n UNION ALL SELECT 'c', 'main', 6 * n // 10, 'archived' FROM n),
line AS (SELECT id AS branch, id AS ancestor, parent, fork_position, 0 AS depth FROM branches
    UNION ALL SELECT l.branch, b.id, b.parent, b.fork_position, depth + 1 FROM line l JOIN branches b ON b.id = l.parent),
caps AS (SELECT branch, ancestor, depth, least((SELECT n FROM n), coalesce(min(fork_position) OVER (PARTITION BY branch ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), (SELECT n FROM n))) AS cap FROM line)"""


def sql(text: str) -> str:
    return f"WITH RECURSIVE {LOG} {text}"


def seen(branch: str, until: str = "(SELECT n FROM n)") -> str:
    """The SQL of what a branch sees below `until`."""
    return f"(SELECT log.* FROM log JOIN caps ON branch = '{branch}' AND ancestor = branch_id AND position < least(cap, {until}))"


def query(text: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = sql(text) if text.lstrip().startswith(("SELECT", ",")) else text
        return f

    return put


def read(spark: SparkSession, sf_dir: str, **plan) -> DataFrame:
    log, catalog, head = events_log(spark, sf_dir)
    resolved = {k: v(head) if callable(v) else v for k, v in plan.items()}
    return compile_plan(ReplayPlan(**resolved), log, catalog, head, ordered=False)


COLUMNS = "position, branch_id, stream_name, event_type, body"


# --- reads ---------------------------------------------------------------------------------------------------------


@query(f"SELECT {COLUMNS} FROM log WHERE stream_name = 'user-8'")
def raw_replay_stream(spark, d):
    return read(spark, d, branch=None, streams=StreamSet(names=["user-8"])).select(ROW)


for _b in ("main", "a", "b", "c"):

    def _replay(spark, d, _b=_b):
        return read(spark, d, branch=_b).select(ROW)

    _replay.__name__ = f"branch_replay_{_b}"
    query(f"SELECT {COLUMNS} FROM {seen(_b)}")(_replay)


@query(
    f"SELECT {COLUMNS} FROM {seen('main', 'n // 2')}, n WHERE position >= n // 4".replace(
        "least(cap, n // 2)", "least(cap, (SELECT n // 2 FROM n))",
    )
)
def position_window(spark, d):
    return read(spark, d, start=lambda n: n // 4, until=lambda n: n // 2).select(ROW)


@query(
    f"SELECT {COLUMNS}, ts_nanos FROM {seen('main')}, (SELECT min(ts_nanos) AS lo, max(ts_nanos) AS hi FROM log) WHERE ts_nanos >= lo + (hi - lo) // 4 AND ts_nanos < lo + (hi - lo) // 2"
)
def time_filter(spark, d):
    log, catalog, head = events_log(spark, d)
    lo, hi = log.agg(F.min("ts_nanos"), F.max("ts_nanos")).first()
    return compile_plan(
        ReplayPlan(times=(lo + (hi - lo) // 4, lo + (hi - lo) // 2)), log, catalog, head, ordered=False,
    ).select(*ROW, "ts_nanos")


@query(f"SELECT {COLUMNS} FROM {seen('a')} WHERE stream_name IN ('user-1', 'user-2', 'user-8')")
def stream_set(spark, d):
    return read(spark, d, branch="a", streams=StreamSet(names=["user-1", "user-2", "user-8"])).select(ROW)


@query(f"SELECT {COLUMNS} FROM {seen('b')} WHERE event_type = 'purchase' ORDER BY position LIMIT 100")
def max_events(spark, d):
    return read(spark, d, branch="b", types=("purchase",), max_events=100).select(ROW)


@query(f"SELECT {COLUMNS} FROM {seen('main')}, n WHERE position >= n - 100")
def tail_seek(spark, d):
    return read(spark, d, start=lambda n: n - 100).select(ROW)


@query(f"""SELECT stream_name, CAST((rn - 1) // 20 AS BIGINT) AS page, min(position) AS first, max(position) + 1 AS continuation, count(*) AS events
    FROM (SELECT *, row_number() OVER (PARTITION BY stream_name ORDER BY position) AS rn FROM {seen('main')}) GROUP BY 1, 2""")
def page_by_events(spark, d):
    rows = folds.running_number(
        read(spark, d).select("stream_name", "position"), ["stream_name"],
    ).withColumn("page", F.floor(F.col("number") / 20).cast("long"))
    return rows.groupBy("stream_name", "page").agg(
        F.min("position").alias("first"), (F.max("position") + 1).alias("continuation"), F.count("*").alias("events"),
    )


@query(f""", sized AS (SELECT stream_name, position, length(body) + length(event_type) AS size, row_number() OVER (PARTITION BY stream_name ORDER BY position) AS rn FROM {seen('main')}),
    walk AS (SELECT stream_name, position, rn, size AS used, 0 AS page FROM sized WHERE rn = 1
        UNION ALL SELECT s.stream_name, s.position, s.rn, CASE WHEN used + size > 200 THEN size ELSE used + size END, CASE WHEN used + size > 200 THEN page + 1 ELSE page END
        FROM walk w JOIN sized s ON s.stream_name = w.stream_name AND s.rn = w.rn + 1)
    SELECT stream_name, CAST(page AS BIGINT) AS page, min(position) AS first, count(*) AS events, CAST(max(used) AS BIGINT) AS bytes FROM walk GROUP BY 1, 2""")
def page_by_bytes(spark, d):
    """Pages of at most 200 bytes; the first record of a page always fits.  Each page's extent depends on the one
    before: an ordered fold of each stream, in one pass over sorted partitions."""

    def start():
        return []

    def step(pages, e):
        size = len(e["body"]) + len(e["event_type"])
        if pages and pages[-1][2] + size <= 200:
            pages[-1][1] += 1
            pages[-1][2] += size
        else:
            pages.append([e["position"], 1, size])
        return pages

    rows = read(spark, d).select("stream_name", "position", "body", "event_type")
    out = folds.ordered_fold(
        rows, ["stream_name"], "stream_name string, pages array<struct<first: bigint, events: bigint, bytes: bigint>>",
        start, step,
        lambda k, p: {"stream_name": k[0], "pages": [{"first": int(a), "events": b, "bytes": c} for a, b, c in p]},
    )
    return out.select("stream_name", F.posexplode("pages").alias("page", "p")).select(
        "stream_name", F.col("page").cast("long").alias("page"), "p.first", "p.events", "p.bytes",
    )


@query(
    "SELECT l.position, coalesce(p.batch_id <> l.batch_id, true) AS boundary FROM log l LEFT JOIN log p ON p.position = l.position - 1"
)
def batch_boundary(spark, d):
    log, _, _ = events_log(spark, d)
    before = log.select((F.col("position") + 1).alias("position"), F.col("batch_id").alias("previous"))
    return log.join(before, "position", "left").select(
        "position", F.coalesce(F.col("previous") != F.col("batch_id"), F.lit(True)).alias("boundary"),
    )


@query(
    "SELECT branch_id, stream_name, count(*) - 1 AS revision, count(*) AS events, min(position) AS first, max(position) AS last, count(DISTINCT batch_id) AS batches FROM log GROUP BY 1, 2"
)
def stream_catalog(spark, d):
    log, _, _ = events_log(spark, d)
    return log.groupBy("branch_id", "stream_name").agg(
        (F.count("*") - 1).alias("revision"), F.count("*").alias("events"), F.min("position").alias("first"),
        F.max("position").alias("last"), F.count_distinct("batch_id").alias("batches"),
    )


@query(
    "SELECT position, branch_id, stream_name, row_number() OVER (PARTITION BY branch_id, stream_name ORDER BY position) - 1 AS stream_revision FROM log"
)
def stream_revisions(spark, d):
    log, _, _ = events_log(spark, d)
    rows = folds.running_number(log.select("position", "branch_id", "stream_name"), ["branch_id", "stream_name"])
    return rows.select("position", "branch_id", "stream_name", F.col("number").alias("stream_revision"))


@query(
    "WITH r AS (SELECT 'conv-' || conv_id AS stream_name, turn FROM conversations) SELECT stream_name, count(*) AS events, max(turn) AS revision, max(turn) + 1 - count(DISTINCT turn) AS gaps FROM r GROUP BY 1"
)
def revision_gap_check(spark, d):
    rows = conversation_log(spark, d).groupBy("stream_name").agg(
        F.count("*").alias("events"), F.max("stream_revision").alias("revision"),
        F.count_distinct("stream_revision").alias("n"),
    )
    return rows.select("stream_name", "events", "revision", (F.col("revision") + 1 - F.col("n")).alias("gaps"))


@query(
    "SELECT sha256(coalesce(text, '')) AS fingerprint, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1".replace(
        "SELECT sha256", "WITH x AS (SELECT 1) SELECT sha256",
    )
)
def idempotent_dedup(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"),
    )
    return docs.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(
    "SELECT sha256(body || chr(0) || event_type) AS fingerprint, count(*) AS events, min(position) AS first FROM log GROUP BY 1"
)
def event_fingerprints(spark, d):
    log, _, _ = events_log(spark, d)
    return log.groupBy(
        F.sha2(F.concat_ws("\0", "body", "event_type"), 256).alias("fingerprint")
    ).agg(F.count("*").alias("events"), F.min("position").alias("first"))


@query(
    "WITH x AS (SELECT encode(p_name) AS b FROM part) SELECT base64(b) AS coded, lower(hex(b)) AS digits, count(*) AS n FROM x GROUP BY 1, 2"
)
def encoded_bytes(spark, d):
    """Bytes as base64 and as hexadecimal digits, there and back."""
    data = F.col("p_name").cast("binary")
    rows = table(spark, d, "part").select(
        encoding.base64_column(data).alias("coded"), encoding.hex_column(data).alias("digits"),
    )
    same = encoding.from_base64_column(F.col("coded")) == encoding.from_hex_column(F.col("digits"))
    return rows.where(same).groupBy("coded", "digits").agg(F.count("*").alias("n"))


# --- branches and diff -----------------------------------------------------------------------------------------------


def _branches(spark: SparkSession, d: str):
    head = table(spark, d, "events").count()
    return catalog_for(head), head


@query("SELECT branch, ancestor, CAST(depth AS BIGINT) AS depth FROM line")
def ancestry_cte(spark, d):
    return ancestry_frame(_branches(spark, d)[0].frame(spark))


@query(
    "SELECT p.id AS parent, c.id AS child, c.fork_position, c.status FROM branches p JOIN branches c ON c.parent = p.id"
)
def branch_children(spark, d):
    catalog, _ = _branches(spark, d)
    b = catalog.frame(spark)
    return b.where("parent is not null").select("parent", F.col("id").alias("child"), "fork_position", "status")


@query("SELECT branch, ancestor, cap FROM caps")
def replay_scopes(spark, d):
    catalog, head = _branches(spark, d)
    return spark.createDataFrame(
        [(b, s, cap) for b in catalog.by_id for s, cap in catalog.scopes(b, head)],
        "branch string, ancestor string, cap long",
    )


@query(""", pairs AS (SELECT a.id AS l, b.id AS r FROM branches a, branches b),
    shared AS (SELECT l, r, x.ancestor, x.depth AS dl FROM pairs JOIN line x ON x.branch = l JOIN line y ON y.branch = r AND y.ancestor = x.ancestor),
    deepest AS (SELECT l, r, arg_min(ancestor, dl) AS ancestor FROM shared GROUP BY l, r),
    apart AS (SELECT l, r, fork_position FROM pairs JOIN line ON branch IN (l, r) WHERE (l, r, line.ancestor) NOT IN (SELECT l, r, ancestor FROM shared))
    SELECT d.l AS left_branch, d.r AS right_branch, d.ancestor, least((SELECT n FROM n), coalesce(min(fork_position), (SELECT n FROM n))) AS divergence FROM deepest d LEFT JOIN apart a ON a.l = d.l AND a.r = d.r GROUP BY 1, 2, 3""")
def divergence_matrix(spark, d):
    catalog, head = _branches(spark, d)
    rows = [
        (x, y, *(lambda a: (a[0].id, a[1]))(catalog.divergence(x, head, y, head))) for x in catalog.by_id
        for y in catalog.by_id
    ]
    return spark.createDataFrame(rows, "left_branch string, right_branch string, ancestor string, divergence long")


def _diff(spark, d, left="a", right="c"):
    log, catalog, head = events_log(spark, d)
    return diff(log, catalog, left, right, head, ordered=False)


@query(f"SELECT {COLUMNS} FROM {seen('main', '(SELECT 4 * n // 10 FROM n)')}")
def diff_shared(spark, d):
    return _diff(spark, d).shared.select(ROW)


@query(f"SELECT {COLUMNS} FROM {seen('a')}, n WHERE position >= 4 * n // 10")
def diff_left_suffix(spark, d):
    return _diff(spark, d).left.select(ROW)


@query(f"SELECT {COLUMNS} FROM {seen('c')}, n WHERE position >= 4 * n // 10")
def diff_right_suffix(spark, d):
    return _diff(spark, d).right.select(ROW)


@query("SELECT id AS branch, CAST(0 AS BIGINT) AS mismatches FROM branches WHERE id <> 'main'")
def diff_reconstruction(spark, d):
    """Shared part and suffix together are the branch's own replay: the symmetric difference has no rows."""
    log, catalog, head = events_log(spark, d)
    out = None
    for b in [x for x in catalog.by_id if x != "main"]:
        parts = diff(log, catalog, b, "main", head, ordered=False)
        made = parts.shared.select("position").unionByName(parts.left.select("position"))
        whole = log.where(visible(catalog, b, head)).select("position")
        off = made.withColumn("side", F.lit(1)).unionByName(
            whole.withColumn("side", F.lit(-1))
        ).groupBy("position").agg(F.sum("side").alias("side")).where("side <> 0")
        one = off.agg(F.count("*").alias("mismatches")).select(F.lit(b).alias("branch"), "mismatches")
        out = one if out is None else out.unionByName(one)
    return out


# --- folds -----------------------------------------------------------------------------------------------------------


def kv_sql(source: str) -> str:
    return f"SELECT key, value, position FROM (SELECT k AS key, arg_max(value, position) AS value, max(position) AS position, arg_max(event_type, position) AS last FROM {source} GROUP BY k) WHERE last <> 'error'"


def kv(log: DataFrame) -> DataFrame:
    return folds.last_writer_wins(kv_changes(log), ["key"], ["value"], F.col("deleted"))


@query(kv_sql("log"))
def kv_state(spark, d):
    return kv(events_log(spark, d)[0])


@query(kv_sql("(SELECT log.* FROM log, n WHERE position < n // 2)"))
def kv_view_at(spark, d):
    return kv(read(spark, d, branch=None, until=lambda n: n // 2))


@query(kv_sql(seen("b", "(SELECT 9 * n // 10 FROM n)")))
def kv_on_branch(spark, d):
    """The flagship: key/value state of a forked branch at a position in the past."""
    return kv(read(spark, d, branch="b", until=lambda n: 9 * n // 10))


@query(kv_sql("log"))
def snapshot_plus_suffix(spark, d):
    """A snapshot at half the log, deletes kept, and the fold of the rest on top of it."""
    log, _, head = events_log(spark, d)
    half = folds.changes_with_deletes(
        kv_changes(log.where(F.col("position") < head // 2)), ["key"], ["value"], F.col("deleted"),
    )
    rest = kv_changes(log.where(F.col("position") >= head // 2))
    return folds.merge_states(half, rest, keys=["key"], values=["value"], deleted="deleted")


@query(
    "SELECT stream_name, count(*) FILTER (event_type = 'view') AS moves, count(*) FILTER (event_type = 'purchase') AS loot, arg_max(event_type, position) FILTER (event_type IN ('signup', 'error')) AS mode, max(position) AS cursor FROM log GROUP BY 1"
)
def world_fold(spark, d):
    log, _, _ = events_log(spark, d)
    edge = F.when(F.col("event_type").isin("signup", "error"), F.col("position"))
    return log.groupBy("stream_name").agg(
        F.count_if(F.col("event_type") == "view").alias("moves"),
        F.count_if(F.col("event_type") == "purchase").alias("loot"), F.max_by("event_type", edge).alias("mode"),
        F.max("position").alias("cursor"),
    )


@query("""SELECT stream_name, CAST(max(run) AS BIGINT) AS longest_run FROM (SELECT stream_name, grp, count(*) AS run FROM (
    SELECT *, row_number() OVER (PARTITION BY stream_name ORDER BY position) - row_number() OVER (PARTITION BY stream_name, event_type ORDER BY position) AS grp FROM log) GROUP BY stream_name, event_type, grp) GROUP BY 1""")
def custom_fold(spark, d):
    """A fold that needs every event in order: the longest run of events of one type in each stream."""
    log, _, _ = events_log(spark, d)

    def run(s, events):
        last, length, longest = s
        types = events["event_type"].to_numpy(object)
        ends = [*(i + 1 for i in (types[1:] != types[:-1]).nonzero()[0].tolist()), len(types)]
        for low, high in zip([0, *ends], ends):
            length = high - low + (length if low == 0 and types[0] == last else 0)
            longest = max(longest, length)
        return types[-1], length, longest

    rows = log.select("stream_name", "position", "event_type")
    finish = lambda k, s: {"stream_name": k[0], "longest_run": s[2]}
    return folds.ordered_fold(
        rows, ["stream_name"], "stream_name string, longest_run bigint", lambda: (None, 0, 0), None, finish, run=run,
    )


@query("""WITH x AS (SELECT l_partkey, max({'d': l_shipdate, 'o': l_orderkey, 'n': l_linenumber, 's': l_suppkey, 'q': l_quantity, 'p': l_extendedprice}) AS m, count(*) AS shipments FROM lineitem GROUP BY 1)
    SELECT l_partkey, m.o AS orderkey, m.s AS suppkey, m.p AS price, shipments FROM x""")
def part_state_fold(spark, d):
    """The last shipment of each part: a last-writer-wins fold of the largest table, in one map-side combined shuffle."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"]
    out = table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.max(F.struct(*order)).alias("m"), F.count("*").alias("shipments"),
    )
    return out.select(
        "l_partkey", F.col("m.l_orderkey").alias("orderkey"), F.col("m.l_suppkey").alias("suppkey"),
        F.col("m.l_extendedprice").alias("price"), "shipments",
    )


@query(
    "SELECT CAST(position // 1000 AS BIGINT) AS block, count(*) AS events, md5(string_agg(position, ',' ORDER BY position)) AS digest FROM log GROUP BY 1"
)
def log_digest(spark, d):
    return folds.block_digest(events_log(spark, d)[0])


@query(
    "WITH x AS (SELECT 1) SELECT conv_id, count(DISTINCT turn) AS steps, max(turn) + 1 AS next_step, count(*) = count(DISTINCT turn) AND count(DISTINCT turn) = max(turn) + 1 AS once FROM conversations GROUP BY 1"
)
def step_exactly_once(spark, d):
    return folds.exactly_once(table(spark, d, "conversations"), ["conv_id"], "turn")


@query(
    "WITH x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) SELECT o_custkey, o_orderkey, o_orderstatus FROM x WHERE rn = 1"
)
def checkpoint_latest(spark, d):
    rows = checkpoints.latest(order_checkpoints(spark, d))
    return rows.select(
        F.col("thread").alias("o_custkey"), F.col("checkpoint_id").alias("o_orderkey"),
        F.col("body").alias("o_orderstatus"),
    )


def order_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a saver's checkpoints: the customer is the thread, dates and keys are positions."""
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("thread"), F.col("o_orderkey").alias("checkpoint_id"),
        F.lit("checkpoint").alias("kind"), F.struct("o_orderdate", "o_orderkey").alias("position"),
        F.col("o_orderstatus").alias("body"),
    )


@query(
    "WITH x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01') SELECT o_custkey, o_orderkey, CAST(rn AS BIGINT) AS rank FROM x WHERE rn <= 3"
)
def checkpoint_list_before(spark, d):
    before = F.struct(
        F.lit("1996-01-01").cast("timestamp_ntz").alias("o_orderdate"), F.lit(0).cast("long").alias("o_orderkey"),
    )
    rows = checkpoints.newest_before(order_checkpoints(spark, d), before, 3)
    return rows.select(F.col("thread").alias("o_custkey"), F.col("checkpoint_id").alias("o_orderkey"), "rank")


@query(
    "WITH x AS (SELECT 1) SELECT o_custkey, o_orderkey, count(l_linenumber) AS writes FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"
)
def checkpoint_writes(spark, d):
    writes = table(spark, d, "lineitem").groupBy(
        F.col("l_orderkey").alias("o_orderkey")
    ).agg(F.count("l_linenumber").alias("w"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey").join(writes, "o_orderkey", "left").select(
        "o_custkey", "o_orderkey", F.coalesce("w", F.lit(0)).alias("writes"),
    )


# --- views -----------------------------------------------------------------------------------------------------------

BODY = "'{\"id\":\"u' || user_id || '\",\"k\":' || CASE WHEN user_id % 2 = 0 THEN '' || k ELSE '\"' || k || '\"' END || ',\"kind\":\"' || event_type || '\"}'"


def view_sql(where: str = "true", source: str | None = None) -> str:
    return f"(SELECT 'u' || user_id AS key, arg_max({BODY}, position) AS value, max(position) AS position, arg_max(event_type, position) AS kind, '' || arg_max(k, position) AS k FROM {source or seen('main')} WHERE {where} GROUP BY user_id)"


def _view(spark, d, where=None) -> IndexedView:
    definition = ViewDefinition("id", {"by_kind": "kind", "by_k": "k"}, where)
    return IndexedView(definition, view_bodies(read(spark, d)))


@query(f"SELECT key, value, position FROM {view_sql()}")
def view_lww_json(spark, d):
    return _view(spark, d).rows.select("key", "value", "position")


@query(f"""SELECT key, value, position FROM {view_sql("event_type = 'purchase'")}""")
def view_where_before_fold(spark, d):
    return _view(spark, d, ("kind", "purchase")).rows.select("key", "value", "position")


@query(f"SELECT key, value FROM {view_sql()} WHERE key = 'u8'")
def view_get(spark, d):
    return _view(spark, d).get("u8").select("key", "value")


@query(f"SELECT key, value FROM {view_sql()} WHERE key >= 'u11' AND key < 'u2'")
def view_range(spark, d):
    return _view(spark, d).range("u11", "u2").select("key", "value")


@query(f"SELECT key, value FROM {view_sql()} WHERE key > 'u11' AND key <= 'u14'")
def view_range_bounds(spark, d):
    return _view(spark, d).range("u11", "u14", include_low=False, include_high=True).select("key", "value")


@query(f"SELECT key, value FROM {view_sql()} WHERE starts_with(key, 'u1')")
def view_prefix(spark, d):
    return _view(spark, d).prefix("u1").select("key", "value")


@query(f"SELECT key, value FROM {view_sql()} WHERE kind = 'click'")
def view_by_index(spark, d):
    return _view(spark, d).by("by_kind", "click").select("key", "value")


@query(f"SELECT k AS index_key, key FROM {view_sql()}")
def index_key_collision(spark, d):
    """k is a number in some bodies and a string in others; both make the same index key."""
    return _view(spark, d).index("by_k")


@query(f"SELECT count(*) AS len FROM {view_sql()}")
def view_len(spark, d):
    return _view(spark, d).len()


@query(
    "WITH x AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) SELECT DISTINCT w AS index_key, p_partkey AS key FROM x WHERE w <> ''"
)
def view_multi_index(spark, d):
    log = table(spark, d, "part").withColumn("position", F.col("p_partkey"))
    view = TypedView(
        F.lit("put"), F.col("p_partkey"), F.col("p_name"),
        {"by_word": F.filter(F.split("value", " "), lambda w: w != "")},
    )
    return IndexedView(view, log).index("by_word")


@query(
    "WITH x AS (SELECT 1) SELECT c_name AS key, c_mktsegment AS segment FROM customer WHERE c_acctbal >= 0 AND c_mktsegment = 'BUILDING'"
)
def view_typed_delete(spark, d):
    """Customers in debt are deletes; index by market segment."""
    op = F.when(F.col("c_acctbal") < 0, "delete").otherwise("put")
    log = table(spark, d, "customer").withColumn("position", F.col("c_custkey"))
    view = IndexedView(TypedView(op, F.col("c_name"), F.col("c_mktsegment"), {"segment": F.array("value")}), log)
    return view.by("segment", "BUILDING").select("key", F.col("value").alias("segment"))


_HEX = "sha256('events' || chr(0) || branch_id || chr(0) || stream_name)"
_CLASS = "CAST(('0x' || " + " || ".join(
    f"substr({_HEX}, {2 * i + 1}, 2)" for i in reversed(range(8))
) + ")::UBIGINT % 4 AS INTEGER)"


@query(
    f"SELECT branch_id, stream_name, count(*) AS events, {_CLASS} AS class FROM log WHERE {_CLASS} IN (1, 2) GROUP BY 1, 2, 4"
)
def view_partition_class(spark, d):
    rows = read(spark, d, branch=None, streams=PartitionClass(4, [1, 2]))
    return rows.groupBy(
        "branch_id", "stream_name", partition_of(F.col("stream_id"), 4).alias("class"),
    ).agg(F.count("*").alias("events"))


# --- sessions --------------------------------------------------------------------------------------------------------


@query(f"""SELECT stream_name, CASE arg_max(event_type, position) FILTER (event_type IN ('signup', 'error')) WHEN 'signup' THEN 'Active' WHEN 'error' THEN 'Ended' ELSE 'NotStarted' END AS status,
    max(position) FILTER (event_type = 'signup') AS started, max(position) FILTER (event_type = 'error') AS ended, count(*) FILTER (event_type NOT IN ('signup', 'error')) AS entries FROM {seen('a')} GROUP BY 1""")
def session_status(spark, d):
    return session.status(session_events(read(spark, d, branch="a")))


@query(
    f"SELECT stream_name, position, event_type, row_number() OVER (PARTITION BY stream_name ORDER BY position) - 1 AS entry FROM {seen('a')} WHERE event_type IN ('view', 'click', 'purchase')"
)
def session_transcript(spark, d):
    return session.transcript(session_events(read(spark, d, branch="a"))).select(
        "stream_name", "position", "event_type", "entry",
    )


@query(
    f"SELECT stream_name, '' || k AS call_id, max(position) AS position FROM {seen('a')} WHERE event_type IN ('view', 'click') GROUP BY 1, 2 HAVING arg_max(event_type, position) = 'view'"
)
def pending_tool_calls(spark, d):
    return session.pending_calls(session_events(read(spark, d, branch="a")))


@query(f""", l AS (SELECT stream_name, row_number() OVER (PARTITION BY stream_name ORDER BY position) AS rn, position AS a FROM {seen('main')}),
    r AS (SELECT stream_name, row_number() OVER (PARTITION BY stream_name ORDER BY position) AS rn, position AS b FROM {seen('a')})
    SELECT stream_name, coalesce(min(rn) FILTER (a IS DISTINCT FROM b) - 1, max(rn)) AS shared, count(a) AS left_length, count(b) AS right_length FROM l FULL JOIN r USING (stream_name, rn) GROUP BY 1""")
def shared_prefix_len(spark, d):
    log, catalog, head = events_log(spark, d)
    left, right = (log.where(visible(catalog, b, head)) for b in ("main", "a"))
    return session.shared_prefix(left, right, "stream_name", "position")


# --- feed ------------------------------------------------------------------------------------------------------------

_BATCHES = "SELECT batch_id, min(position) AS first, max(position) AS last, count(*) AS events FROM log, n WHERE position >= n // 4 GROUP BY 1"


def _feed(spark, d, wanted=None):
    log, _, head = events_log(spark, d)
    return feed.batches(log, head // 4, head, wanted)


@query(_BATCHES)
def feed_batches(spark, d):
    return _feed(spark, d)


@query(_BATCHES + " HAVING bool_or(event_type = 'signup')")
def feed_filter_type(spark, d):
    return _feed(spark, d, feed.FeedFilter(types=["signup"]))


@query(_BATCHES + " HAVING bool_or(branch_id = 'a')")
def feed_filter_branch(spark, d):
    return _feed(spark, d, feed.FeedFilter(branches=["a"]))


@query(_BATCHES + " HAVING bool_or(stream_name IN ('user-1', 'user-3')) AND bool_or(event_type = 'click')")
def feed_filter_streams(spark, d):
    return _feed(spark, d, feed.FeedFilter(streams=["user-1", "user-3"], types=["click"]))


@query("SELECT l.position, l.batch_id FROM log l WHERE l.batch_id IN (SELECT batch_id FROM log WHERE branch_id = 'c')")
def feed_delivered(spark, d):
    log, _, head = events_log(spark, d)
    return feed.delivered(log, 0, head, feed.FeedFilter(branches=["c"])).select("position", "batch_id")


@query(
    "SELECT i AS consumer_id, i * n // 10 AS position, n - i * n // 10 AS lag, i * n // 10 < n // 3 AS behind_floor FROM n, (SELECT unnest(range(1, 11)) AS i)"
)
def consumer_lag(spark, d):
    _, head = _branches(spark, d)
    acked = spark.range(1, 11).select(
        F.col("id").alias("consumer_id"), F.floor(F.col("id") * head / 10).cast("long").alias("position"),
    )
    return feed.consumer_lag(acked, head, head // 3)


@query("SELECT position, stream_name FROM log, n WHERE position % 3 = 0 OR position >= n // 2")
def follower_ingest(spark, d):
    """A follower that has two thirds of the first half: what it has yet to take."""
    log, _, head = events_log(spark, d)
    source = log.withColumn("event_id", F.col("position"))
    follower = source.where((F.col("position") % 3 != 0) & (F.col("position") < head // 2))
    return feed.missing_events(source, follower).select("position", "stream_name")


# --- retention and import --------------------------------------------------------------------------------------------


@query(
    "SELECT n - least(1234, n) AS floor, count(*) AS kept FROM log, n WHERE position >= n - least(1234, n) GROUP BY 1"
)
def retention_keep_latest(spark, d):
    log, _, head = events_log(spark, d)
    floor = retention.latest_events_floor(head, 0, 1234)
    return log.where(F.col("position") >= floor).agg(F.count("*").alias("kept")).select(
        F.lit(floor).cast("long").alias("floor"), "kept",
    )


@query(
    "SELECT min(position) AS floor FROM log, (SELECT min(ts_nanos) AS lo, max(ts_nanos) AS hi FROM log) WHERE ts_nanos >= lo + (hi - lo) // 3"
)
def retention_keep_newer_than(spark, d):
    log, _, head = events_log(spark, d)
    lo, hi = log.agg(F.min("ts_nanos"), F.max("ts_nanos")).first()
    return spark.createDataFrame([(retention.newer_than_floor(log, lo + (hi - lo) // 3, head),)], "floor long")


@query(
    ", seg AS (SELECT position // 500 * 500 AS base, CAST(sum(length(body) + length(event_type)) AS BIGINT) AS bytes FROM log GROUP BY 1) SELECT base, bytes, CAST(sum(bytes) OVER (ORDER BY base DESC) AS BIGINT) AS suffix FROM seg"
)
def retention_target_bytes(spark, d):
    log, _, _ = events_log(spark, d)
    segments = log.groupBy(
        (F.floor(F.col("position") / 500) * 500).cast("long").alias("base")
    ).agg(F.sum(F.length("body") + F.length("event_type")).alias("bytes"))
    return retention.segment_suffixes(segments)


@query("SELECT id AS branch, fork_position FROM branches, n WHERE fork_position < n // 2")
def retention_blocked_branches(spark, d):
    catalog, head = _branches(spark, d)
    return catalog.frame(spark).where(F.col("fork_position") < head // 2).select(
        F.col("id").alias("branch"), "fork_position",
    )


@query(
    "SELECT position AS source, position - count(*) FILTER (event_type = 'error') OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS position, branch_id FROM log QUALIFY event_type <> 'error'"
)
def marker_import(spark, d):
    """An import that drops marker records (here: errors) and closes the gaps in the positions."""
    log, _, _ = events_log(spark, d)
    rows = folds.prefix_count(log.select("position", "event_type", "branch_id"), F.col("event_type") == "error")
    return rows.where("event_type <> 'error'").select(
        F.col("position").alias("source"), (F.col("position") - F.col("before")).alias("position"), "branch_id",
    )


# --- the store -------------------------------------------------------------------------------------------------------

from . import store_queries as _store  # noqa: E402

QUERIES |= _store.QUERIES
SQL |= _store.SQL
