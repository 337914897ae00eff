"""Queries over logs on disk, through the engine's own calls, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import agent
from .engine import Database
from .engine import open as open_log
from .operators import session
from .plans.replay import ReplayPlan, StreamSet
from .sources import importer
from .sources.adapters import table
from .sources.store import LogStore
from .sources.work import work_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH n AS (SELECT count(*) AS n FROM events), {_EVENTS} {sql}"
        return f

    return put


_EVENTS = """log AS (SELECT event_id AS position, 'user-' || user_id AS stream_name, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS stream_revision,
    event_type, 'u' || user_id AS key, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""


def rows_of(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit('{"id":"u'), "user_id", F.lit('","kind":"'), "event_type", F.lit('"}'))
    return table(spark, d, "events").select(
        F.col("event_id").alias("ord"), F.concat(F.lit("user-"), "user_id").alias("stream_name"), "event_type",
        body.alias("body"),
    )


def opened(spark: SparkSession, d: str, name: str) -> Database:
    """The events table as a log on disk, in two commits, the first of a third of it."""
    db = open_log(work_path(spark, name), spark=spark)
    rows, head = rows_of(spark, d), table(spark, d, "events").count()
    db.store.append_frame(rows.where(F.col("ord") < head // 3))
    db.store.append_frame(rows.where(F.col("ord") >= head // 3))
    return db


@query("SELECT position, stream_name, stream_revision, event_type FROM log")
def store_round_trip(spark, d):
    """Bulk appends, then a replay of the whole log from its files."""
    with opened(spark, d, "round") as db:
        return db.frame(ReplayPlan(verify=True)).select("position", "stream_name", "stream_revision", "event_type")


@query(
    "SELECT position, stream_name, stream_revision, event_type FROM log WHERE position >= (SELECT count(*) // 2 FROM events) AND stream_name = 'user-3'"
)
def store_stream_window(spark, d):
    """One stream of a window: files and row groups outside it aren't read."""
    with opened(spark, d, "window") as db:
        return db.frame(
            ReplayPlan(start=db.head() // 2, streams=StreamSet(names=["user-3"]))
        ).select("position", "stream_name", "stream_revision", "event_type")


@query(""", line AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS position, l_partkey, l_orderkey FROM lineitem)
    SELECT position, 'part-' || l_partkey AS stream_name, row_number() OVER (PARTITION BY l_partkey ORDER BY position) - 1 AS stream_revision, l_orderkey AS orderkey FROM line""")
def store_bulk_load(spark, d):
    """The largest table as one commit: every row once, in order."""
    line = table(spark, d, "lineitem")
    body = F.to_json(F.struct(F.col("l_orderkey").alias("orderkey")))
    rows = line.select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ord"),
        F.concat(F.lit("part-"), "l_partkey").alias("stream_name"), F.lit("line").alias("event_type"),
        body.alias("body"),
    )
    with open_log(work_path(spark, "bulk"), spark=spark) as db:
        db.store.append_frame(rows)
        return db.frame(ReplayPlan()).select(
            "position", "stream_name", "stream_revision",
            F.get_json_object("body", "$.orderkey").cast("long").alias("orderkey"),
        )


@query(""", numbered AS (SELECT position, (row_number() OVER (ORDER BY position) - 1) // 16 AS page FROM log WHERE user_id = 3)
    SELECT CAST(page AS BIGINT) AS page, min(position) AS first, coalesce(lead(min(position)) OVER (ORDER BY page), (SELECT n FROM n)) AS continuation, count(*) AS events FROM numbered GROUP BY page""")
def store_reader_pages(spark, d):
    """A reader's pages of one stream, each from the files that hold it."""
    with opened(spark, d, "pages") as db:
        reader, pages, done = db.open_reader("user-3", page_events=16), [], False
        while not done:
            page = reader.next_page()
            done = page["done"]
            if page["records"]:
                pages.append((len(pages), page["records"][0]["offset"], page["continuation"], len(page["records"])))
        reader.close()
    return spark.createDataFrame(pages, "page long, first long, continuation long, events long")


@query(""", dealt AS (SELECT position, CASE WHEN position < n // 3 THEN 0 ELSE 1 END AS load, (position - CASE WHEN position < n // 3 THEN 0 ELSE n // 3 END) // 4096 AS part FROM log, n)
    SELECT min(position) AS first, max(position) AS last, count(*) AS events FROM dealt GROUP BY load, part""")
def store_watch_batches(spark, d):
    """The feed's whole batches, page by page; the last one is acknowledged."""
    with opened(spark, d, "watch") as db:
        watch, batches = db.watch(start=0, consumer_id="c", timeout=0, page_batches=3), []
        while page := watch.next_page():
            for i, r in enumerate(page):
                if not i or r["batch_id"] != page[i - 1]["batch_id"]:
                    batches.append([r["offset"], 0, 0])
                batches[-1][1:] = r["offset"], batches[-1][2] + 1
        assert watch.ack() == db.head() and db.watch(consumer_id="c", timeout=0).next_page() == []
        watch.close()
    return spark.createDataFrame(batches, "first long, last long, events long")


_USERS = "(SELECT 'u' || user_id AS key, arg_max(event_type, event_id) AS kind, max(event_id) AS position FROM events GROUP BY user_id)"


@query(f"""SELECT 'get' AS question, key, kind FROM {_USERS} WHERE key = 'u8' UNION ALL SELECT 'range', key, kind FROM {_USERS} WHERE key >= 'u11' AND key < 'u2'
    UNION ALL SELECT 'prefix', key, kind FROM {_USERS} WHERE starts_with(key, 'u1') UNION ALL SELECT 'by', key, kind FROM {_USERS} WHERE kind = 'click'
    UNION ALL SELECT 'len', '' || count(*), NULL FROM {_USERS}""")
def store_view_lookups(spark, d):
    """A registered view asked by key, range, prefix and index, from a snapshot in the middle of the log and what follows."""
    rows, half = rows_of(spark, d), table(spark, d, "events").count() // 2
    with open_log(work_path(spark, "lookups"), spark=spark) as db:
        db.store.append_frame(rows.where(F.col("ord") < half))
        db.register_view("users", "id", {"kind": "kind"})
        db.create_snapshot("users")
        db.store.append_frame(rows.where(F.col("ord") >= half))
        v = db.view("users")
        found = [
            ("get", [v.get("u8")]), ("range", v.range("u11", "u2")), ("prefix", v.prefix("u1")),
            ("by", v.by("kind", "click")),
        ]
        out = [(q, x["id"], x["kind"]) for q, xs in found for x in xs if x] + [("len", str(v.len()), None)]
    return spark.createDataFrame(out, "question string, key string, kind string")


@query(f"SELECT key, kind, position FROM {_USERS}")
def store_view_snapshot(spark, d):
    """A registered view, from a snapshot in the middle of the log and what follows it."""
    path = work_path(spark, "view")
    rows, half = rows_of(spark, d), table(spark, d, "events").count() // 2
    store = LogStore(spark, path)
    store.append_frame(rows.where(F.col("ord") < half))
    store.close()
    with open_log(path, spark=spark) as db:
        db.register_view("users", "id", {"kind": "kind"})
        made = db.create_snapshot("users")
        db.verify_snapshot(made["id"])
        db.store.append_frame(rows.where(F.col("ord") >= half))
        return db.indexed("users").rows.select("key", F.get_json_object("value", "$.kind").alias("kind"), "position")


@query("SELECT key, arg_max(event_type, position) AS kind FROM log, n WHERE position < 3 * n // 5 GROUP BY key")
def store_view_in_time(spark, d):
    """A view as it was at a position in the past."""
    with opened(spark, d, "time") as db:
        db.register_view("users", "id", {"kind": "kind"})
        return db.view_at("users", 3 * db.head() // 5).rows.select(
            "key", F.get_json_object("value", "$.kind").alias("kind"),
        )


_FORKED = "SELECT position, stream_name, 'main' AS branch FROM log, n WHERE position < n // 3 UNION ALL SELECT n + i, 'user-3', 'try' FROM n, (SELECT unnest(range(4)) AS i)"


def _forked(spark: SparkSession, d: str, name: str) -> Database:
    """A branch from the first commit's end, with four events of its own."""
    db = opened(spark, d, name)
    db.fork_branch("main", db.head() // 3, "try", {"why": b"test"})
    db.append_batch(
        "user-3", [{"body": {"id": f"x{i}"}} for i in range(4)], branch="try", expected_revision="no_stream",
    )
    db.commit()
    return db


@query(_FORKED)
def store_branch_replay(spark, d):
    """What a branch sees: its parent up to the fork, then its own events."""
    with _forked(spark, d, "fork") as db:
        at = db.branch("try").id
        rows = db.frame(ReplayPlan(at)).select(
            "position", "stream_name",
            F.when(F.col("branch_id") == at, "try").otherwise(F.col("branch_id")).alias("branch"),
        )
        assert db.branch_history("try", "user-3")[-1][
            "stream_revision"
        ] == 3 and db.branch_common_ancestor("try", "main")["name"] == "main"
        return rows


@query("""SELECT 'shared' AS side, count(*) AS events, min(position) AS first, max(position) AS last FROM log, n WHERE position < n // 3
    UNION ALL SELECT 'left', count(*), min(position), max(position) FROM log, n WHERE position >= n // 3 UNION ALL SELECT 'right', 4, n, n + 3 FROM n""")
def store_diff(spark, d):
    """Two timelines, through the readers that a diff gives."""
    with _forked(spark, d, "diff") as db:
        found, out = db.diff("main", "try", page_events=4096, page_bytes=16 << 20), []
        for side in ("shared", "left", "right"):
            events, first, last, done = 0, None, None, False
            while not done:
                page = found[side].next_page()
                done = page["done"]
                if page["records"]:
                    first = page["records"][0]["offset"] if first is None else first
                    events, last = events + len(page["records"]), page["records"][-1]["offset"]
            found[side].close()
            out.append((side, events, first, last))
    return spark.createDataFrame(out, "side string, events long, first long, last long")


@query(
    "SELECT CAST(k AS VARCHAR) AS key, CAST(arg_max(user_id, position) AS VARCHAR) AS value, max(position) AS position FROM log GROUP BY k HAVING arg_max(event_type, position) <> 'error'"
)
def store_key_values(spark, d):
    """Put and Delete events of all streams, folded through the agent's vocabulary."""
    events = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    put = F.to_json(F.struct(F.lit("Put").alias("kind"), F.col("k").alias("key"), F.col("user_id").alias("value")))
    body = F.when(
        F.col("event_type") == "error", F.to_json(F.struct(F.lit("Delete").alias("kind"), F.col("k").alias("key"))),
    ).otherwise(put)
    with open_log(work_path(spark, "kv"), spark=spark) as db:
        db.store.append_frame(
            events.select(
                F.col("event_id").alias("ord"), F.concat(F.lit("user-"), "user_id").alias("stream_name"),
                F.lit("agent").alias("event_type"), body.alias("body"),
            )
        )
        return agent.kv_view(db)


@query("""SELECT 'conv-' || conv_id AS stream_name, CASE WHEN bool_or(role = 'system') THEN 'Active' ELSE 'NotStarted' END AS status,
    count(*) FILTER (role <> 'system') AS entries, count(DISTINCT turn) FILTER (role = 'user') - count(DISTINCT turn) FILTER (role = 'assistant' AND turn - 1 IN (SELECT turn FROM conversations c WHERE c.conv_id = conversations.conv_id AND role = 'user')) AS pending
    FROM conversations GROUP BY conv_id""")
def store_sessions(spark, d):
    """Sessions of all conversations: system turns start them, user turns are calls, assistant turns their results."""
    turns = table(spark, d, "conversations")
    call = F.when(F.col("role") == "assistant", F.col("turn") - 1).otherwise(F.col("turn")).cast("string")
    kind = F.when(
        F.col("role") == "system", "SessionStarted",
    ).when(F.col("role") == "user", "ToolCall").otherwise("ToolResult")
    body = F.to_json(F.struct(kind.alias("kind"), F.when(F.col("role") != "system", call).alias("call_id")))
    rows = turns.select(
        F.struct("conv_id", "turn", "role", "text").alias("ord"),
        F.concat(F.lit("conv-"), "conv_id").alias("stream_name"), F.lit("agent").alias("event_type"),
        body.alias("body"),
    )
    with open_log(work_path(spark, "sessions"), spark=spark) as db:
        db.store.append_frame(rows)
        events = agent.events(db)
        pending = session.pending_calls(events).groupBy("stream_name").agg(F.count("*").alias("pending"))
        return session.status(events).join(pending, "stream_name", "left").select(
            "stream_name", "status", "entries", F.coalesce("pending", F.lit(0)).alias("pending"),
        )


@query(
    "SELECT n // 3 AS floor, count(*) AS events, min(position) AS first, 0 AS faults FROM log, n WHERE position >= n // 3 GROUP BY 1"
)
def store_retention(spark, d):
    """History below a position is given up, with an anchor: what is left is whole, revisions go on."""
    with opened(spark, d, "retention") as db:
        keep = db.head() // 3
        db.create_retention_anchor(keep)
        db.apply_retention(db.plan_retention(keep)["plan_id"])
        before = db.store.revision("main", "user-3")
        assert db.append_batch("user-3", [{"body": 1}])["current_revision"] == before + 1
        log = db.store.log(True)
        faults = db.store.verify()
        return log.agg(F.count("*").alias("events"), F.min("position").alias("first")).select(
            F.lit(db.retention_floor()).cast("long").alias("floor"), "events", "first",
            F.lit(sum(faults.values()) - faults["events"]).cast("int").alias("faults"),
        )


@query("""SELECT r_name AS stream_name, (min(p) OVER (PARTITION BY r_regionkey)) AS first_position, (max(p) OVER (PARTITION BY r_regionkey)) AS last_position, p AS position, row_number() OVER (PARTITION BY r_regionkey ORDER BY p) - 1 AS revision, n_name AS nation
    FROM (SELECT *, row_number() OVER (ORDER BY r_regionkey, n_nationkey) - 1 AS p FROM nation JOIN region ON n_regionkey = r_regionkey)""")
def store_append(spark, d):
    """A batch for each region's nations, each sent twice with one key: receipts are the same, events are there once."""
    nations = table(spark, d, "nation").join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"),
    ).orderBy("r_regionkey", "n_nationkey").select("r_name", "n_name").collect()
    with open_log(work_path(spark, "append"), commit_every_count=10, spark=spark) as db:
        receipts = []
        for region in dict.fromkeys(r["r_name"] for r in nations):
            batch = [{"body": {"nation": r["n_name"]}} for r in nations if r["r_name"] == region]
            sent = [
                db.append_batch(region, batch, expected_revision="no_stream", idempotency_key=region) for _ in range(2)
            ]
            assert {
                k: v for k, v in sent[0].items() if k != "durability"
            } == {k: v for k, v in sent[1].items() if k != "durability"}
            receipts.append((region, sent[0]["first_position"], sent[0]["last_position"]))
        db.commit()
        log = db.frame(ReplayPlan()).select(
            "stream_name", "position", F.col("stream_revision").alias("revision"),
            F.get_json_object("body", "$.nation").alias("nation"),
        )
    return log.join(
        spark.createDataFrame(receipts, "stream_name string, first_position long, last_position long"), "stream_name",
    )


@query("SELECT position, stream_name, event_type FROM log")
def store_import(spark, d):
    """An import of an older log in one entry, verified, and run again without effect."""
    source = rows_of(spark, d).select(
        F.col("ord").alias("offset"), F.col("stream_name").alias("namespace"), "event_type", "body",
    )
    path = work_path(spark, "import")
    store = LogStore(spark, path)
    report = importer.run(store, source)
    importer.verify(store, source)
    assert importer.run(store, source) == report and report.skipped == 0
    out = store.log(True).select("position", "stream_name", "event_type")
    store.close()
    return out


@query(
    ", x AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS p FROM nation) SELECT p AS position, 'nation' AS stream_name, p AS revision, n_name AS name FROM x"
)
def store_replica(spark, d):
    """A follower that takes another log's batches from its feed, some of them twice."""
    names = [r["n_name"] for r in table(spark, d, "nation").orderBy("n_nationkey").collect()]
    with open_log(work_path(spark, "leader"), spark=spark) as db, open_log(
        work_path(spark, "follower"), spark=spark,
    ) as other:
        for at in range(0, len(names), 4):
            db.append_batch("nation", [{"body": n} for n in names[at : at + 4]])
        db.commit()
        watch = db.watch(start=0, timeout=0, page_batches=1)
        while page := watch.next_page():
            for _ in range(2):
                other.ingest_batch(page)
        watch.close()
        return other.frame(ReplayPlan()).select(
            "position", "stream_name", F.col("stream_revision").alias("revision"),
            F.regexp_replace("body", '"', "").alias("name"),
        )


@query("SELECT count(DISTINCT user_id) AS keys, 4 AS classes FROM log")
def store_partitioned_view(spark, d):
    """A view in hash classes of streams, one of them from a snapshot of its own: together they hold every key once."""
    with opened(spark, d, "classes") as db:
        db.register_view("users", "id", partitions=4)
        db.create_snapshot("users", 2)
        sizes = [db.query_partitions("users", [k]).len().first()["len"] for k in range(4)]
        assert db.query_partitions("users", [0, 1, 2, 3]).len().first()["len"] == sum(sizes)
    return spark.createDataFrame([(sum(sizes), len(sizes))], "keys long, classes int")


@query("SELECT 1 AS files, count(*) AS events, 0 AS faults FROM nation")
def store_compaction(spark, d):
    """Many small commits joined to one file; what no manifest entry names is deleted."""
    names = [r["n_name"] for r in table(spark, d, "nation").orderBy("n_nationkey").collect()]
    with open_log(work_path(spark, "compact"), commit_every_count=1, spark=spark) as db:
        for n in names:
            db.append("nation", n)
        db.store.compact()
        db.store.vacuum()
        found = db.store.verify()
        out = [(len(db.store.state.files), found["events"], sum(found.values()) - found["events"])]
    return spark.createDataFrame(out, "files int, events long, faults int")


@query(
    "SELECT n // 3 AS position, n - n // 3 AS lag, count(*) AS rest FROM log, n WHERE position >= n // 3 GROUP BY 1, 2"
)
def store_consumer(spark, d):
    """A consumer acknowledges the first commit, and goes on from there after the log was opened again."""
    with opened(spark, d, "consumer") as db:
        path, third = db.store.path, db.head() // 3
        watch = db.watch(start=0, consumer_id="c", timeout=0, page_batches=1, page_bytes=16 << 20)
        while watch.position < third:
            watch.next_page()
        at = watch.ack()
        watch.close()
    with open_log(path, spark=spark) as db:
        watch, rest = db.watch(consumer_id="c", timeout=0), 0
        while page := watch.next_page():
            rest += len(page)
        watch.close()
        return spark.createDataFrame([(at, db.head() - at, rest)], "position long, lag long, rest long")
