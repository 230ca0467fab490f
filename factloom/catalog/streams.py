"""Change feeds (inventory L1-L3). The streaming queries drive the given files through a file stream to its end."""
from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F

from factloom.catalog.registry import query, table
from factloom.session import checkpoint_root
from factloom.streaming import feeds, state_log

_FOLD = """
SELECT user_id AS id, max(event_id) AS event_id FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) IN ('view', 'purchase', 'signup')"""


def _active():
    return F.col("event_type").isin("view", "purchase", "signup")


@query("l1_feed_fold", _FOLD)
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), "event_id", "event_type")
    return feeds.fold_feed(e, "id", ["event_id"], _active()).select("id", "event_id")


def drain(spark, sf, name, columns, write, label):
    """Run the file `name` through a stream into `write` until it is exhausted."""
    schema = table(spark, sf, name).schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf).select(*columns)
    offsets = f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    running = source.writeStream.foreachBatch(write).option("checkpointLocation", offsets).trigger(availableNow=True).start()
    running.awaitTermination()


def _folder(spark, label):
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def arriving(spark, parts, label):
    """A stream of the given tables, one batch each, in this order."""
    folder = _folder(spark, label)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files arrive in the order of their times
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _event_parts(spark, sf, n):
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), "event_id", "event_type")
    return [e.filter(F.col("event_id") % n == part) for part in range(n)]


@query("l1_stream_fold", _FOLD)
def _(spark, sf):
    """Six batches, a compaction after every third run of a level."""
    path = _folder(spark, "fold")
    source = arriving(spark, _event_parts(spark, sf, 6), "events")
    write = feeds.upsert_fold(path, "id", ["event_id"], buckets=8, fanout=3)
    source.writeStream.foreachBatch(write).option("checkpointLocation", _folder(spark, "fold-offsets")).trigger(availableNow=True).start().awaitTermination()
    return feeds.read_fold(spark, path, "id", ["event_id"]).filter(_active()).select("id", "event_id")


@query("l1_state_runs", """
SELECT 'run of batch ' || b AS run, n AS rows FROM (SELECT event_id % 5 AS b, count(DISTINCT user_id) AS n FROM events GROUP BY 1) WHERE b >= 3
UNION ALL SELECT 'merged to batch 2', count(DISTINCT user_id) FROM events WHERE event_id % 5 < 3""")
def _(spark, sf):
    """What is live after five batches with a repeated one: a batch's run holds its own keys and no more."""
    path = _folder(spark, "runs")
    for batch, part in enumerate(_event_parts(spark, sf, 5)):
        for _ in range(2 if batch == 3 else 1):
            state_log.append(part, batch, path, "id", ["event_id"], 4, 3)
    runs = [(f"merged to batch {r.batch}" if r.level else f"run of batch {r.batch}", r.rows) for r in state_log.live_runs(spark, path)]
    return spark.createDataFrame(runs, "run string, rows long")


@query("l2_feed_window", """
SELECT event_id, event_id // 100 >= 80 AS truncated FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY""")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("page_no", F.floor(F.col("event_id") / 100))
    return feeds.feed_window(e, "ts", F.lit("2024-01-31").cast("timestamp"), "page_no").select("event_id", "truncated")


@query("l2_stream_window", """
WITH m AS (SELECT max(ts) AS newest FROM events)
SELECT event_id, event_id // 100 >= 80 AS truncated, (SELECT count(*) FROM events, m WHERE ts <= newest - INTERVAL 20 DAY) AS late
FROM events, m WHERE ts > newest - INTERVAL 20 DAY""")
def _(spark, sf):
    """The newest day, twice, then all the rest: repeats are taken once, what is 20 days older is dropped and counted."""
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp"), F.floor(F.col("event_id") / 100).alias("page_no"))
    newest = e.agg(F.max("ts")).first()[0]
    rest = e.filter(F.col("ts") < F.lit(newest) - F.expr("INTERVAL 1 DAY"))
    recent = e.filter(F.col("ts") >= F.lit(newest) - F.expr("INTERVAL 1 DAY"))
    source = arriving(spark, [recent, recent, rest], "window")
    out = _folder(spark, "windowed")
    rows = feeds.stream_window(source, "ts", ["event_id"], "page_no", days=20, max_pages=80)
    running = rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", _folder(spark, "window-offsets")).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).select("event_id", "truncated", F.lit(feeds.late_rows(running)).cast("long").alias("late"))


@query("l3_stream_changes", """
WITH s AS (SELECT o_custkey, o_orderdate, max(o_orderstatus) AS s, max(o_orderpriority) AS q, count(*) AS n FROM orders GROUP BY ALL), u AS (SELECT * FROM s WHERE n = 1 AND o_custkey IN (SELECT o_custkey FROM s GROUP BY 1 HAVING max(n) = 1)),
p AS (SELECT *, lag(s) OVER w AS ps, lag(q) OVER w AS pq FROM u WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate))
SELECT o_custkey, o_orderdate, 'o_orderstatus' AS field, ps AS old, s AS new FROM p WHERE ps <> s UNION ALL SELECT o_custkey, o_orderdate, 'o_orderpriority', pq, q FROM p WHERE pq <> q""")
def _(spark, sf):
    root = checkpoint_root(spark).rstrip("/")
    state, changes = f"{root}/state-{uuid.uuid4().hex}", f"{root}/changes-{uuid.uuid4().hex}"
    columns = ["o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority"]
    drain(spark, sf, "orders", columns, feeds.snapshot_diff(state, changes, ["o_orderstatus", "o_orderpriority"], "o_custkey", "o_orderdate"), "diff-offsets")
    o = table(spark, sf, "orders").groupBy("o_custkey", "o_orderdate").agg(F.count(F.lit(1)).alias("n"))
    once = o.groupBy("o_custkey").agg(F.max("n").alias("n")).filter("n = 1").select("o_custkey")
    return spark.read.parquet(changes).drop("batch").join(once, "o_custkey", "left_semi")
