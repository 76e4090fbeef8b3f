"""Streams over the events table, with their DuckDB SQL: what they give when they have read all there is."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from foliant.plans.control_queries import KEPT
from foliant.plans.queries import STATES, STATUS, query, table
from foliant.sources.folders import session_folder
from foliant.streaming import circuits, progress, queue


def _events(spark, sf_dir, folder, beat=False):
    """The events as a stream. With beat, a row without ids comes a day after the last of them, in a file of its own."""
    events = table(spark, sf_dir, "events")
    path = f"{sf_dir}/events.parquet"
    source = spark.readStream.schema(events.schema).parquet(path if os.path.isdir(path) else f"{path}*")
    if beat:
        none = {c: F.lit(None).cast(t) for c, t in events.dtypes if c != "ts"}
        events.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).withColumns(none).select(events.columns).write.parquet(f"{folder}/beat")
        source = source.union(spark.readStream.schema(events.schema).parquet(f"{folder}/beat"))
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark):
    queue.rocksdb(spark)
    return session_folder(spark, "stream")


def _all(spark, out, folder):
    """The rows of a stream, written batch by batch to a log and read when the stream has read all there is."""
    sink = out.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    sink.foreachBatch(progress.log_writer(f"{folder}/log")).start().awaitTermination()
    return progress.read_log(spark, f"{folder}/log").select(out.columns)


QUEUES = """
WITH RECURSIVE e AS (SELECT (user_id % 16) * 4 + s AS queue, s, user_id AS job, event_id AS row, CASE WHEN event_type IN ('signup', 'view') THEN 'ask' WHEN event_type = 'click' THEN 'yield' ELSE 'leave' END AS command,
    row_number() OVER (PARTITION BY user_id % 16, s ORDER BY ts, event_id) AS k FROM events, (VALUES (1), (2), (3)) v(s)),
r AS (SELECT queue, s, 0::BIGINT AS k, NULL::BIGINT AS row, []::BIGINT[] AS waiting, []::BIGINT[] AS busy, []::BIGINT[] AS started FROM (SELECT DISTINCT queue, s FROM e)
  UNION ALL
  SELECT queue, s, k, row, waiting[n + 1:], list_concat(busy, waiting[1:n]), waiting[1:n] FROM (
    SELECT *, greatest(0, least(len(waiting), s - len(busy))) AS n FROM (
      SELECT e.queue, e.s, e.k, e.row,
        CASE command WHEN 'ask' THEN CASE WHEN list_contains(busy, job) OR list_contains(waiting, job) THEN waiting ELSE list_append(waiting, job) END WHEN 'leave' THEN list_filter(waiting, lambda x: x <> job) ELSE waiting END AS waiting,
        CASE WHEN command = 'ask' THEN busy ELSE list_filter(busy, lambda x: x <> job) END AS busy
      FROM r JOIN e ON e.queue = r.queue AND e.k = r.k + 1)))
SELECT queue, row, unnest(started) AS job FROM r WHERE len(started) > 0
"""


@query(QUEUES)
def stream_slots(spark, sf_dir):
    """Queues of one, two and three slots over the same events."""
    folder = _folder(spark)
    command = F.when(F.col("event_type").isin("signup", "view"), queue.ASK).when(F.col("event_type") == "click", queue.YIELD).otherwise(queue.LEAVE)
    e = _events(spark, sf_dir, folder).withColumns({"command": command, "slots": F.explode(F.array(*map(F.lit, (1, 2, 3))))})
    e = e.withColumn("queue", F.col("user_id") % 16 * 4 + F.col("slots"))
    return _all(spark, queue.slots(e, "queue", "user_id", "ts", "event_id", "command", F.col("slots"), "0 seconds"), folder)


@query(STATES + KEPT.replace("WHERE job_id % 3 = 0 OR status <> 'processing'", "") + "SELECT job_id, outcome, expired, stuck FROM k")
def stream_time_outs(spark, sf_dir):
    """What the timers have told of every job by the time of the last event; stuck ones wait while no job runs."""
    folder = _folder(spark)
    status = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.col("event_type"))
    e = _events(spark, sf_dir, folder).withColumn("status", status)
    told = _all(spark, queue.time_outs(e, "user_id", "ts", "event_id", "status", F.col("user_id") % 5 == 0, F.col("user_id") % 7 != 0, "0 seconds"), folder)
    last = told.groupBy("job").agg(F.max_by(F.struct("status", "outcome", "expired", "waited"), F.struct("at", "row")).alias("s")).select(F.col("job").alias("job_id"), "s.*")
    busy = last.agg((F.count_if(F.col("status") == "processing") > 0).alias("busy"))  # one row
    return last.crossJoin(F.broadcast(busy)).select("job_id", "outcome", "expired", (F.col("waited") & ~F.col("busy")).alias("stuck"))


@query("""
WITH RECURSIVE p AS (SELECT user_id AS job, event_id AS row, (event_id % 17)::BIGINT AS page, (event_id % 23)::BIGINT AS total, epoch_us(ts) // 60000 AS t FROM events WHERE event_id % 23 > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY t, row) AS k FROM p WHERE page % 3 > 0),
r AS (SELECT job, row, k, t AS last, true AS go FROM o WHERE k = 1 UNION ALL SELECT o.job, o.row, o.k, CASE WHEN o.t - r.last >= 1500000 THEN o.t ELSE r.last END, o.t - r.last >= 1500000 FROM r JOIN o ON o.job = r.job AND o.k = r.k + 1)
SELECT job, row, page, total, greatest(0, least(100, floor(page * 100 / total)))::INT AS progress FROM p WHERE page % 3 = 0 OR row IN (SELECT row FROM r WHERE go)
""")
def stream_told_pages(spark, sf_dir):
    """Progress of jobs whose hours are milliseconds' worth of pages: a minute of the events is a millisecond."""
    folder = _folder(spark)
    e = _events(spark, sf_dir, folder).withColumns({"ts": F.timestamp_micros(F.floor(F.unix_micros("ts") / 60_000)), "page": F.col("event_id") % 17, "total": F.col("event_id") % 23})
    return _all(spark, progress.told_pages(e, "user_id", "ts", "event_id", "page", "total", "0 seconds"), folder)


@query("""
WITH c AS (SELECT event_id, event_type AS provider, ts FROM events WHERE event_type <> 'error'), e AS (SELECT CASE user_id % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'signup' ELSE 'purchase' END AS provider, ts FROM events WHERE event_type = 'error')
SELECT event_id, EXISTS (SELECT 1 FROM e WHERE e.provider = c.provider AND e.ts <= c.ts AND e.ts + INTERVAL 300 SECOND > c.ts) AS disabled FROM c
""")
def stream_open_circuits(spark, sf_dir):
    folder = _folder(spark)
    names = F.element_at(F.array(*map(F.lit, ("click", "view", "signup", "purchase"))), (F.col("user_id") % 4 + 1).cast("int"))
    side = lambda c: _events(spark, sf_dir, f"{folder}/{c}", True).where(f"event_id IS NULL OR event_type {c} 'error'".replace("is", "=").replace("not", "<>"))
    errors, calls = side("is").select(names.alias("provider"), "ts"), side("not").select(F.col("event_type").alias("provider"), "ts", "event_id")
    return _all(spark, circuits.open_circuits(errors, calls, "provider", "ts", "event_id", late="0 seconds"), folder)
