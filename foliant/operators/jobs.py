"""Views over job states, batches and queues: DataFrame -> DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.text import strip
from foliant.operators.runs import group_bounds, let_through

TERMINAL = ("completed", "failed", "cancelled")
ACTIVE = ("queued", "processing", "paused")
# Of pages done every third is told, and another after 1.5 seconds.
EVERY_PAGES, QUIET_SECONDS = 3, 1.5
# What a user may do in which state, and what becomes of it.
TRANSITIONS = {("pause", "processing"): "paused", ("pause", "queued"): "paused", ("resume", "paused"): "queued",
               ("cancel", "queued"): "cancelled", ("cancel", "processing"): "cancelled", ("cancel", "paused"): "cancelled"}


def latest_states(events: DataFrame, key: str, time: str, tiebreak: str) -> DataFrame:
    """The last row of each key by (time, tiebreak)."""
    names = [c for c in events.columns if c != key]
    last = F.max_by(F.struct(*names), F.struct(time, tiebreak))
    return events.groupBy(key).agg(last.alias("s")).select(key, "s.*")


def state_time(updated: Column, created: Column) -> Column:
    """The time of a state from ISO texts: updated, else created; null if malformed."""
    return F.try_to_timestamp(F.regexp_replace(F.coalesce(F.nullif(updated, F.lit("")), created), "Z$", "+00:00"))


def sync_batches(batches: DataFrame, parts: DataFrame, states: DataFrame) -> DataFrame:
    """Batches (batch_id, total_pages) with what their parts (batch_id, job_id, page_from, page_to, status) have come to.

    A state (job_id, status) overrides a part's own status. A batch is ready to merge when every part is completed.
    """
    known = parts.join(states.select("job_id", F.col("status").alias("_now")), "job_id", "left").withColumn("status", F.coalesce("_now", "status"))
    joined = batches.select("batch_id", "total_pages").join(known.drop("_now"), "batch_id", "left")
    done = F.col("status") == "completed"
    whole = done & (F.col("page_from") == 1) & (F.col("page_to") >= F.col("total_pages"))
    out = joined.groupBy("batch_id", "total_pages").agg(
        F.count_if(done).alias("parts_completed"), F.count("job_id").alias("parts_total"),
        F.min_by("job_id", F.when(whole, F.struct("page_from", "page_to", "job_id"))).alias("full_job"), F.count_if(whole).alias("fulls"),
    )
    return out.select(
        "batch_id", "parts_completed", "parts_total", ((F.col("parts_completed") > 0) & (F.col("parts_completed") == F.col("parts_total"))).alias("merge_ready"),
        (F.col("fulls") > 0).alias("full_document_ready"), F.when(F.col("fulls") > 0, F.col("full_job")).alias("full_document_job_id"),
    )


def merge_batches(batches: DataFrame, parts: DataFrame, outputs: DataFrame) -> DataFrame:
    """Completed parts' outputs (job_id, markdown) under a title, in order of page_from; batches without any have no row."""
    done = parts.where("status = 'completed'").join(outputs, "job_id").groupBy("batch_id").agg(
        F.sort_array(F.collect_list(F.struct("page_from", "page_to", "job_id", strip(F.col("markdown")).alias("m")))).alias("ps")
    )
    stem = F.regexp_replace(F.col("source_filename"), r"\.[^.]+$", "")
    head = F.concat(F.lit("# "), stem, F.lit("\n\n\n> Documento completo por partes — "), F.col("total_pages").cast("string"), F.lit(" páginas en el PDF original.\n"))
    body = F.array_join(F.transform("ps", lambda p: F.concat(F.lit("\n\n\n---\n\n## Parte: páginas "), p["page_from"].cast("string"), F.lit("–"), p["page_to"].cast("string"), F.lit("\n\n\n"), p["m"])), "\n")
    return batches.join(done, "batch_id").select("batch_id", F.concat(F.rtrim(F.concat(head, F.lit("\n"), body)), F.lit("\n")).alias("markdown"))


def zip_manifest(batches: DataFrame, parts: DataFrame) -> DataFrame:
    """Names in a batch's archive: batch_id, job_id, arcname, for .md and .txt of completed parts."""
    stem = F.regexp_replace(F.col("source_filename"), r"\.[^.]+$", "")
    rows = batches.join(parts.where("status = 'completed'"), "batch_id").withColumn("ext", F.explode(F.array(F.lit(".md"), F.lit(".txt"))))
    return rows.select("batch_id", "job_id", F.concat(stem, F.lit("_p"), "page_from", F.lit("-"), "page_to", "ext").alias("arcname"))


def replace_parts(parts: DataFrame, order: str) -> DataFrame:
    """Of parts with one batch and range, the last added; in order of range."""
    last = Window.partitionBy("batch_id", "page_from", "page_to").orderBy(F.desc(order))
    kept = parts.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("batch_id").orderBy("page_from", "page_to")))


def history(saved: DataFrame, states: DataFrame, most: int = 30) -> DataFrame:
    """The newest completed jobs: saved ones (job_id, completed_at), and terminal states not among them."""
    fresh = states.where(F.col("status").isin(*TERMINAL)).join(saved.select("job_id"), "job_id", "left_anti").select("job_id", F.col("updated_at").alias("completed_at"))
    return saved.select("job_id", "completed_at").union(fresh).orderBy(F.desc("completed_at"), "job_id").limit(most)


def queue_positions(states: DataFrame, job: str, enqueued: str) -> DataFrame:
    """Positions of waiting jobs in order of arrival, from 1, or from 2 while a job runs: job, position.

    Jobs are numbered by day of arrival, and days add up, so that no window holds the whole queue.
    """
    waiting = states.where(F.col("status").isin("queued", "paused")).withColumn("_day", F.to_date(enqueued))
    days = waiting.groupBy("_day").agg(F.count("*").alias("_c"))
    earlier = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select("_day", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))  # a row a day
    running = states.agg((F.count_if(F.col("status") == "processing") > 0).cast("int").alias("_busy"))
    inside = F.row_number().over(Window.partitionBy("_day").orderBy(enqueued, job))
    numbered = waiting.withColumn("_n", inside).join(before, "_day").crossJoin(F.broadcast(running))
    return numbered.select(job, (F.col("_n") + F.col("_before") + F.col("_busy")).alias("position"))


def active_jobs(states: DataFrame, positions: DataFrame) -> DataFrame:
    """Running jobs (position 0), then queued and paused ones by position: job_id, status, position, is_active."""
    live = states.where(F.col("status").isin(*ACTIVE)).join(positions, "job_id", "left")
    position = F.when(F.col("status") == "processing", 0).otherwise(F.coalesce("position", F.lit(99)))
    return live.select("job_id", "status", position.alias("position"), (F.col("status") == "processing").alias("is_active"))


def reconcile(status: Column, idle_minutes: Column, in_memory: Column, has_upload: Column) -> Column:
    """What becomes of a job after a restart: its new status, `requeued`, or its own status."""
    live = status.isin(*ACTIVE)
    idle = F.coalesce(idle_minutes, F.lit(9999.0))
    return (
        F.when(live & ~has_upload, "cancelled").when((status == "processing") & ~in_memory & (idle > 8), "failed")
        .when(status.isin("queued", "paused") & ~in_memory & (idle > 180), "cancelled").when(status.isin("queued", "paused") & ~in_memory, "requeued").otherwise(status)
    )


def transition(action: Column, status: Column) -> Column:
    """The state that an action leads to, null if it is not allowed."""
    out = F.lit(None).cast("string")
    for (a, s), to in TRANSITIONS.items():
        out = F.when((action == a) & (status == s), to).otherwise(out)
    return out


def open_circuits(errors: DataFrame, calls: DataFrame, provider: str, time: str, cooldown: int = 300) -> DataFrame:
    """calls with `disabled`: whether the provider had a quota error within the cooldown before (as of the call).

    Time is cut into buckets as long as the cooldown, so that only errors of a call's own bucket and the one before can
    count: windows run inside a provider's bucket, to which the last error of the bucket before is carried.
    """
    t = F.col(time)
    if dict(calls.dtypes)[time] == "timestamp_ntz":
        seconds = F.unix_date(t.cast("date")).cast("long") * 86_400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    else:
        seconds = F.unix_seconds(t)
    bucket = F.floor(seconds / F.lit(max(1, cooldown))).cast("long").alias("_bucket")
    failed = errors.select(provider, time, bucket)
    carried = failed.groupBy(provider, (F.col("_bucket") + 1).alias("_bucket")).agg(F.max(time).alias(time))
    asked = calls.select(provider, time, bucket, F.lit(1).alias("_call"), *[c for c in calls.columns if c not in (provider, time)])
    both = asked.unionByName(failed.unionByName(carried).withColumn("_call", F.lit(0)), allowMissingColumns=True)
    window = Window.partitionBy(provider, "_bucket").orderBy(time, "_call").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.max(F.when(F.col("_call") == 0, F.col(time))).over(window)).where("_call = 1")
    open_ = F.coalesce(F.col("_last") + F.make_dt_interval(secs=F.lit(cooldown)) > F.col(time), F.lit(False))
    return seen.withColumn("disabled", open_).drop("_call", "_last", "_bucket")


def throttled(events: DataFrame, key: str, time: str, tiebreak: str, seconds: float = 1.5) -> DataFrame:
    """Events of each key that come `seconds` or more after the last one that was let through.

    A fold, no window: rows stream in order of key and time, and only the last key and time are held. Rows without a
    time are not let through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, 0
        for batch in batches:
            if not len(batch):
                continue
            codes, times = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(), batch.column(2).to_numpy()
            bounds = group_bounds(codes)
            goes_on = now is not None and batch.column(0)[0].as_py() == now[0]
            go = let_through(bounds, times, step, last if goes_on else None)
            own = np.nonzero(go[bounds[-2] :])[0]
            if len(own):
                last = int(times[bounds[-2] + own[-1]])
            now = (batch.column(0)[len(batch) - 1].as_py(),)
            yield batch.select([0, 1]).filter(pa.array(go))

    step, kinds = round(seconds * 1_000_000), dict(events.dtypes)
    micros = F.unix_micros(F.col(time).cast("timestamp")) if kinds[time].startswith("timestamp") else F.round(F.col(time) * 1_000_000).cast("long")
    rows = events.where(F.col(time).isNotNull()).select(key, tiebreak, micros.alias("_t"))
    rows = rows.repartition(key).sortWithinPartitions(key, "_t", tiebreak)
    return rows.mapInArrow(run, f"`{key}` {kinds[key]}, `{tiebreak}` {kinds[tiebreak]}")


def percent(page: Column, total: Column) -> Column:
    """Whole per cent of the pages done, from 0 to 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(page * 100 / total))).cast("int")


def told_pages(events: DataFrame, job: str, time: str, row: str, page: str, total: str) -> DataFrame:
    """job, row, page, total, progress: the pages of a job that are told: every third one, and of the others such as come 1.5
    seconds or more after the last of those that was told. Rows without a page or a total above 0 tell nothing."""
    known = events.where((F.col(total) > 0) & F.col(page).isNotNull() & F.col(time).isNotNull())
    third = F.col(page) % EVERY_PAGES == 0
    quiet = throttled(known.where(~third), job, time, row, QUIET_SECONDS)
    told = known.where(third).select(job, row).union(quiet.select(job, row))
    return known.join(told, [job, row], "left_semi").select(F.col(job).alias("job"), F.col(row).alias("row"), F.col(page).alias("page"), F.col(total).alias("total"), percent(F.col(page), F.col(total)).alias("progress"))


def page_plan(pages: DataFrame, readings: DataFrame, tables: DataFrame, key: list[str]) -> DataFrame:
    """Pages (key, route, markdown) with a reading (key, text) where they need one, and tables (key, table) after it."""
    joined = pages.join(readings, key, "left").join(tables, key, "left")
    text = F.when(F.col("route") == "digital", F.col("markdown")).when(F.col("route") == "both", F.concat_ws("\n\n", F.col("markdown"), F.col("text"))).otherwise(F.coalesce("text", "markdown"))
    return joined.select(*key, "route", F.concat_ws("\n\n", text, F.col("table")).alias("markdown"))
