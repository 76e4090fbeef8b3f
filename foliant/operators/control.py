"""Control of jobs: life cycle, housekeeping, listings and lookups: DataFrame -> DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.predicates import normalize_mode
from foliant.functions.text import strip, whole
from foliant.operators.jobs import ACTIVE, TERMINAL, reconcile

# Commands, the states in which each is allowed (None: a job not seen yet), and the state it leads to.
COMMANDS = {
    "enqueue": ((None, *TERMINAL), "queued"), "start": (("queued",), "processing"), "pause": (("queued", "processing"), "paused"), "resume": (("paused",), "queued"),
    "complete": (("processing",), "completed"), "fail": (("processing",), "failed"), "cancel": (ACTIVE, "cancelled"),
}
# Resolution and least edge of a page image by mode; those of documents of 50 pages or more.
DPI, EDGE = {"fast": 200, "balanced": 220, "quality": 320}, {"fast": 1200, "balanced": 1200, "quality": 1800}
LARGE_PAGES, LARGE_DPI, LARGE_EDGE, FAST_RANGE = 50, 220, 1400, 35


def advance(state: str | None, command: str) -> str | None:
    """The state after a command, None where it is not allowed."""
    allowed, to = COMMANDS.get(command, ((), None))
    return to if state in allowed else None


def lifecycle(events: DataFrame, key: str, time: str, tiebreak: str, command: str) -> DataFrame:
    """key, tiebreak, state: the commands that were allowed, in order of time, and the state that each led to.

    Rows stream in order of key and time, and only one key's state is held. Rows without a time or a key are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            after = []
            for k, c in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != now:
                    now, state = k, None
                after.append(advance(state, c))
                state = after[-1] or state
            states = pa.array(after, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), states], names=[key, tiebreak, "state"]).filter(states.is_valid())

    kinds = dict(events.dtypes)
    rows = events.where(F.col(time).isNotNull() & F.col(key).isNotNull())
    rows = rows.repartition(key).sortWithinPartitions(key, time, tiebreak).select(key, tiebreak, command)
    return rows.mapInArrow(run, f"`{key}` {kinds[key]}, `{tiebreak}` {kinds[tiebreak]}, state string")


def public_summary(states: DataFrame) -> DataFrame:
    """What a user sees of states (job_id, status, progress, detail, pages_done, pages_total, queue_position)."""
    place = F.when(F.col("status").isin("processing", "paused"), 0).otherwise(1)
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("progress", "pages_done", "pages_total")]
    return states.select("job_id", F.coalesce("status", F.lit("")).alias("status"), F.coalesce("detail", F.lit("")).alias("detail"), *numbers, F.coalesce("queue_position", place).alias("queue_position"))


def history_label(filename: Column, job_id: Column, status: Column, page_from: Column, page_to: Column) -> Column:
    """A finished job's name: its file, with the pages of a part that was completed."""
    name = F.coalesce(F.nullif(filename, F.lit("")), job_id)
    part = (status == "completed") & (page_from > 0) & (page_to > 0) & ~name.endswith(")")
    return F.when(F.coalesce(part, F.lit(False)), F.concat(name, F.lit(" ("), page_from.cast("string"), F.lit("-"), page_to.cast("string"), F.lit(")"))).otherwise(name)


def append_history(saved: DataFrame, entry: DataFrame, most: int = 30) -> DataFrame:
    """saved (job_id, completed_at, position from 0) with new entries (the same columns) before them, each job once, the
    last entry of a job counting; the first 30."""
    both = entry.withColumn("_old", F.lit(0)).unionByName(saved.withColumn("_old", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("job_id").orderBy("_old", "position"))
    kept = both.withColumn("_n", first).where("_n = 1").orderBy("_old", "position").limit(most)
    return kept.select("job_id", "completed_at", (F.row_number().over(Window.orderBy("_old", "position")) - 1).alias("position"))  # 30 rows


def missing_uploads(states: DataFrame, files: DataFrame) -> DataFrame:
    """States (upload_path) whose upload is not among the files (path), or that name none."""
    path = strip(whole(F.col("upload_path")))
    return states.withColumn("_p", path).join(files.select(F.col("path").alias("_p")).where("_p <> ''").distinct(), "_p", "left_anti").drop("_p")


def housekeeping(states: DataFrame, now: Column, ttl_hours: float = 48, stuck_seconds: float = 20) -> DataFrame:
    """states (job_id, status, updated_at, in_memory, has_upload) with outcome, expired (older than 48 hours) and stuck (a
    waiting job that is idle for over 20 seconds while none runs)."""
    seconds = (F.unix_micros(now) - F.unix_micros("updated_at")) / 1_000_000
    busy = states.agg((F.count_if(F.col("status") == "processing") > 0).alias("_busy"))
    known = states.crossJoin(F.broadcast(busy))  # one row
    stuck = F.col("status").isin("queued", "paused") & F.col("in_memory") & ~F.col("_busy") & (F.coalesce(seconds, F.lit(9999.0)) > stuck_seconds)
    return known.withColumns({
        "outcome": reconcile(F.col("status"), seconds / 60, F.col("in_memory"), F.col("has_upload")), "expired": F.coalesce(seconds > ttl_hours * 3600, F.lit(False)), "stuck": stuck,
    }).drop("_busy")


def outcome_counts(kept: DataFrame) -> DataFrame:
    """One row: requeued, cancelled, stale_running_cleared, unstuck."""
    changed = F.col("outcome") != F.col("status")
    return kept.agg(
        F.count_if(F.col("outcome") == "requeued").alias("requeued"), F.count_if(changed & (F.col("outcome") == "cancelled")).alias("cancelled"),
        F.count_if(changed & (F.col("outcome") == "failed")).alias("stale_running_cleared"), F.count_if("stuck").alias("unstuck"),
    )


def completed_outputs(history: DataFrame, files: DataFrame, states: DataFrame, most: int = 30) -> DataFrame:
    """job_id, label, size_kb: outputs (job_id, size_bytes, modified) of completed jobs of the history (job_id, label,
    status, completed_at), newest first, then other outputs by time; not those of batches and merges. The first 30."""
    kb = F.bround(F.col("size_bytes") / 1024, 1).alias("size_kb")
    done = history.where("status = 'completed'").join(files, "job_id").select("job_id", F.coalesce("label", "job_id").alias("label"), kb, F.lit(0).alias("_g"), F.col("completed_at").alias("_t"))
    taken = done.select("job_id").union(states.where("status = 'completed'").select("job_id")).distinct()
    rest = files.where(~F.col("job_id").startswith("batch_") & ~F.col("job_id").startswith("merge_")).join(taken, "job_id", "left_anti")
    rest = rest.select("job_id", F.col("job_id").alias("label"), kb, F.lit(1).alias("_g"), F.col("modified").alias("_t"))
    return done.union(rest).orderBy("_g", F.desc("_t"), "job_id").limit(most).select("job_id", "label", "size_kb")


def jobs_of_sources(states: DataFrame, sources: DataFrame) -> DataFrame:
    """source_id, job_id: live jobs whose upload (a path) is the source's file, by its name."""
    name = F.regexp_extract(F.replace(whole(F.col("upload_path")), F.lit("\\"), F.lit("/")), r"([^/]*)\.pdf$", 1)
    live = states.where(F.col("status").isin(*ACTIVE)).select("job_id", name.alias("source_id")).where("source_id <> ''")
    return live.join(sources.select("source_id").distinct(), "source_id").select("source_id", "job_id")


def provider_chain(available: Column, active: Column, priority: Column, requested: Column) -> Column:
    """The providers to ask: the one requested if it can be, else those available by priority, others after them. Where
    some are active, only those count, unless none of them is available."""
    scoped = F.array_intersect(available, active)
    pool = F.when((F.size(active) > 0) & (F.size(scoped) > 0), scoped).otherwise(available)
    choice = F.lower(strip(F.coalesce(F.nullif(requested, F.lit("")), F.lit("auto"))))
    return F.when((choice != "auto") & F.array_contains(pool, choice), F.array(choice)).otherwise(F.array_union(F.array_intersect(priority, pool), pool))


def source_batch(batches: DataFrame, order: str) -> DataFrame:
    """source_id, batch_id, source_filename, total_pages: the first batch of each source."""
    return batches.groupBy("source_id").agg(F.min_by(F.struct("batch_id", "source_filename", "total_pages"), F.struct(order, "batch_id")).alias("b")).select("source_id", "b.*")


def page_listing(sources: DataFrame, previews: int = 12) -> DataFrame:
    """source_id, page, preview: the pages of sources (source_id, total_pages), the first ones with a link."""
    pages = sources.where("total_pages >= 1").select("source_id", F.explode(F.sequence(F.lit(1), "total_pages")).alias("page"))
    link = F.concat(F.lit("/ocr/source/"), F.col("source_id").cast("string"), F.lit("/preview?page="), F.col("page").cast("string"))
    return pages.withColumn("preview", F.when(F.col("page") <= previews, link))


def plan_parts(asked: DataFrame, parts: DataFrame) -> DataFrame:
    """asked (batch_id, page_from, page_to) without ranges that a part (the same, status) holds that lives or is done, each once."""
    held = parts.where(F.col("status").isin(*ACTIVE, "completed")).select("batch_id", "page_from", "page_to").distinct()
    return asked.distinct().join(held, ["batch_id", "page_from", "page_to"], "left_anti")


def engine_profile(mode: Column, pages: Column, is_range: Column) -> Column:
    """Struct (mode, bulk, balanced_fast, dpi, min_edge): what an engine is told for a document, or a range, of so many pages."""
    m = normalize_mode(mode)
    pick = lambda table: F.when(m == "fast", table["fast"]).when(m == "quality", table["quality"]).otherwise(table["balanced"])
    bulk = ~is_range & (pages >= LARGE_PAGES)
    dpi = F.when(m == "balanced", F.greatest(F.lit(LARGE_DPI), pick(DPI))).when(m == "fast", F.least(F.lit(LARGE_DPI), pick(DPI))).otherwise(pick(DPI))
    edge = F.when(m == "quality", min(LARGE_EDGE + 400, EDGE["quality"])).otherwise(LARGE_EDGE)
    return F.struct(
        m.alias("mode"), bulk.alias("bulk"), (is_range & (m == "balanced") & (pages > FAST_RANGE)).alias("balanced_fast"),
        F.when(bulk, dpi).otherwise(pick(DPI)).alias("dpi"), F.when(bulk, edge).otherwise(pick(EDGE)).alias("min_edge"),
    )
