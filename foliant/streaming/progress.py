"""Progress of jobs as a stream: which pages are told, a log that a repeated batch does not write twice, and a listener."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle, StreamingQueryListener

from foliant.operators.jobs import EVERY_PAGES, QUIET_SECONDS, percent
from foliant.streaming.queue import InOrder, _timed


class Told(InOrder):
    """A job's pages that are told: see operators.jobs.told_pages. Only the last time told in between is held."""

    fields = "page long, total long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "_us long")

    def take(self, key, due: list[tuple], now: int) -> Iterator[Row]:
        (last,) = self.last.get() or (None,)
        for us, row, page, total in due:
            if page % EVERY_PAGES and last is not None and us - last < QUIET_SECONDS * 1_000_000:
                continue
            if page % EVERY_PAGES:
                last = us
            yield Row(job=key[0], row=row, page=page, total=total)
        if last is not None:
            self.last.update((last,))


def told_pages(events: DataFrame, job: str, time: str, row: str, page: str, total: str, late: str = "10 minutes") -> DataFrame:
    """job, row, page, total, progress: operators.jobs.told_pages over a stream; events may be `late` out of order."""
    known = _timed(events, time, late).where((F.col(total) > 0) & F.col(page).isNotNull())
    rows = known.select(F.col(job).cast("long").alias("job"), F.col(row).cast("long").alias("row"), F.col(page).cast("long").alias("page"), F.col(total).cast("long").alias("total"), "_us", time)
    told = rows.groupBy("job").transformWithState(Told(), "job long, row long, page long, total long", "append", "EventTime")
    return told.withColumn("progress", percent(F.col("page"), F.col("total")))


def log_writer(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch is a partition of the log of its own, which a repeated batch id replaces. With a
    source that replays, every event is so in the log once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log with its batches."""
    return spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")


class ProgressLog(StreamingQueryListener):
    """Keeps what Spark tells of the queries it listens to: a row a batch, and how each query ended."""

    columns = "query string, batch long, rows_read long, watermark string, milliseconds long"

    def __init__(self, most: int = 10_000):
        self.most, self.rows, self.ended = most, [], {}

    def onQueryStarted(self, event) -> None:
        self.ended.pop(str(event.id), None)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append((str(p.id), p.batchId, p.numInputRows, (p.eventTime or {}).get("watermark"), p.batchDuration))
        del self.rows[: -self.most]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.columns)
