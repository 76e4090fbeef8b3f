"""The job queue as streams: slots given in order of arrival, and jobs that time out.

Events may come in any order within `late` of each other. A key's events are held until the watermark has passed them,
and then taken in order of time and row, so that neither triggers nor partitions change what comes out. A row without a
key is a heartbeat, which only moves the watermark. State lies in RocksDB (`rocksdb` sets that for a session).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a job may ask of the queue: a slot, to give its slot or its place up, and to give its slot up for a while.
ASK, LEAVE, YIELD = "ask", "leave", "yield"
# Idle minutes after which running and waiting jobs are given up, hours that a state is kept, and the
# idle seconds after which a waiting job is stuck if no job runs.
RUNNING_MINUTES, WAITING_MINUTES, TTL_HOURS, STUCK_SECONDS = 8, 180, 48, 20
# Fixed value: slots of a queue, at most.
MOST_SLOTS = 3
#: Events that go to the state at once.
APPENDED = 1000
#: Events that a task packs at once, and one of them: how it stands in a packed value. kind: the command (0 is any other), 4
#: for a null row, 8 for a null job, and 16 times the slots.
PACKED = 1 << 18
EVENT = np.dtype([("us", "<i8"), ("row", "<i8"), ("job", "<i8"), ("kind", "u1")])
COMMANDS = (None, ASK, LEAVE, YIELD)


def rocksdb(spark: SparkSession) -> None:
    """State stores of queries that start from now on are RocksDB's, which these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Holds a key's events (_us, row, and fields) until the watermark has passed them; `take` gets them in order."""

    fields = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", f"_us long, row long, {self.fields}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now, soonest, new = timerValues.getCurrentWatermarkInMs(), None, []
        names = [f.split()[0] for f in self.fields.split(", ")]
        for r in rows if key[0] is not None else ():  # heartbeats hold nothing
            if r["_us"] // 1000 > now or now <= 0:  # what comes later than `late` is left out
                new.append((r["_us"], r["row"], *(r[n] for n in names)))
                soonest = r["_us"] if soonest is None else min(soonest, r["_us"])
            if len(new) == APPENDED:  # a call for each event takes longer than all else
                self.held.appendList(new)
                new = []
        if new:
            self.held.appendList(new)
        if soonest is not None:
            self.handle.registerTimer(soonest // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted((tuple(x) for x in self.held.get()), key=lambda x: (x[0], x[1] is not None, x[1] or 0))
        due, later = [x for x in held if x[0] // 1000 <= now], [x for x in held if x[0] // 1000 > now]
        if due:
            self.held.clear()
            if later:
                self.held.put(later)
                self.handle.registerTimer(later[0][0] // 1000)
        yield from self.take(key, due, now)

    def take(self, key, due: list[tuple], now: int) -> Iterator[Row]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Slots(InOrder):
    """Of a queue: jobs that wait, in order of arrival, and jobs that hold one of its slots."""

    fields = "job long, command string, slots int"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "job long")
        self.busy = handle.getListState("busy", "job long")

    def take(self, key, due: list[tuple], now: int) -> Iterator[Row]:
        if due:
            yield from self.given(key, due)

    def given(self, key, due: Iterable[tuple]) -> Iterator[Row]:
        waiting, busy = dict.fromkeys(x[0] for x in self.waiting.get()), {x[0] for x in self.busy.get()}
        for _, row, job, command, slots in due:
            if command == ASK:
                if job not in busy:
                    waiting.setdefault(job)
            elif command in (LEAVE, YIELD):
                busy.discard(job)
                if command == LEAVE:
                    waiting.pop(job, None)
            while waiting and len(busy) < min(max(slots, 1), MOST_SLOTS):
                first = next(iter(waiting))
                del waiting[first]
                busy.add(first)
                yield Row(queue=key[0], row=row, job=first)
        for state, jobs in ((self.waiting, waiting), (self.busy, busy)):
            state.clear()
            if jobs:
                state.put([(j,) for j in jobs])


class PackedSlots(Slots):
    """Slots of events that come packed, by `pack`: a state value holds thousands, and each is unpacked once, when its time
    has come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "n long", "events binary")
        self.mark = handle.getValueState("mark", "n long, at long")  # values held, and the timer that is set (ms)
        self.waiting = handle.getListState("waiting", "job long")
        self.busy = handle.getListState("busy", "job long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        n, at = self.mark.get() or (0, None)
        before = at
        for r in rows:
            events = np.frombuffer(r["events"], EVENT)
            if now > 0:  # what comes later than `late` is left out
                events = events[events["us"] // 1000 > now]
            if len(events):
                n, at = self.keep(n, at, events)
        if at != before:
            self.handle.registerTimer(at)
        if n:
            self.mark.update((n, at))
        return iter(())

    def keep(self, n: int, at: int | None, events: np.ndarray) -> tuple[int, int]:
        self.held.updateValue((n,), (events.tobytes(),))
        soonest = int(events["us"].min()) // 1000
        return n + 1, soonest if at is None else min(at, soonest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        n, at = self.mark.get() or (0, None)
        if at is None or at > now:  # a timer before it has taken what was due
            return
        events = np.concatenate([np.frombuffer(bytes(self.held.getValue((k,))[0]), EVENT) for k in range(n)])
        for k in range(n):
            self.held.removeKey((k,))
        is_due = events["us"] // 1000 <= now
        due, later = events[is_due], events[~is_due]
        if len(later):
            n, at = self.keep(0, None, later)
            self.mark.update((n, at))
            self.handle.registerTimer(at)
        else:
            self.mark.clear()
        order = np.lexsort((due["row"], due["kind"] & 4 == 0, due["us"]))  # of one time, null rows first
        yield from self.given(key, unpacked(due[order]))


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """queue, events: the events of a task (queue, _us, row, job, kind), a row for each queue and PACKED events. Those without
    a queue go; they have moved the watermark by then."""

    def rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        t = t.filter(t["queue"].is_valid())
        queues, events = t["queue"].to_numpy(), np.empty(len(t), EVENT)
        for name, c in (("us", "_us"), ("row", "row"), ("job", "job"), ("kind", "kind")):
            events[name] = t[c].to_numpy()
        order = np.argsort(queues, kind="stable")
        queues, events = queues[order], events[order]
        bounds = np.flatnonzero(np.r_[len(queues) > 0, queues[1:] != queues[:-1]]) if len(queues) else np.empty(0, int)
        parts = [x.tobytes() for x in np.split(events, bounds[1:])] if len(queues) else []
        return pa.RecordBatch.from_arrays([pa.array(queues[bounds], pa.int64()), pa.array(parts, pa.binary())], names=["queue", "events"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= PACKED:
            yield rows(held)
            held, size = [], 0
    if size:
        yield rows(held)


def unpacked(events: np.ndarray) -> Iterator[tuple]:
    """The events as `given` takes them, with a part of them as Python objects at a time."""
    for k in range(0, len(events), 1 << 16):
        part = events[k : k + (1 << 16)]
        for us, row, job, kind in zip(*(part[c].tolist() for c in EVENT.names)):
            yield us, None if kind & 4 else row, None if kind & 8 else job, COMMANDS[kind & 3], kind >> 4


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    return events.withWatermark(time, late).withColumn("_us", F.unix_micros(time))


def slots(events: DataFrame, queue: str, job: str, time: str, row: str, command: str, slots: int | Column = 1, late: str = "10 minutes") -> DataFrame:
    """queue, row, job: which job gets a slot of its queue, and the event (row) at which it does.

    A job that asks waits its turn, however often it asks; one that holds a slot keeps it. It gives the slot up when it
    leaves or yields (and asks again to go on), and one that leaves waits no more. A queue has one to three slots: a
    number, or a column. Queues are independent keys, so they run in parallel; a queue's state is its waiting jobs and the
    events of `late`.
    """
    number = F.lit(slots) if isinstance(slots, int) else slots
    row_, job_ = F.col(row).cast("long"), F.col(job).cast("long")
    code = F.when(F.col(command) == ASK, 1).when(F.col(command) == LEAVE, 2).when(F.col(command) == YIELD, 3).otherwise(0)
    kind = code + F.when(row_.isNull(), 4).otherwise(0) + F.when(job_.isNull(), 8).otherwise(0) + 16 * F.least(F.greatest(number.cast("int"), F.lit(1)), F.lit(MOST_SLOTS))
    known = _timed(events.where(F.col(command).isNotNull() | F.col(queue).isNull()), time, late)
    zero = lambda c: F.coalesce(c, F.lit(0))
    # an event without a time has no place among the others
    rows = known.where("_us IS NOT NULL").select(F.col(queue).cast("long").alias("queue"), "_us", zero(row_).alias("row"), zero(job_).alias("job"), kind.cast("tinyint").alias("kind"))
    # a row of the state's operator is thousands of events; one by one they would take longer than all else
    return rows.mapInArrow(pack, "queue long, events binary").groupBy("queue").transformWithState(PackedSlots(), "queue long, row long, job long", "append", "EventTime")


class TimeOuts(InOrder):
    """A job's last state and when it times out: a timer for each limit, set anew by every event."""

    fields = "status string, in_memory boolean, has_upload boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", f"until long, _us long, row long, {self.fields}")

    @staticmethod
    def outcome(since: int, status: str, in_memory: bool, has_upload: bool, now: int) -> tuple:
        """status, outcome, expired, waited at a time (microseconds)."""
        idle, waits = (now - since) / 1_000_000, status in ("queued", "paused")
        if (waits or status == "processing") and not has_upload:
            to = "cancelled"
        elif status == "processing" and not in_memory and idle > RUNNING_MINUTES * 60:
            to = "failed"
        elif waits and not in_memory:
            to = "cancelled" if idle > WAITING_MINUTES * 60 else "requeued"
        else:
            to = status
        return status, to, idle > TTL_HOURS * 3600, waits and in_memory and idle > STUCK_SECONDS

    @staticmethod
    def limits(status: str, in_memory: bool, has_upload: bool) -> list[int]:
        """Seconds of silence after which the outcome of a state changes."""
        waits = status in ("queued", "paused")
        if waits and in_memory:
            own = [STUCK_SECONDS]
        else:
            own = [WAITING_MINUTES * 60] if waits and has_upload else [RUNNING_MINUTES * 60] if status == "processing" and has_upload and not in_memory else []
        return [*own, TTL_HOURS * 3600]

    def take(self, key, due: list[tuple], now: int) -> Iterator[Row]:
        until, *state = self.last.get() or (None,)
        if state and due:
            for at in [x for x in self.deadlines(state) if x > until][:1]:  # the one that is set
                if at > 1000 * now:
                    self.handle.deleteTimer(-(-at // 1000))
        for event in due:
            if state:  # what fell due before the next event of the same trigger
                yield from (self.told(key, at, state) for at in self.deadlines(state) if until < at < event[0])
            until, state = event[0], event
            yield self.told(key, event[0], state)
        if not state:
            return
        ahead = [x for x in self.deadlines(state) if x > 1000 * now]
        yield from (self.told(key, at, state) for at in self.deadlines(state) if until < at <= 1000 * now)
        if ahead:
            self.handle.registerTimer(-(-ahead[0] // 1000))  # each sets the next one: a call for every limit takes longer
            self.last.update((max(until, 1000 * now), *state))
        else:
            self.last.clear()  # nothing changes any more

    def deadlines(self, state) -> list[int]:
        """When (microseconds) silence has lasted longer than a limit, in order."""
        return [state[0] + 1_000_000 * limit + 1 for limit in sorted(self.limits(*state[2:]))]

    def told(self, key, at: int, state) -> Row:
        status, to, expired, waited = self.outcome(state[0], *state[2:], at)
        return Row(job=key[0], at=at, row=state[1], status=status, outcome=to, expired=expired, waited=waited)


def time_outs(events: DataFrame, job: str, time: str, row: str, status: str, in_memory: Column, has_upload: Column, late: str = "10 minutes") -> DataFrame:
    """job, at (microseconds), row, status, outcome, expired, waited: what is to be done with a job, told anew whenever it changes.

    A running job that is lost fails after 8 minutes of silence, a waiting one is cancelled after 180 and put back into
    the queue before; without its upload a live job is cancelled at once. States of 48 hours expire and are dropped;
    `waited` tells that a waiting job in memory has been idle for over 20 seconds. Every event of a job sets its timers
    anew. The last row of a job by `at` and `row` is what holds.
    """
    rows = _timed(events, time, late).select(F.col(job).cast("long").alias("job"), F.col(row).cast("long").alias("row"), F.col(status).alias("status"), in_memory.alias("in_memory"), has_upload.alias("has_upload"), "_us", time)
    return rows.groupBy("job").transformWithState(TimeOuts(), "job long, at long, row long, status string, outcome string, expired boolean, waited boolean", "append", "EventTime")
