"""Streams over several batches, out of order and with a moving watermark, against plain folds."""

import random
import uuid
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.operators import control, jobs
from foliant.streaming import circuits, progress, queue

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return START + timedelta(seconds=seconds)


def streamed(spark, folder, batches, schema, build, order="at"):
    """What a stream gives over batches, a file and a trigger each."""
    queue.rocksdb(spark)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k:03}")
        source = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        out = build(source)
        sink = out.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        sink.foreachBatch(progress.log_writer(f"{folder}/log")).start().awaitTermination()
    return progress.read_log(spark, f"{folder}/log").select(out.columns).collect()


def brute_slots(events, slots):
    waiting, busy, out = {}, {}, []
    for q, job, t, row, command in sorted(events, key=lambda e: (e[2], e[3])):
        w, b = waiting.setdefault(q, []), busy.setdefault(q, [])
        if command == queue.ASK and job not in w and job not in b:
            w.append(job)
        if command in (queue.LEAVE, queue.YIELD) and job in b:
            b.remove(job)
        if command == queue.LEAVE and job in w:
            w.remove(job)
        while w and len(b) < slots:
            b.append(w.pop(0))
            out.append((q, row, b[-1]))
    return sorted(out)


@pytest.mark.parametrize("slots", [1, 3])
def test_slots_over_batches(spark, tmp_path, slots):
    rng = random.Random(slots)
    events = [(rng.randrange(3), rng.randrange(8), at(k + rng.random()), k, rng.choice([queue.ASK, queue.ASK, queue.LEAVE, queue.YIELD, None])) for k in range(240)]
    sent = sorted(events, key=lambda e: (e[2] + timedelta(seconds=rng.random() * 20)))  # up to 20 seconds late
    batches = [sent[k : k + 120] for k in range(0, 240, 120)] + [[(None, None, at(10_000), None, None)]]
    schema = "queue long, job long, ts timestamp, row long, command string"
    out = streamed(spark, tmp_path, batches, schema, lambda s: queue.slots(s, "queue", "job", "ts", "row", "command", slots, "30 seconds"))
    assert sorted(map(tuple, out)) == brute_slots(events, slots)


def test_time_outs_over_batches(spark, tmp_path):
    rng = random.Random(4)
    now, status = 0, ["queued", "processing", "paused", "completed"]
    rows, batches = [], []
    for b in range(3):
        batch = []
        for _ in range(40):
            now += rng.choice([1, 30, 500, 4000])
            job = rng.randrange(12)
            batch.append((job, at(now), len(rows), rng.choice(status), job % 3 == 0, job % 5 != 0))
            rows.append(batch[-1])
        batches.append(batch)
    schema = "job long, ts timestamp, row long, status string, mem boolean, up boolean"
    out = streamed(spark, tmp_path, batches, schema, lambda s: queue.time_outs(s, "job", "ts", "row", "status", F.col("mem"), F.col("up"), "0 seconds"))
    told = [tuple(r) for r in out]
    assert len(told) == len(set(told))
    last = {}
    for r in sorted(out, key=lambda r: (r["at"], r["row"])):
        last[r["job"]] = (r["outcome"], r["expired"])
    states = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        states[r[0]] = r
    df = spark.createDataFrame([(j, r[3], r[1], r[4], r[5]) for j, r in states.items()], "job_id long, status string, updated_at timestamp, in_memory boolean, has_upload boolean")
    kept = control.housekeeping(df, F.lit(at(now)))
    assert last == {r["job_id"]: (r["outcome"], r["expired"]) for r in kept.collect()}


def test_every_limit_is_told_once(spark, tmp_path):
    hours = lambda h: at(h * 3600)
    batches = [[(1, hours(0), 1, "processing", False, True), (2, hours(0), 2, "queued", False, True), (3, hours(0), 3, "queued", True, True)], [(None, hours(1), None, None, None, None)], [(None, hours(4), None, None, None, None)], [(None, hours(49), None, None, None, None)]]
    schema = "job long, ts timestamp, row long, status string, mem boolean, up boolean"
    out = streamed(spark, tmp_path, batches, schema, lambda s: queue.time_outs(s, "job", "ts", "row", "status", F.col("mem"), F.col("up"), "0 seconds"))
    base = int(START.timestamp() * 1e6)
    got = sorted((r["job"], round((r["at"] - base) / 1e6), r["outcome"], r["expired"], r["waited"]) for r in out)
    assert got == [
        (1, 0, "processing", False, False), (1, 480, "failed", False, False), (1, 172_800, "failed", True, False),
        (2, 0, "requeued", False, False), (2, 10_800, "cancelled", False, False), (2, 172_800, "cancelled", True, False),
        (3, 0, "queued", False, False), (3, 20, "queued", False, True), (3, 172_800, "queued", True, True),
    ]


def test_told_pages_and_a_log_that_is_written_once(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(4), at(k * 0.4), k, rng.choice([*range(9), None]), rng.choice([0, 5, 9])) for k in range(300)]
    schema = "job long, ts timestamp, row long, page long, total long"
    want = sorted(map(tuple, jobs.told_pages(spark.createDataFrame(rows, schema), "job", "ts", "row", "page", "total").collect()))
    last, brute = {}, []
    for job, t, row, page, total in rows:
        if page is None or total <= 0 or (page % 3 and job in last and t - last[job] < timedelta(seconds=1.5)):
            continue
        if page % 3:
            last[job] = t
        brute.append((job, row, page, total, max(0, min(100, page * 100 // total))))
    assert want == sorted(brute)
    heard = progress.ProgressLog()
    spark.streams.addListener(heard)
    try:
        out = streamed(spark, tmp_path, [rows[:150], rows[150:]], schema, lambda s: progress.told_pages(s, "job", "ts", "row", "page", "total", "0 seconds"))
    finally:
        spark.streams.removeListener(heard)
    assert sorted(map(tuple, out)) == want
    assert heard.table(spark).agg(F.sum("rows_read")).first()[0] == 300 and set(heard.ended.values()) == {None}
    # a batch that is run again, as after a failure, replaces what it wrote
    write = progress.log_writer(f"{tmp_path}/log")
    batch = spark.read.parquet(f"{tmp_path}/log/batch=1").drop("batch")
    again = batch.collect()
    for _ in range(2):
        write(spark.createDataFrame(again, batch.schema), 1)
    assert sorted(map(tuple, progress.read_log(spark, f"{tmp_path}/log").select("job", "row", "page", "total", "progress").collect())) == want


def test_circuits_over_batches(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b"]), at(k * 40 + rng.random()), k, rng.random() < 0.2) for k in range(200)]
    schema = "provider string, ts timestamp, row long, error boolean"
    df = spark.createDataFrame(rows, schema)
    whole = jobs.open_circuits(df.where("error"), df.where("NOT error").drop("error"), "provider", "ts")
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    build = lambda s: circuits.open_circuits(s.where("error OR row IS NULL"), s.where("NOT error OR row IS NULL"), "provider", "ts", "row", late="5 minutes")
    out = streamed(spark, folder, [rows[:100], rows[100:], [(None, at(100_000), None, None)]], schema, build)
    assert sorted((r["row"], r["disabled"]) for r in out) == sorted((r["row"], r["disabled"]) for r in whole.collect())
    assert 0 < sum(r["disabled"] for r in out) < len(out)


def test_held_events_go_to_the_state_in_few_calls():
    class State:
        calls, rows = 0, []

        def appendList(self, rows):
            self.calls, self.rows = self.calls + 1, self.rows + rows

    class Handle:
        timers = []

        def getListState(self, name, schema):
            return State()

        def registerTimer(self, at):
            self.timers.append(at)

    class Times:
        def getCurrentWatermarkInMs(self):
            return 5

    slots = queue.Slots()
    slots.init(Handle())
    rows = [{"_us": 1000 * k, "row": k, "job": k, "command": queue.ASK, "slots": 1} for k in range(2500)]
    assert list(slots.handleInputRows((1,), iter(rows), Times())) == []
    assert [r[1] for r in slots.held.rows] == list(range(6, 2500)) and slots.held.calls == 3 and slots.handle.timers == [6]


def test_events_go_to_the_state_packed(monkeypatch):
    """A call for thousands of events, a timer for the soonest of them; null rows and jobs, times and slots come back."""
    calls = []

    class State(dict):
        def getValue(self, key):
            calls.append("get")
            return self[key]

        def updateValue(self, key, value):
            calls.append("put")
            self[key] = value

        def removeKey(self, key):
            del self[key]

        def put(self, rows):
            self["rows"] = rows

        def update(self, value):
            self["value"] = value

        def get(self):
            return self.get_()

        def clear(self):
            dict.clear(self)

    class ListState(State):
        def get_(self):
            return iter(self["rows"] if "rows" in self else ())

    class ValueState(State):
        def get_(self):
            return self["value"] if "value" in self else None

    class Handle:
        timers = []
        getMapState = lambda self, *_: State()
        getListState = lambda self, *_: ListState()
        getValueState = lambda self, *_: ValueState()

        def registerTimer(self, at):
            self.timers.append(at)

    class Times:
        now = 0

        def getCurrentWatermarkInMs(self):
            return self.now

    monkeypatch.setattr(queue, "PACKED", 4000)
    rng = random.Random(8)
    code = {c: k for k, c in enumerate(queue.COMMANDS)}
    made = [(rng.choice([1, 1, 2, None]), rng.randrange(10_000) * 1000, k if k % 9 else None, rng.randrange(40) if k % 7 else None, rng.choice(queue.COMMANDS), rng.randrange(1, 4)) for k in range(10_000)]
    batches = [pa.RecordBatch.from_pylist([{"queue": q, "_us": us, "row": row or 0, "job": job or 0, "kind": code[c] + 4 * (row is None) + 8 * (job is None) + 16 * n} for q, us, row, job, c, n in made[k : k + 1000]], pa.schema([("queue", pa.int64()), ("_us", pa.int64()), ("row", pa.int64()), ("job", pa.int64()), ("kind", pa.int8())])) for k in range(0, 10_000, 1000)]
    packed = [r for b in queue.pack(iter(batches)) for r in b.to_pylist()]
    assert [r["queue"] for r in packed] == [1, 2] * 3
    slots, times, out = queue.PackedSlots(), Times(), []
    slots.init(Handle())
    own = [r for r in packed if r["queue"] == 1]
    assert list(slots.handleInputRows((1,), iter(own), times)) == [] and calls == ["put"] * 3
    mine = sorted((e[1:] for e in made if e[0] == 1), key=lambda e: (e[0], e[1] is not None, e[1] or 0))
    assert slots.handle.timers == [mine[0][0] // 1000]
    for times.now in (4000, 20_000):
        for _ in range(2):  # the second finds nothing that is due
            out += slots.handleExpiredTimer((1,), times, None)
    plain = queue.Slots()
    plain.waiting, plain.busy = ListState(), ListState()
    want = list(plain.given((1,), mine))
    key = lambda r: (r["row"] or 0, r["row"] is not None, r["job"] or 0, r["job"] is None)
    assert sorted(map(key, out)) == sorted(map(key, want)) and len(want) > 50
    assert calls == ["put"] * 3 + ["get"] * 3 + ["put", "get"] and len(slots.handle.timers) == 2
