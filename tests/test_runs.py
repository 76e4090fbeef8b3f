"""Folds over sorted batches against plain loops."""

import random

import numpy as np
import pytest

from foliant.operators import jobs, layout
from foliant.operators.runs import group_bounds, let_through, mean_breaks


def slow_throttle(rows, step):
    last, out = {}, []
    for k, t, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        if k not in last or t - last[k] >= step:
            last[k] = t
            out.append(i)
    return sorted(out)


def slow_rows(words):
    out, state = {}, {}
    for p, cy, left, pos, tol in sorted(words):
        row, total, n = state.get(p, (0, 0.0, 0))
        if n and abs(cy - total / n) > tol:
            row, total, n = row + 1, 0.0, 0
        state[p] = row, total + cy, n + 1
        out[p, pos] = row
    return out


@pytest.mark.parametrize("cut", [1, 3, 7, 1000])
def test_batches_of_any_size(cut):
    rng = random.Random(cut)
    for _ in range(60):
        keys = sorted(rng.choices(range(4), k=40))
        rows = sorted((k, rng.randrange(60), i) for i, k in enumerate(keys))
        key, times = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        got, last, now = [], 0, None
        for lo in range(0, 40, cut):
            k, t = key[lo : lo + cut], times[lo : lo + cut]
            bounds = group_bounds(k)
            go = let_through(bounds, t, 9, last if k[0] == now else None)
            own = np.nonzero(go[bounds[-2] :])[0]
            last = int(t[bounds[-2] + own[-1]]) if len(own) else last
            now = k[-1]
            got += [rows[lo + i][2] for i in np.nonzero(go)[0].tolist()]
        assert sorted(got) == slow_throttle(rows, 9)
        values = np.array([r[1] / 2 for r in rows])
        breaks = mean_breaks(group_bounds(key), values, np.full(40, 4.0), 0.0, 0)
        want = slow_rows([(r[0], r[1] / 2, 0, j, 4.0) for j, r in enumerate(rows)])
        upto = np.cumsum(breaks)
        assert [int(upto[j] - upto[np.searchsorted(key, key[j])]) for j in range(40)] == [want[key[j], j] for j in range(40)]


def test_one_long_dense_run_and_many_short_ones():
    values = np.sort(np.random.default_rng(1).random(50_000) * 300)
    breaks = mean_breaks(np.array([0, 50_000]), values, np.full(50_000, 10.0), 0.0, 0)
    want, total, n = [], 0.0, 0
    for j, v in enumerate(values.tolist()):
        if n and abs(v - total / n) > 10.0:
            want.append(j)
            total, n = 0.0, 0
        total, n = total + v, n + 1
    assert np.nonzero(breaks)[0].tolist() == want


def test_rows_and_throttled_events_across_batches(spark):
    rng = random.Random(8)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        rows = [(rng.choice([1, 2, 2, 2, 3, None]), rng.randrange(400) / 4, i) for i in range(300)]
        df = spark.createDataFrame(rows, "k long, t double, i long").repartition(4)
        assert sorted(r["i"] for r in jobs.throttled(df, "k", "t", "i", 1.5).collect()) == slow_throttle(rows, 1.5)
        assert jobs.throttled(df, "k", "t", "i", 0).count() == 300 and jobs.throttled(df.limit(0), "k", "t", "i").count() == 0
        words = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(300) / 2, float(rng.randrange(50)), i) for i in range(300)]
        df = spark.createDataFrame([(*w, 8.0, "x") for w in words] + [(1, None, 0.0, 999, 8.0, "lost")], "page_id long, cy double, left double, pos long, height double, text string")
        got = {(r["page_id"], r["pos"]): r["row"] for r in layout.cluster_rows(df).collect()}
        assert got == slow_rows([(p, cy, left, i, 10.0) for p, cy, left, i in words])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
