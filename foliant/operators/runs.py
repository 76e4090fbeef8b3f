"""Folds over sorted rows in whole Arrow batches: what no window can say, without a step for every row."""

from __future__ import annotations

import numpy as np


def group_bounds(*keys: np.ndarray) -> np.ndarray:
    """Where rows of equal keys begin, and the end: keys must be sorted so that equal ones stand together."""
    if not len(keys[0]):
        return np.zeros(1, np.int64)
    new = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.concatenate([[0], np.nonzero(new)[0] + 1, [len(keys[0])]])


def let_through(bounds: np.ndarray, times: np.ndarray, step: int, last: int | None) -> np.ndarray:
    """Of groups of ascending times (whole numbers), the rows that come `step` or more after the last row let through; the
    first of a group is. `last` was let through before the first group's rows.

    Each row's successor, the first row of its group a step later, is found for all rows at once by sorting rows and
    wishes together; the rows reached from the first ones by any number of jumps are found by doubling the jump.
    """
    n = len(times)
    if step <= 0:
        return np.ones(n, bool)
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    wished = np.concatenate([times, times + step])
    kind = np.repeat([1, 0], n)  # of equal times the wish goes first, so that the row counts for it
    order = np.lexsort((kind, wished, np.concatenate([group, group])))
    before = np.cumsum(kind[order])
    after = np.empty(2 * n, np.int64)
    after[order] = before
    jump = after[n:]  # rows of this and earlier groups before the wish
    jump = np.append(np.where(jump < bounds[1:][group], jump, n), n)
    first = bounds[:-1].copy()
    if last is not None and n:
        first[0] = np.searchsorted(times[: bounds[1]], last + step)
        if first[0] == bounds[1]:
            first = first[1:]
    out = np.zeros(n + 1, bool)
    out[first] = True
    while (jump[:n] < n).any():
        out[jump[out]] = True
        out[n] = False
        jump = jump[jump]
    return out[:n]


def mean_breaks(bounds: np.ndarray, values: np.ndarray, tolerance: np.ndarray, total: float, count: int) -> np.ndarray:
    """Of groups of ascending values, the rows that are further than the tolerance from the mean of the run so far, and so
    begin the next run. The first group goes on with a run of `count` values that add up to `total` (0: none).

    All groups are walked side by side, run by run: a run's next break is looked for in a window of rows, whose means come
    from prefix sums; windows grow where no group finds one. A run covers more than the tolerance, so a group has few.
    """
    out = np.zeros(len(values), bool)
    sums = np.concatenate([[0.0], np.cumsum(values)])
    begin, end = bounds[:-1].copy(), bounds[1:]
    base, held = np.zeros(len(begin)), np.zeros(len(begin), np.int64)
    scan = begin + 1
    if count and len(begin):
        base[0], held[0], scan[0] = total, count, begin[0]
    active, width = np.nonzero(scan < end)[0], 16
    while len(active):
        wide = max(1, min(width, (1 << 20) // len(active)))
        at = scan[active, None] + np.arange(wide)
        inside = at < end[active, None]
        at = np.where(inside, at, scan[active, None])
        start = begin[active, None]
        mean = (sums[at] - sums[start] + base[active, None]) / (at - start + held[active, None])
        over = inside & (np.abs(values[at] - mean) > tolerance[at])
        hit, k = over.any(axis=1), over.argmax(axis=1)
        scan[active[~hit]] += wide
        found = active[hit]
        place = scan[found] + k[hit]
        out[place] = True
        begin[found], scan[found], base[found], held[found] = place, place + 1, 0.0, 0
        width = min(width * 2, 1 << 16) if not hit.any() else 16
        active = active[scan[active] < end[active]]
    return out
