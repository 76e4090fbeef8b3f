"""Removal of bytes that long repeated strings cover, by a hash-compared suffix sort.

A string of 200 bytes that stands in two places is found through an anchor: the smallest of its 151 hashed 50-grams,
the first of equal ones. Equal strings have equal anchors at equal distances, so sorting the suffixes of one anchor at
a time is sorting all that matter. Each start of such a string belongs to one anchor.

1. Anchors of all texts are counted by hash; a bitmap of bounded size keeps those that occur twice (a false hit costs
   work only).
2. The context of an anchor, the bytes of its starts, gets a digest (128 bits of SHA-256). A context that occurs twice is
   repeated as a whole; no two texts with one digest are known of any length, so its bytes are not shipped to be compared.
3. Only where one anchor has different contexts are bytes dealt, one occurrence of each context. Their suffixes are
   sorted by merging runs; two suffixes are compared by the longest common extension, found by binary search over
   prefix polynomial hashes (8 steps). Neighbours that agree in 200 bytes are repeats, and their bytes are compared to
   rule out a collision.
4. The starts found go back to the texts, which lose every byte they cover; texts without any are not shuffled.

Texts are read once for each of these steps rather than shuffled whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import few_files, partitions, stored, table, tidy

LENGTH, GRAM = 200, 50
#: Bytes that are hashed at once, and the largest bitmap of anchors (bits).
SEGMENT_BYTES, BITMAP_BITS = 1 << 20, 1 << 27
#: Different contexts of an anchor that one task sorts; of an anchor with more, the strings are grouped by Spark.
GROUP_MOST = 10_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class PrefixHashes:
    """Polynomial hashes of all substrings of a byte array, modulo 2**64."""

    tables = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(PrefixHashes.tables[0]) < n:
            PrefixHashes.tables = powers(_BASE, n + n // 4), powers(_INVERSE, n + n // 4)
        self.data, self.back = data, PrefixHashes.tables[1]
        self.sums = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * PrefixHashes.tables[0][: n - 1], out=self.sums[1:])

    @staticmethod
    def forget() -> None:
        """Frees the tables of powers, which a worker would keep for later stages."""
        PrefixHashes.tables = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all substrings of that size, mixed."""
        h = (self.sums[size:] - self.sums[:-size]) * self.back[: len(self.sums) - size]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h

    def extension(self, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
        """Longest common extension of the suffixes at x and y, at most so long (they must have as many bytes)."""
        length = np.zeros(len(x), np.int64)
        sx, sy, bx, by = self.sums[x], self.sums[y], self.back[x], self.back[y]
        step = 1 << most.bit_length() - 1
        while step:
            longer = length + step
            ok = longer <= most
            at = np.where(ok, longer, 0)
            ok &= (self.sums[x + at] - sx) * bx == (self.sums[y + at] - sy) * by
            length = np.where(ok, longer, length)
            step >>= 1
        return length


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: hash and place of each anchor, and the first and last start that belong to it."""
    n, wide = len(data), LENGTH - GRAM + 1
    nothing = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    if n < LENGTH:
        return nothing
    hashes = PrefixHashes(data).windows(GRAM)
    key = hashes & np.uint64(0xFFFFFFFFFF000000)
    key |= np.arange(len(key), dtype=np.uint64)  # fewer than 2**24 places: the smallest hash, then the first place
    width = 1
    while width * 2 <= wide:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    key = np.minimum(key[: len(key) - (wide - width)], key[wide - width :])  # one for each start in the array
    sizes = np.diff(ends, prepend=0)
    start = np.nonzero(np.arange(len(key)) + LENGTH <= np.repeat(ends, sizes)[: len(key)])[0]
    if not len(start):
        return nothing
    place = (key[start] & np.uint64(0xFFFFFF)).astype(np.int64)
    cut = np.nonzero(place[1:] != place[:-1])[0]
    lo, hi = start[np.concatenate([[0], cut + 1])], start[np.concatenate([cut, [len(start) - 1]])]
    place = place[np.concatenate([[0], cut + 1])]
    h = hashes[place] * np.uint64(0x9E3779B97F4A7C15)  # the smallest hashes share their leading bits: mixed anew
    return h, place, lo, hi


def segments(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts (binary) laid end to end in arrays of about SEGMENT_BYTES: data, ends, the rows, and where in its row each
    begins. A longer text comes in parts that overlap, so that each start is in one of them."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    parts, rows, begins, total = [], [], [], 0

    def out():
        lengths = np.array([len(p) for p in parts], np.int64)
        return np.concatenate(parts), np.cumsum(lengths), np.array(rows), np.array(begins)

    for row in np.nonzero(sizes >= LENGTH)[0].tolist():
        text = np.frombuffer(column[row].as_buffer(), np.uint8)
        for at in range(0, len(text) - LENGTH + 1, SEGMENT_BYTES):
            part = text[at : at + SEGMENT_BYTES + LENGTH - 1]
            if total and total + len(part) > SEGMENT_BYTES:
                yield out()
                parts, rows, begins, total = [], [], [], 0
            parts.append(part)
            rows.append(row)
            begins.append(at)
            total += len(part)
    if parts:
        yield out()


def anchor_counts(texts: DataFrame) -> DataFrame:
    """h, n: anchor hashes with their numbers, summed within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ends, _, _ in segments(batch.column(0)):
                h, n = np.unique(anchors(data, ends)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], names=["h", "n"])
        PrefixHashes.forget()

    return texts.select(F.col("text").cast("binary")).mapInArrow(tidy(run), "h long, n int")


def bitmap(found: DataFrame, name: str) -> tuple[bytes, int]:
    """A bitmap of hashes (leading bits of a long column), and how many bits lead: at most BITMAP_BITS, in slices."""
    bits = max(16, min(BITMAP_BITS.bit_length() - 1, (16 * found.count()).bit_length()))
    lead = max(0, bits - 20)  # slices of 2**20 bits

    def slice_(key: tuple, t: pa.Table) -> pa.Table:
        marks = np.zeros(1 << (bits - lead), np.uint8)
        marks[(t.column(name).to_numpy().view(np.uint64) >> np.uint64(64 - bits)) & np.uint64((1 << (bits - lead)) - 1)] = 1
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "marks": pa.array([np.packbits(marks).tobytes()], pa.binary())})

    sliced = found.select(name).withColumn("slice", F.shiftrightunsigned(name, 64 - lead).cast("int") if lead else F.lit(0))
    parts = {r["slice"]: r["marks"] for r in sliced.groupBy("slice").applyInArrow(slice_, "slice int, marks binary").collect()}
    empty = bytes((1 << (bits - lead)) // 8)
    return b"".join(parts.get(k, empty) for k in range(1 << lead)), bits


def in_bitmap(marks: bytes, bits: int, h: np.ndarray) -> np.ndarray:
    index = h.view(np.uint64) >> np.uint64(64 - bits)
    return (np.frombuffer(marks, np.uint8)[index >> np.uint64(3)] >> (np.uint64(7) - (index & np.uint64(7))).astype(np.uint8)) & 1 > 0


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, rk (a hash of the row), text (binary)."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), F.col("text").cast("binary").alias("text"))


def anchored(batch: pa.RecordBatch):
    """Of a batch of keyed rows, array by array: its rows, their hashes, places in the texts, anchors' hashes, leads,
    contexts' bounds in the array, the array, and the occurrences' own hashes."""
    rk = batch.column(1).to_numpy()
    for data, ends, rows, begins in segments(batch.column(2)):
        h, place, lo, hi = anchors(data, ends)
        which = np.searchsorted(ends, lo, "right")
        row = rows[which]
        at = lo - np.concatenate([[0], ends[:-1]])[which] + begins[which]
        with np.errstate(over="ignore"):
            own = (rk[row].view(np.uint64) ^ (at.astype(np.uint64) * np.uint64(_BASE))) * np.uint64(0xD6E8FEB86659FD93)
            own ^= own >> np.uint64(32)
            own *= np.uint64(0xD6E8FEB86659FD93)
        yield row, rk[row], at, h, place - lo, lo, hi + LENGTH, data, own


def context_digest(ctx: bytes, lead: int) -> bytes:
    """Of a context and the anchor's place in it."""
    digest = hashlib.sha256(ctx)
    digest.update(bytes([lead]))
    return digest.digest()[:16]


def occurrences(docs: DataFrame, marks: bytes, bits: int) -> DataFrame:
    """Contexts of the anchors in the bitmap: doc_id, rk, at (first byte in the text), size, h, cx (a hash of the anchor,
    and a digest of the context with the anchor's distance), own (a hash of the occurrence)."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)  # at most BITMAP_BITS
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "rk", "at", "size", "h", "cx", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, rk, at, h, lead, lo, end, data, own in anchored(batch):
                k = np.nonzero(in_bitmap(shared.value, bits, h))[0]
                raw = data.tobytes()
                cx = pa.array([context_digest(raw[a:b], d) for a, b, d in zip(lo[k].tolist(), end[k].tolist(), lead[k].tolist())], pa.binary())
                columns = rk[k], at[k], (end - lo)[k].astype(np.int32), h[k].view(np.int64), cx, own[k].view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[k])), *map(pa.array, columns)], names=names)
        PrefixHashes.forget()

    return keyed(docs).mapInArrow(tidy(run), f"doc_id {kind}, rk long, at long, size int, h long, cx binary, own long")


def contexts(docs: DataFrame, marks: bytes, bits: int) -> DataFrame:
    """Occurrences whose own hash is in the bitmap: own, h, lead, cx, ctx (the bytes)."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)  # at most BITMAP_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, h, lead, lo, end, data, own in anchored(batch):
                k = np.nonzero(in_bitmap(shared.value, bits, own))[0]
                raw, d = data.tobytes(), lead[k].tolist()
                ctx = [raw[a:b] for a, b in zip(lo[k].tolist(), end[k].tolist())]
                cx = pa.array(list(map(context_digest, ctx, d)), pa.binary())
                columns = pa.array(own[k].view(np.int64)), pa.array(h[k].view(np.int64)), pa.array(d, pa.int32()), cx, pa.array(ctx, pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns), names=["own", "h", "lead", "cx", "ctx"])
        PrefixHashes.forget()

    return keyed(docs).mapInArrow(tidy(run), "own long, h long, lead int, cx binary, ctx binary")


def sort_suffixes(text: PrefixHashes, place: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Order of suffixes (places, LENGTH bytes each) by bucket, and by content within: a mergesort of all buckets at
    once. In a merge, every suffix finds its rank in the other run by binary search. bucket must ascend."""
    n = len(place)
    first = np.concatenate([[0], np.nonzero(bucket[1:] != bucket[:-1])[0] + 1]) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    base, width = np.repeat(first, size), np.repeat(size, size)
    order = np.arange(n)
    data = text.data
    run = 1
    while n and run < size.max():
        t = np.nonzero(width > run)[0]
        inside = t - base[t]
        mine = inside // run
        other = (mine ^ 1) * run
        has = other < width[t]
        t, inside, mine, other = t[has], inside[has], mine[has], other[has]
        lo, hi = other.copy(), np.minimum(other + run, width[t])
        left = (mine & 1) == 0
        x = place[order[t]]
        active = np.arange(len(t))
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            y = place[order[base[t[active]] + mid]]
            a = x[active]
            common = text.extension(a, y, LENGTH)
            same = common == LENGTH
            step = np.where(same, 0, common)
            before = np.where(same, ~left[active], data[y + step] < data[a + step])  # y goes before a
            lo[active] = np.where(before, mid + 1, lo[active])
            hi[active] = np.where(before, hi[active], mid)
            active = active[lo[active] < hi[active]]
        target = base[t] + (mine >> 1) * 2 * run + (inside - mine * run) + (lo - other)
        merged = order.copy()
        merged[target] = order[t]
        order = merged
        run *= 2
    return order


def agree(data: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the LENGTH bytes at x and at y are equal, byte by byte; pairs that follow each other are read once."""
    order = np.lexsort((x, y - x))
    a, shift = x[order], (y - x)[order]
    new = np.ones(len(a), bool)
    new[1:] = (shift[1:] != shift[:-1]) | (a[1:] > a[:-1] + LENGTH)
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(a)) - 1
    begin, size = a[first], a[last] + LENGTH - a[first]
    out = np.ones(len(a), bool)
    for lo in range(0, len(first), 4096):
        b, s = begin[lo : lo + 4096], size[lo : lo + 4096]
        starts = np.cumsum(s) - s
        at = np.repeat(b - starts, s) + np.arange(s.sum())
        wrong = np.add.reduceat(data[at] != data[at + np.repeat(shift[first[lo : lo + 4096]], s)], starts)
        for k in np.nonzero(wrong)[0].tolist():
            for i in range(first[lo + k], last[lo + k] + 1):
                out[i] = (data[a[i] : a[i] + LENGTH] == data[a[i] + shift[i] : a[i] + shift[i] + LENGTH]).all()
    result = np.empty(len(a), bool)
    result[order] = out
    return result


def repeated_starts(h: np.ndarray, lead: np.ndarray, ctx: list[bytes]) -> list[np.ndarray]:
    """For each context (rows in order of h), the starts in it whose string stands in another row too."""
    sizes = np.fromiter(map(len, ctx), np.int64, len(ctx))
    starts = sizes - LENGTH + 1
    found = [np.zeros(0, np.int64)] * len(ctx)
    same = h[1:] == h[:-1]
    grouped = np.append(same, False) | np.append(False, same)
    rows = np.nonzero(grouped)[0]
    if not len(rows):
        return found
    text = PrefixHashes(np.frombuffer(b"".join([ctx[i] for i in rows.tolist()]), np.uint8))
    group = np.cumsum(np.append(True, ~same))[rows]
    count = starts[rows]
    begin = np.cumsum(sizes[rows]) - sizes[rows]
    row = np.repeat(np.arange(len(rows)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    bucket = group[row] * 256 + (lead[rows][row] - start)
    order = np.argsort(bucket, kind="stable")
    row, start, bucket = row[order], start[order], bucket[order]
    alike = bucket[1:] == bucket[:-1]
    keep = np.append(alike, False) | np.append(False, alike)
    row, start, bucket = row[keep], start[keep], bucket[keep]
    place = begin[row] + start
    order = sort_suffixes(text, place, bucket)
    place, row, start, bucket = place[order], row[order], start[order], bucket[order]
    pair = np.nonzero(bucket[1:] == bucket[:-1])[0]
    pair = pair[text.extension(place[pair], place[pair + 1], LENGTH) == LENGTH]
    pair = pair[agree(text.data, place[pair], place[pair + 1])] if len(pair) else pair
    hit = np.zeros(len(place), bool)
    hit[pair] = hit[pair + 1] = True
    order = np.lexsort((start[hit], row[hit]))
    row, start = row[hit][order], start[hit][order]
    cuts = np.searchsorted(row, np.arange(len(rows) + 1))
    for k, i in enumerate(rows.tolist()):
        if cuts[k] < cuts[k + 1]:
            found[i] = start[cuts[k] : cuts[k + 1]]
    return found


def runs_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """Starts that follow each other, as (first, one beyond the last byte they cover)."""
    cut = np.nonzero(np.diff(starts) > LENGTH)[0]
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + LENGTH).tolist()))


def marked_contexts(found: DataFrame) -> DataFrame:
    """found: h, lead, cx, ctx. Returns h, cx and a, b: covered bytes of the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            ctx = t.column("ctx").to_pylist()
            found = repeated_starts(t.column("h").to_numpy(), t.column("lead").to_numpy(), ctx)
            at, a, b = [], [], []
            for i, s in enumerate(found):
                if len(s):
                    for x, y in runs_of(s):
                        at.append(i)
                        a.append(x)
                        b.append(y)
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [t.column(c).take(index).combine_chunks() for c in ("h", "cx")] + [pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["h", "cx", "a", "b"]
            )

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > SEGMENT_BYTES:
                t = pa.Table.from_batches(held).combine_chunks()
                h = t.column("h").to_numpy()
                lo = 0
                while True:  # whole groups of about SEGMENT_BYTES; the last group may go on in the next batch
                    ends = np.cumsum(pc.binary_length(t.column("ctx")).to_numpy()[lo:])
                    if not len(ends) or ends[-1] < SEGMENT_BYTES:
                        break
                    cut = lo + int(np.searchsorted(ends, SEGMENT_BYTES))
                    cut = int(np.searchsorted(h, h[cut], "left")) or 0
                    if cut <= lo:
                        cut = int(np.searchsorted(h, h[lo], "right"))
                        if cut >= len(h):
                            break
                    yield from work(t.slice(lo, cut - lo))
                    lo = cut
                held, size = t.slice(lo).to_batches(), 0
        if held:
            yield from work(pa.Table.from_batches(held))
        PrefixHashes.forget()

    dealt = found.repartition(partitions(found.sparkSession), "h").sortWithinPartitions("h")
    return dealt.select("h", "lead", "ctx", "cx").mapInArrow(tidy(run), "h long, cx binary, a int, b int")


def marked_in_large_groups(found: DataFrame) -> DataFrame:
    """As marked_contexts, for anchors with very many contexts: every string is a row of its own, counted by Spark."""
    starts = found.select("h", "lead", "cx", "ctx", F.explode(F.sequence(F.lit(0), F.octet_length("ctx") - LENGTH)).alias("s"))
    each = starts.select("h", (F.col("lead") - F.col("s")).alias("l"), "cx", "s", F.substring("ctx", F.col("s") + 1, F.lit(LENGTH)).alias("string"))
    twice = each.groupBy("h", "l", "string").agg(F.count("*").alias("n")).where("n > 1").select("h", "l", "string")
    return each.join(twice, ["h", "l", "string"]).select("h", "cx", F.col("s").cast("int").alias("a"), (F.col("s") + LENGTH).cast("int").alias("b"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, rk (xxhash64 of doc_id and text), spans: bytes that repeated strings cover, as structs (a, b)."""
    counted = anchor_counts(docs).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    found = stored(occurrences(docs, *bitmap(stored(counted, "repeated-anchors"), "h")), "occurrences", "zstd")
    distinct = found.groupBy("h", "cx").agg(F.count("*").alias("n"), F.min("own").alias("own"), F.first("size").alias("size"))
    distinct = stored(few_files(distinct, found.count()), "distinct-contexts", "zstd")
    n = distinct.count()
    several = stored(few_files(distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), n), "several-contexts")
    chosen = stored(few_files(distinct.join(several.select("h"), "h", "left_semi").select("own"), n), "chosen-contexts")
    # the join takes off what the bitmap lets through besides: copies of a hot context
    ctx = contexts(docs, *bitmap(chosen, "own")).join(chosen, "own", "left_semi").drop("own")
    large = several.where(F.col("n") > GROUP_MOST).select("h")
    if large.isEmpty():
        marked = marked_contexts(ctx)
    else:
        ctx = stored(ctx, "contexts", "zstd")
        marked = marked_contexts(ctx.join(large, "h", "left_anti")).union(marked_in_large_groups(ctx.join(large, "h", "left_semi")))
    whole = distinct.where("n > 1").select("h", "cx", F.lit(0).alias("a"), F.col("size").alias("b"))
    back = found.select("doc_id", "rk", "at", "h", "cx").join(whole.union(stored(marked, "marked-contexts")), ["h", "cx"])
    span = F.struct((F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b"))
    return back.groupBy("doc_id", "rk").agg(F.collect_set(span).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def whole_characters(text: bytes, a: int, b: int) -> tuple[int, int]:
    """The span widened to whole UTF-8 characters: continuation bytes are 0x80 to 0xBF."""
    while 0 < a < len(text) and text[a] & 0xC0 == 0x80:
        a -= 1
    while b < len(text) and text[b] & 0xC0 == 0x80:
        b += 1
    return a, b


def without_repeats(docs: DataFrame, characters: bool = False) -> DataFrame:
    """docs (doc_id, text, ..) with n_bytes, removed (array of structs a, b: maximal runs of removed bytes) and kept
    (binary: the remaining bytes) added; columns of these names are replaced.

    Every byte goes that a string of LENGTH bytes covers which also starts elsewhere, in any text, the same one
    included; strings are judged on the input. A null text is empty. Null and repeated doc_id are rows of their own:
    rows of equal doc_id and text share their spans. Texts under LENGTH bytes stay. With characters, spans are widened
    to whole characters, so that what is kept is text.
    """
    spans = stored(repeated_spans(docs.select("doc_id", "text")), "spans", "zstd")
    marks, bits = bitmap(spans, "rk")
    shared = docs.sparkSession.sparkContext.broadcast(marks)  # at most BITMAP_BITS
    fields = [f for f in docs.schema if f.name not in ("n_bytes", "removed", "kept")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    rows = docs.select(*[f"`{f.name}`" for f in fields], F.xxhash64("doc_id", "text").alias("_rk"), F.col("text").cast("binary").alias("_raw"))
    width = len(fields)
    result = f"{kinds}, n_bytes long, removed array<struct<a: long, b: long>>, kept binary"
    names = [*(f.name for f in fields), "n_bytes", "removed", "kept"]

    def cut(batch: pa.RecordBatch, raw: pa.Array, found: list) -> pa.RecordBatch:
        sizes, removed, kept = [], [], []
        for i in range(len(batch)):
            text = raw[i].as_py() or b""
            runs = merged([(s["a"], s["b"]) for s in found[i] or ()])
            if characters:
                runs = merged([whole_characters(text, a, b) for a, b in runs])
            at, parts = 0, []
            for a, b in runs:
                parts.append(text[at:a])
                at = b
            sizes.append(len(text))
            removed.append([{"a": a, "b": b} for a, b in runs])
            kept.append(b"".join([*parts, text[at:]]))
        spans_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        return pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(sizes, pa.int64()), pa.array(removed, spans_type), pa.array(kept, pa.binary())], names=names)

    def marked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for keys in batches:
            yield pa.array(in_bitmap(shared.value, bits, keys.to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield cut(batch, batch.column(width), batch.column(width + 1).to_pylist())

    # the texts that may lose something go to their spans; of the others only the keys see Python
    rows = rows.withColumn("_hit", F.arrow_udf(marked, "boolean")("_rk"))
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("rk").alias("_key"), F.col("spans").alias("_spans"))
    hit = rows.where("_hit").drop("_hit")
    joined = hit.join(spans, hit["doc_id"].eqNullSafe(spans["_id"]) & (hit["_rk"] == spans["_key"]), "left").drop("_rk", "_id", "_key")
    rest = rows.where("NOT _hit").select(
        *[f"`{f.name}`" for f in fields], F.coalesce(F.octet_length("_raw"), F.lit(0)).cast("long").alias("n_bytes"),
        F.array().cast("array<struct<a: bigint, b: bigint>>").alias("removed"), F.coalesce("_raw", F.lit(b"")).alias("kept"),
    )
    return joined.mapInArrow(tidy(run), result).union(rest)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return cut.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
