"""Substrings of texts that are among given strings: only those leave a text, so texts are never exploded; and the other way
round, strings that may be substrings of given texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter, at most; a full filter lets more substrings through, which costs work only. Bits of a slice of it.
FILTER_BITS, SLICE_BITS = 1 << 27, 1 << 20
#: Characters of a text that are hashed at once.
SEGMENT = 1 << 20
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all substrings of that many characters (the last axis of code points)."""
    n = codes.shape[-1] - size + 1
    h = np.full((*codes.shape[:-1], max(n, 0)), size, np.uint64)
    for k in range(size):
        h = h * _BASE + codes[..., k : k + n]
    return _mixed(h)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def hashes_at(codes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the substrings of that many characters at some places, as window_hashes has them."""
    h = np.full(len(starts), size, np.uint64)
    for k in range(size):
        h = h * _BASE + codes[starts + k]
    return _mixed(h)


def _marked(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    return table[places >> np.uint64(3)] >> (np.uint64(7) - (places & np.uint64(7))).astype(np.uint8) & 1


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def string_filter(strings: DataFrame, column: str) -> tuple[bytes, int, list[int]]:
    """A bitmap of the hashes of distinct strings, how many leading bits of a hash it takes, and their lengths."""
    known = strings.groupBy(F.length(column).alias("n")).agg(F.count("*").alias("c")).collect()  # a row a length: a gram's at most
    total = sum(r["c"] for r in known)
    bits = max(16, min(FILTER_BITS.bit_length() - 1, (16 * total).bit_length()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = batch.column(0), pc.utf8_length(batch.column(0)).to_numpy()
            for n in np.unique(sizes).tolist():
                some = texts.filter(pa.array(sizes == n)).to_pylist()
                h = window_hashes(code_points("".join(some)).reshape(len(some), n), n)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(64 - bits)).astype(np.int64))], names=["h"])

    places = strings.select(column).mapInArrow(hashed, "h long")
    return bitmap(places, bits), bits, sorted(r["n"] for r in known)


def bitmap(places: DataFrame, bits: int) -> bytes:
    """A bitmap with the bits set whose places (h) are given."""
    lead = max(0, bits - (SLICE_BITS.bit_length() - 1))

    def slice_(key: tuple, t: pa.Table) -> pa.Table:
        marks = np.zeros(1 << (bits - lead), np.uint8)
        marks[t.column("h").to_numpy() & ((1 << (bits - lead)) - 1)] = 1
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "marks": pa.array([np.packbits(marks).tobytes()], pa.binary())})

    sliced = places.withColumn("slice", F.shiftright("h", bits - lead))
    parts = {r["slice"]: r["marks"] for r in sliced.groupBy("slice").applyInArrow(slice_, "slice long, marks binary").collect()}  # FILTER_BITS at most
    empty = bytes((1 << (bits - lead)) // 8)
    return b"".join(parts.get(k, empty) for k in range(1 << lead))


def window_filter(texts: DataFrame, text: str, sizes: list[int]) -> tuple[bytes, int] | None:
    """A bitmap with two bits for each substring of those lengths of the texts, and how many bits of a hash a place takes;
    None where there are so many that it would be too full to be of use."""
    total = len(sizes) * (texts.agg(F.sum(F.length(text))).first()[0] or 0)
    if 16 * total > FILTER_BITS:
        return None
    bits = max(16, min(FILTER_BITS.bit_length() - 1, (64 * total).bit_length()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                codes = code_points(t or "")
                for n in sizes:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(_two_places(window_hashes(codes, n), bits)).astype(np.int64))], names=["h"])

    return bitmap(texts.select(text).mapInArrow(hashed, "h long").distinct(), bits), bits


def _two_places(h: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([h >> np.uint64(64 - bits), h & np.uint64((1 << bits) - 1)])


def maybe_held(keys: DataFrame, key: str, known: tuple[bytes, int], gram: int, stride: int, longest: int) -> DataFrame:
    """Of strings (two characters or more) those that a text of window_filter may hold, and some others: whole ones under
    `gram` characters, up to `longest` such as have a gram at every `stride`-th place, longer ones with all grams end to end."""
    marks, bits = known
    shared = keys.sparkSession.sparkContext.broadcast(marks)  # FILTER_BITS at most

    def kept(texts: list[str], sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        begin, out = np.cumsum(sizes) - sizes, np.zeros(len(sizes), bool)
        held = lambda at, n: _marked(table, _two_places(hashes_at(codes, at, n), bits)).all(axis=0)
        for n in np.unique(sizes[sizes < gram]).tolist():
            rows = np.nonzero(sizes == n)[0]
            out[rows] = held(begin[rows], n)
        short, long = (sizes >= gram) & (sizes <= longest), sizes > max(longest, gram - 1)
        for rows, step, least in ((np.nonzero(short)[0], stride, 1), (np.nonzero(long)[0], gram, None)):
            count = (sizes[rows] - gram) // step + 1
            row = np.repeat(np.arange(len(rows)), count)
            at = begin[rows][row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * step
            hits = np.bincount(row[held(at, gram)], minlength=len(rows))
            out[rows] = hits >= (count if least is None else least)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            texts, sizes = batch.column(0).to_pylist(), pc.utf8_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)
            part = np.cumsum(sizes) // SEGMENT  # rows of about a segment of characters are hashed at once
            cuts = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), len(texts)]
            keep = [kept(texts[a:b], sizes[a:b], table) for a, b in zip(cuts, cuts[1:]) if a < b]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return keys.select(key).mapInArrow(run, f"`{key}` string")


def held_strings(texts: DataFrame, key: str, text: str, strings: DataFrame, column: str) -> DataFrame:
    """key, column: which of the distinct strings (all of them short) each text may hold, a row for each; what the filter lets
    through besides is for a join to take off."""
    marks, bits, sizes = string_filter(strings, column)
    shared = texts.sparkSession.sparkContext.broadcast(marks)  # FILTER_BITS at most
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            rows, found = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                own = set()
                for lo in range(0, len(t or ""), SEGMENT):
                    part = t[lo : lo + SEGMENT + max(sizes, default=1) - 1]
                    codes = code_points(part)
                    for n in sizes:
                        hit = _marked(table, window_hashes(codes, n) >> np.uint64(64 - bits))
                        own.update(part[k : k + n] for k in np.nonzero(hit)[0].tolist())
                rows += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=[key, column])

    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, `{column}` string")
