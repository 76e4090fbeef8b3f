"""Packing of documents into sequences of fixed length: a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits one sequence. The program covers all pieces with as few
configurations as possible. A piece is worth its length times a weight that is updated multiplicatively by how much of
its length is left; a knapsack dynamic program prices configurations under these values, and those near the best price
are taken, each round for a share of what the pieces left allow: their amounts add up to a fractional solution. It is
rounded down, and what is left is solved again, with amounts that are rounded as they come; best fit places what no such
configuration holds. Where lengths are few and rare, rounding costs more than the program gains: of the plans by several
rates, with and without the fractional solution, and of best fit alone, the one with the fewest sequences counts. The
values over the best price are a dual solution, which bounds from below what any packing takes. Only the histogram (at
most `capacity` counts) reaches the driver, and the plan is as small.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.bpe import _ODD_SPACE, read_ranks, text_chunks
from foliant.llm.common import numbered, stored, table, tidy

CAPACITY, END_ID = 1024, 2
#: Rates of the multiplicative weights (of the plans by them, the one with the fewest sequences counts), the most rounds
#: of each, and how far below the best price a configuration may be.
RATES, ROUNDS, NEAR = (0.02, 0.05, 0.1, 0.2), 400, 0.1
#: Share of what the pieces left allow that a round adds to a fractional solution, and the part of a length below which it
#: counts as covered.
SHARE, SETTLED = 0.3, 1e-3

#: Bytes of text that are tokenized at once, at least one text.
CHUNK_BYTES = 4 << 20

#: Columns that the numbering of pieces uses.
INNER = ("_row", "_n", "_bucket", "_rank", "_start", "_rows")

Pattern = tuple[int, ...]


def price(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best value for each room, and the length taken there (0: one token stays free). Of equally
    good lengths the longest, so that short pieces stay for the gaps."""
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        options = best[:room] + values[room:0:-1]  # length room, room - 1, ... 1
        most = options.max()
        if most > best[room - 1]:
            best[room], taken[room] = most, room - int((options >= most - 1e-12).argmax())
        else:
            best[room] = best[room - 1]
    return best, taken


def best_fit(left: dict[int, int], capacity: int) -> Counter:
    """Best fit, longest first, by counts: sequences of equal content are one class. Returns patterns with counts."""
    classes: dict[int, Counter] = {}  # by free room
    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            free = next((f for f in range(length, capacity + 1) if classes.get(f)), None)
            if free is None:
                per = min(capacity // length, count)
                pattern, n = (length,) * per, count // per
                free_now, used = capacity - per * length, per
            else:
                old, have = next(iter(classes[free].items()))
                per = min(free // length, count)
                n = min(have, count // per)
                pattern, used = old + (length,) * per, per
                classes[free][old] -= n
                if not classes[free][old]:
                    del classes[free][old]
                free_now = free - per * length
            classes.setdefault(free_now, Counter())[pattern] += n
            count -= n * used
    return sum(classes.values(), Counter())


def weighted_amounts(need: np.ndarray, capacity: int, rate: float, rounds: int, share: float | None = None) -> tuple[Counter, np.ndarray, float]:
    """Amounts of patterns by multiplicative weights of one rate, what they leave of each length, and the best dual bound of
    the rounds. Each round takes a share of what the pieces left allow; without a share, all of it in whole sequences."""
    left, lengths = need.astype(np.int64 if share is None else np.float64), np.arange(capacity + 1)
    weights, plan, bound = np.where(need > 0, 1.0, 0.0), Counter(), 0.0
    for _ in range(rounds):
        values = np.where(left > (0 if share is None else SETTLED * need), weights * lengths / capacity, 0.0)
        if not values.any():
            break
        best, taken = price(values, capacity)
        bound = max(bound, float((need * values).sum() / best[capacity]))
        used = False
        for first in np.nonzero(values)[0][::-1].tolist():
            if left[first] <= 0 or values[first] + best[capacity - first] < (1 - NEAR) * best[capacity]:
                continue
            each, room = Counter([first]), capacity - first
            while room > 0:
                if taken[room]:
                    each[int(taken[room])] += 1
                room -= max(1, int(taken[room]))
            n = min(int(left[x]) // k for x, k in each.items()) if share is None else share * min(left[x] / k for x, k in each.items())
            if n > 0:
                plan[tuple(sorted(each.elements(), reverse=True))] += n
                used = True
                for x, k in each.items():
                    left[x] -= n * k
        if not used:
            break
        part = np.divide(left, need, out=np.zeros(capacity + 1), where=need > 0)
        weights = np.where(need > 0, weights * np.exp(rate * (part - left.sum() / need.sum())), 0.0)
        weights = np.clip(weights / weights[need > 0].mean(), 0.05, 20.0)
    return plan, left, bound


def rounded(amounts: Counter, need: np.ndarray) -> tuple[Counter, np.ndarray]:
    """Amounts in whole sequences, none more than there are pieces for, and the pieces left."""
    plan, left = Counter(), need.copy()
    for pattern, amount in sorted(amounts.items(), key=lambda x: (-x[1], x[0])):
        each = Counter(pattern)
        n = min(int(amount + 1e-9), *(int(left[x]) // k for x, k in each.items()))
        if n > 0:
            plan[pattern] += n
            for x, k in each.items():
                left[x] -= n * k
    return plan, left


def settled(need: np.ndarray, capacity: int, rate: float, rounds: int) -> tuple[Counter, float]:
    """A plan for all pieces with amounts that are rounded as they come, and a dual bound."""
    plan, left, bound = weighted_amounts(need, capacity, rate, rounds)
    return plan + best_fit({int(x): int(left[x]) for x in np.nonzero(left)[0]}, capacity), bound


def pack_plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[Pattern, int]], int]:
    """Patterns and how many sequences take each, which together hold every piece of the histogram exactly once; and a
    number of sequences that no packing is below."""
    need = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        need[length] = n
    if not need.any():
        return [], 0
    plans, bounds = [best_fit({k: n for k, n in histogram.items() if n}, capacity)], []
    for rate in RATES:
        amounts, _, bound = weighted_amounts(need, capacity, rate, rounds, SHARE)
        whole, left = rounded(amounts, need)
        rest, _ = settled(left, capacity, rate, rounds) if left.any() else (Counter(), 0.0)
        plan, other = settled(need, capacity, rate, rounds)
        plans += [whole + rest, plan]
        bounds += [bound, other]
    fewest = min(plans, key=lambda p: sum(p.values()))
    return sorted(fewest.items(), reverse=True), int(np.ceil(max(bounds) - 1e-6))


class SegmentTokenizer:
    """The ids of a tokenizer file, by its rank file's merges for segments, which are cached.

    Texts that hold a special token's string or rarer white space go through the tokenizer file as a whole.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import re

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.merge = tiktoken.Encoding("segments", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={}).encode_ordinary
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.apart = re.compile("|".join([f"[{_ODD_SPACE}\x1c-\x1f]", *map(re.escape, special)]))
        self.spaced: dict[str, bytes] = {}

    def ids(self, texts: list[str], cache_entries: int = 150_000) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers."""
        out = []
        pack = lambda ids: array("I", ids).tobytes()
        if len(self.spaced) > cache_entries:
            again = set()
            for t in texts:
                again.update(t.replace("\n", " \n").split(" "))
            self.spaced = {s: self.spaced[s] for s in again.intersection(self.spaced)}
        spaced, merge = self.spaced, self.merge
        for t in texts:
            if self.apart.search(t):
                out.append(pack(self.whole.encode(t, add_special_tokens=False).ids))
            elif "  " in t or "\n\n" in t or " \n" in t or "\n " in t:
                out.append(pack(merge(t)))
            else:  # before a single space or line end, a new pre-token begins
                head, *rest = t.replace("\n", " \n").split(" ")
                for s in set(rest).difference(spaced):
                    spaced[s] = pack(merge(s if s[:1] == "\n" else " " + s))
                out.append(pack(merge(head)) + b"".join(map(spaced.__getitem__, rest)))
        return out


_TOKENIZERS: dict[tuple, SegmentTokenizer] = {}


def tokenizer(*paths: str) -> SegmentTokenizer:
    """The tokenizer of this Python worker."""
    if paths not in _TOKENIZERS:
        _TOKENIZERS[paths] = SegmentTokenizer(*paths)
    return _TOKENIZERS[paths]


def cut(n_tokens: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces: only the first may be shorter than the capacity."""
    first = (n_tokens - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n_tokens, capacity))]


def tokenized_pieces(docs: DataFrame, paths: tuple[str, str, str], capacity: int = CAPACITY, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the id column, piece, start, length, ids_crc32 and, unless with_ids is false, ids.

    Every document ends with END_ID, so a null or empty text is one piece of one token.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    end = array("I", [END_ID]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(*paths)
        for batch in batches:
            for lo, texts in text_chunks(batch.column(1), CHUNK_BYTES):
                rows, piece, start, length, crc, parts = [], [], [], [], [], []
                for i, ids in enumerate(tok.ids(texts)):
                    ids += end
                    for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                        part = ids[4 * s : 4 * (s + n)]
                        rows.append(lo + i)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            parts.append(np.frombuffer(part, "<u4").astype(np.int32))
                out = {
                    id_col: batch.column(0).take(pa.array(rows, pa.int64())), "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array(parts, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (length, and other columns): places without gaps from 0. Columns of these two
    names are replaced, such named as in INNER are left out. Null and repeated ids do no harm.

    Pieces of one length are numbered, and the plan says which numbers go to which sequences. A piece longer than the
    capacity raises an error; an empty table gives an empty one.
    """
    pieces = stored(pieces.drop("sequence_id", "offset", *INNER).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    if histogram and not 0 < max(histogram) <= capacity:
        raise ValueError(f"a piece of {max(histogram)} tokens does not fit {capacity}")
    plan, _ = pack_plan(histogram, capacity)
    slots, base = [], 0  # (length, numbers before, first sequence, pieces of the length in it, their offset)
    before: Counter = Counter()
    for pattern, n in plan:
        offset = 0
        for length, k in sorted(Counter(pattern).items(), reverse=True):
            slots.append((length, before[length], base, k, offset))
            before[length] += n * k
            offset += length * k
        base += n
    slots.sort()
    at = np.array(slots, np.int64).reshape(-1, 5)
    keys = (at[:, 0] << 48) + at[:, 1]
    names = [f.name for f in pieces.schema if f.name != "_row"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_n"))
            s = at[np.searchsorted(keys, (length << 48) + n, "right") - 1]
            k = n - s[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(s[:, 2] + k // np.maximum(s[:, 3], 1)), pa.array(s[:, 4] + k % np.maximum(s[:, 3], 1) * length)],
                names=[*names, "sequence_id", "offset"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "_row")
    counted = numbered(pieces, ["length"], "_row", sum(histogram.values()), "_n")
    return counted.mapInArrow(tidy(place), f"{kinds}, sequence_id long, offset long")


def public_paths() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tokenized_pieces(table(spark, sf_dir, "documents"), public_paths(), with_ids=False))
