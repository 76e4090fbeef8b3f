"""Byte-level BPE, encoding and decoding, with a rank queue under a hierarchical bitmap.

The queue has a bucket for each merge rank. A bucket holds places in a linked list of symbols; a bitmap of three levels
marks the buckets that hold any, and find-first-set on each level gives the lowest rank. An entry whose pair has
changed meanwhile is stale and skipped. One pre-token of n bytes takes O(n) queue steps, whatever its length.

Short pre-tokens of a batch share one queue: their symbols lie in one array, and a step takes the lowest rank's bucket
of all of them and merges, in each pre-token, its leftmost live place. A pre-token thus sees the same order of merges
as alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from foliant.llm.common import table, tidy

#: Cached segments of a Python worker; beyond it, only those that came again stay. The cache changes no result.
CACHE_ENTRIES = 300_000
#: Pre-tokens of more bytes than this are merged on their own.
LONG_BYTES = 256
#: Bytes of text that are worked on at once, at least one text.
CHUNK_BYTES = 12 << 20

#: White space besides the space and the line end.
_ODD_SPACE = r"\t\x0b-\r\x85\xa0  -     　"
_SPACE = rf" \n{_ODD_SPACE}"
_MARKS = frozenset(".,;:!?|")


class RankQueue:
    """Buckets by rank; pop_rank gives the lowest rank that has entries."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list] = {}
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (len(self.low) // 64 + 1)
        self.top = 0

    def push(self, rank: int, entry) -> None:
        found = self.buckets.get(rank)
        if found is not None:
            found.append(entry)
            return
        self.buckets[rank] = [entry]
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def pop_rank(self) -> tuple[int, list] | None:
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        a = (b << 6) + (self.mid[b] & -self.mid[b]).bit_length() - 1
        rank = (a << 6) + (self.low[a] & -self.low[a]).bit_length() - 1
        self.low[a] &= self.low[a] - 1
        if not self.low[a]:
            self.mid[b] &= self.mid[b] - 1
            if not self.mid[b]:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class BytePairEncoder:
    """Encodes by a table of ranks: of neighbouring symbols, the pair whose joined bytes have the lowest rank merges
    first, the leftmost of equal ones."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.n_ranks = max(ranks.values()) + 1
        self.tokens = [b""] * self.n_ranks
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))
        # between a visible character and a space or line end, a new pre-token always begins
        self.segments = re.compile(r"[ \n]*[^ \n]+|[ \n]+\Z")
        self.odd = re.compile(f"[{_ODD_SPACE}]")
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        byte_pairs = np.full((256, 256), -1, np.int32)
        for i in range(256):
            for j in range(256):
                byte_pairs[i, j] = ranks.get(bytes([i, j]), -1)
        self.byte_pairs = byte_pairs
        self.plain: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, -1 where they don't merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def encode_long(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        n = len(piece)
        token = [int(self.byte_ids[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        current, queue, pairs = [-1] * n, RankQueue(self.n_ranks), self.pairs

        def pair_at(i: int) -> None:
            j = after[i]
            rank = pairs.get(token[i] << 32 | token[j], -1) if j < n else -1
            current[i] = rank
            if rank >= 0:
                queue.push(rank, i)

        for i in range(n - 1):
            pair_at(i)
        while popped := queue.pop_rank():
            rank, places = popped
            places.sort()
            for k, i in enumerate(places):
                if current[i] != rank:
                    continue  # stale
                j = after[i]
                token[i], current[j], token[j] = rank, -1, -1
                after[i] = after[j]
                if after[j] < n:
                    before[after[j]] = i
                pair_at(i)
                lower = 0 <= current[i] < rank
                if before[i] >= 0:
                    pair_at(before[i])
                    lower |= 0 <= current[before[i]] < rank
                if lower and k + 1 < len(places):  # a lower rank came up: it goes before the rest
                    for i in places[k + 1 :]:
                        if current[i] == rank:
                            queue.push(rank, i)
                    break
        return [t for t in token if t >= 0]

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as little-endian unsigned 32-bit integers."""
        if not pieces:
            return []
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int32, len(pieces))
        n = len(data)
        word = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        token = self.byte_ids[data]
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        last = np.cumsum(sizes) - 1
        current = np.full(n + 1, -1, np.int32)  # place n stands for "none"
        current[: n - 1] = self.byte_pairs[data[:-1], data[1:]]
        current[last] = -1
        after[last] = n
        before[np.concatenate([[0], last[:-1] + 1])] = n
        alive = np.ones(n, bool)
        queue = RankQueue(self.n_ranks)

        def push(places: np.ndarray) -> None:
            ranks = current[places]
            known = ranks >= 0
            places, ranks = places[known], ranks[known]
            if len(places):
                order = np.argsort(ranks, kind="stable") if len(ranks) > 1 else np.zeros(1, np.int64)
                places, ranks = places[order], ranks[order]
                cuts = np.nonzero(ranks[1:] != ranks[:-1])[0] + 1
                starts = [0, *cuts.tolist()]
                for lo, hi, rank in zip(starts, [*starts[1:], len(ranks)], ranks[starts].tolist()):
                    queue.push(rank, places[lo:hi])

        push(np.arange(n, dtype=np.int32))
        while popped := queue.pop_rank():
            rank, entries = popped
            places = entries[0] if len(entries) == 1 else np.concatenate(entries)
            places = places[current[places] == rank]  # the rest is stale
            if len(places) > 1:
                if len(entries) > 1:
                    places = np.sort(places)
                first = np.ones(len(places), bool)
                first[1:] = word[places[1:]] != word[places[:-1]]
                if not first.all():
                    queue.push(rank, places[~first])
                    places = places[first]
            if not len(places):
                continue
            gone = after[places]
            beyond = after[gone]
            token[places] = rank
            alive[gone] = False
            current[gone] = -1
            after[places] = beyond
            inner = beyond < n
            before[beyond[inner]] = places[inner]
            current[places] = -1
            a = places[inner]
            current[a] = self.pair_rank(token[a], token[beyond[inner]])
            ahead = before[places]
            linked = ahead < n
            b = ahead[linked]
            current[b] = self.pair_rank(token[b], token[places[linked]])
            push(np.concatenate([a, b]))
        ids = token[alive].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(word[alive], minlength=len(pieces))) * 4).tolist()
        return [ids[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends)]

    def merge_new(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pre-tokens."""
        coded = [p.encode() for p in pieces]
        short = [i for i, p in enumerate(coded) if len(p) <= LONG_BYTES]
        out = dict(zip([pieces[i] for i in short], self.encode_many([coded[i] for i in short])))
        out.update((pieces[i], np.array(self.encode_long(p), "<u4").tobytes()) for i, p in enumerate(coded) if len(p) > LONG_BYTES)
        return out

    def pre_tokens(self, segment: str) -> list[str]:
        body = segment[1:]
        if segment[:1] == " ":
            if body.isalpha():
                return [segment]
            if body[-1:] in _MARKS and body[:-1].isalpha():
                return [segment[:-1], body[-1]]
        return self.pattern.findall(segment)

    def segmented(self, text: str) -> tuple[list[str], list[str]]:
        """Segments as they are, and after them such as begin with a line end or, left out, a space."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or self.odd.search(text):
            return (self.segments.findall(text) if not self.odd.search(text) else [text]), []
        rest = text.replace("\n", " \n").split(" ")
        return [rest.pop(0)], rest

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers.

        A text is cut where a new pre-token always begins: before a single space, or a single line end, that follows
        a visible character. Segments are cached; those that begin with a space are kept without it.
        """
        new_plain, new_spaced = set(), set()
        for t in texts:
            x, y = self.segmented(t)
            new_plain.update(x)
            new_spaced.update(y)
        if len(self.spaced) > CACHE_ENTRIES:  # what comes again stays
            self.spaced = {s: self.spaced[s] for s in new_spaced.intersection(self.spaced)}
        if len(self.plain) > CACHE_ENTRIES:
            self.plain = {s: self.plain[s] for s in new_plain.intersection(self.plain)}
        new_plain.difference_update(self.plain)
        new_spaced.difference_update(self.spaced)
        spaced, pieces, known = self.spaced, {}, {}
        several = []  # segments of more than one pre-token
        for new, cache, lead in ((new_spaced, spaced, " "), (new_plain, self.plain, "")):
            for s in new:
                ps = self.pre_tokens(lead + s if s[:1] != "\n" else s)
                if len(ps) == 1:
                    pieces[ps[0]] = None
                else:
                    several.append((cache, s, ps))
        for _, _, ps in several:
            for p in ps:
                if p not in pieces and p not in known:
                    # what is kept without its space never begins with a line end
                    found = spaced.get(p[1:]) if p[:1] == " " and p[1:2] != "\n" else self.plain.get(p)
                    if found is None:
                        pieces[p] = None
                    else:
                        known[p] = found
        known.update(self.merge_new(list(pieces)))
        for cache, s, ps in several:
            cache[s] = b"".join([known[p] for p in ps])
        for new, cache, lead in ((new_spaced, spaced, " "), (new_plain, self.plain, "")):
            for s in new:
                if s not in cache:
                    cache[s] = known[lead + s if s[:1] != "\n" else s] if s or lead else b""
        one, more = self.plain.__getitem__, spaced.__getitem__
        out = []
        for t in texts:
            x, y = self.segmented(t)
            out.append(b"".join([*map(one, x), *map(more, y)]))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


_ENCODERS: dict[tuple[str, str], BytePairEncoder] = {}


def encoder(path: str, pattern: str) -> BytePairEncoder:
    """The encoder of this Python worker."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = BytePairEncoder(read_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about `most` bytes together, one text at least, and where they begin. Null counts as empty."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
        lo = hi


def encoded(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encodes every whole text and decodes it again. A null text counts as an empty one, which has no ids.

    vocabulary: path of a rank file, known on every executor. Returns the id column, n_tokens, ids_sha256,
    decoded_sha256 and, unless with_ids is false, ids (an array). Null and repeated ids and other columns do no harm.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary, pattern)
        for batch in batches:
            for lo, texts in text_chunks(batch.column(1)):
                coded = bpe.encode_batch(texts)
                out = {
                    id_col: batch.column(0).slice(lo, len(texts)),
                    "n_tokens": pa.array([len(x) // 4 for x in coded], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in coded], pa.string()),
                }
                if with_ids:
                    out["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in coded], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
