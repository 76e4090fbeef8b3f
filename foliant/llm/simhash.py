"""SimHash fingerprints, and all pairs of them within a Hamming distance, by vantage-point trees.

A tree splits fingerprints by their Hamming distance to a vantage point. By the triangle inequality, what lies within r
of a fingerprint at distance d is on the inner side only if d - r is within the split radius, on the outer side only if
d + r is beyond it. The upper levels of a tree make shards: a fingerprint lives in one, and also visits those that its
ball overlaps; the lower levels are built inside a shard and pruned likewise.

Over all 64 bits such bounds prune little (random fingerprints are about 32 apart, give or take 4). Two fingerprints
within distance D differ in at most D // 4 bits of one of four 16-bit parts, so each part has a tree of its own, with
that small radius, and pairs found there are checked over all bits: no pair is missed and none is added.

Texts of a given Jaccard similarity of shingle sets (`similar_classes`) are first sought by fingerprints of several
lanes, within wide limits; what is linked counts only once the sets themselves have been compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.bpe import text_chunks
from foliant.llm.common import few_files, stored, table, tidy
from foliant.llm.components import components

SEED, PARTS, PART_BITS = 42, 4, 16
#: Fingerprints drawn to place the upper levels of the trees, about; they decide balance, never results.
TREE_SAMPLE = 8192
#: A shard's share of fingerprints aimed at, and the most that one task holds (a larger shard is cut into a grid).
SHARD_ROWS, TASK_HOMES, TASK_VISITS = 20_000, 60_000, 400_000
#: The shingles of candidates that one task compares, about (a larger class is cut into a grid).
TASK_SHINGLES = 2_000_000


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of the shingles of a text's words, A-Z lowered, repeats included; a shorter text is one shingle."""
    words = text.lower().split()  # of bytes: A-Z only, and white space is U+0020 and U+0009 to U+000D
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = map(b" ".join, zip(*(words[k:] for k in range(size))))
    return np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, len(words) - size + 1)


def remix(h: np.ndarray, lane: int) -> np.ndarray:
    """Other 64 bits of the same hashes, for fingerprints of more than one lane; lane 0 is the hash itself."""
    if not lane:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64((lane * 0x9E3779B97F4A7C15) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def simhash(h: np.ndarray, lanes: int = 1) -> list[int]:
    """A bit is 1 if it is set in over half of the hashes."""
    out = []
    for lane in range(lanes):
        counts, own = np.zeros(64, np.int64), remix(h, lane)
        for lo in range(0, len(own), 1 << 16):
            bits = np.unpackbits(own[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int32)
        out.append(int(np.packbits(counts * 2 > len(own), bitorder="little").view(np.int64)[0]))
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fp0 .. of each whole text; a text without words (or null) has zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(shingle_hashes(t.encode(), shingle), lanes) for _, texts in text_chunks(batch.column(1)) for t in texts]
            columns = zip(*fps) if fps else [[]] * lanes
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=[id_col, *(f"fp{k}" for k in range(lanes))])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, " + ", ".join(f"fp{k} long" for k in range(lanes)))


def part_values(fp: np.ndarray, part: int) -> np.ndarray:
    return (fp.view(np.uint64) >> np.uint64(part * PART_BITS)).astype(np.uint16)


class VantageTree:
    """Upper levels of a tree over 16-bit values; leaves are shards, numbered from 0."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.leaves = 0
        self.root = self._build(sample, leaves)

    def _build(self, sample: np.ndarray, leaves: int):
        if leaves > 1 and len(sample) > 1:
            tried = sample[:: max(1, len(sample) // 8)][:8]  # the vantage point that spreads the sample most
            vantage = max(tried, key=lambda v: np.bitwise_count(sample ^ v).std())
            d = np.bitwise_count(sample ^ vantage)
            radius = int(np.median(d))
            if radius >= d.max():
                radius = int(d.max()) - 1
            if radius >= d.min():
                return vantage, radius, self._build(sample[d <= radius], leaves // 2), self._build(sample[d > radius], leaves - leaves // 2)
        self.leaves += 1
        return self.leaves - 1

    def visits(self, values: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves with the rows of values whose ball of that reach overlaps them. With reach 0: their homes."""
        stack = [(self.root, np.arange(len(values)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if isinstance(node, int):
                yield node, rows
                continue
            vantage, radius, inner, outer = node
            d = np.bitwise_count(values[rows] ^ vantage).astype(np.int16)
            stack += [(inner, rows[d - reach <= radius]), (outer, rows[d + reach > radius])]


def near_values(visitors: np.ndarray, homes: np.ndarray, reach: int, leaf: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of values within reach, by a vantage-point tree over homes that all visitors descend together."""
    stack = [(np.arange(len(visitors)), np.arange(len(homes)))]
    while stack:
        q, h = stack.pop()
        if not len(q) or not len(h):
            continue
        if len(h) > leaf:
            vantage = homes[h[len(h) // 2]]
            d = np.bitwise_count(homes[h] ^ vantage).astype(np.int16)
            radius = int(np.median(d))
            if radius >= d.max():
                radius = int(d.max()) - 1
            if radius >= d.min():
                e = np.bitwise_count(visitors[q] ^ vantage).astype(np.int16)
                stack += [(q[e - reach <= radius], h[d <= radius]), (q[e + reach > radius], h[d > radius])]
                continue
        for lo in range(0, len(q), 1 << 14):
            a, b = np.nonzero(np.bitwise_count(visitors[q[lo : lo + (1 << 14)], None] ^ homes[None, h]) <= reach)
            yield q[lo + a], h[b]


class Forest:
    """Classes of rows under links; the label of a class is its smallest row."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def linked_in_shard(fp: np.ndarray, home: np.ndarray, visit: np.ndarray, part: int, distances: tuple[int, int], reach: int, block: int = 1 << 21) -> np.ndarray:
    """Classes of a shard's fingerprints (rows x lanes) under the links between homes and visitors."""
    first, total = distances
    forest = Forest(len(fp))
    fp = np.ascontiguousarray(fp).view(np.uint64)  # bits of a negative integer are counted wrongly
    value = part_values(np.ascontiguousarray(fp[:, part // PARTS]), part % PARTS)

    def grouped(rows: np.ndarray):
        rows = rows[np.argsort(value[rows], kind="stable")]
        values, start, count = np.unique(value[rows], return_index=True, return_counts=True)
        return rows, values, start, count

    q_rows, q_values, q_start, q_count = grouped(np.nonzero(visit)[0])
    h_rows, h_values, h_start, h_count = grouped(np.nonzero(home)[0])

    def check(i: np.ndarray, j: np.ndarray) -> None:
        both = home[i]  # a pair of homes turns up twice
        once = ~both | (i < j)
        i, j = i[once], j[once]
        d = np.bitwise_count(fp[i, 0] ^ fp[j, 0]).astype(np.int32)
        ok = d <= first
        i, j, d = i[ok], j[ok], d[ok]
        for lane in range(1, fp.shape[1]):
            d += np.bitwise_count(fp[i, lane] ^ fp[j, lane])
            ok = d <= total
            i, j, d = i[ok], j[ok], d[ok]
        ok = d <= total
        if ok.any():
            forest.link(i[ok], j[ok])

    for a, b in near_values(q_values, h_values, reach):
        pairs = q_count[a] * h_count[b]
        ends = np.cumsum(pairs)
        lo = 0
        while lo < len(a):
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + block, "right")))
            if hi == lo + 1 and pairs[lo] > block:  # two large groups: by rows
                js = h_rows[h_start[b[lo]] : h_start[b[lo]] + h_count[b[lo]]]
                step = max(1, block // len(js))
                for k in range(0, q_count[a[lo]], step):
                    i = q_rows[q_start[a[lo]] + k : q_start[a[lo]] + min(k + step, q_count[a[lo]])]
                    check(np.repeat(i, len(js)), np.tile(js, len(i)))
            else:
                n = pairs[lo:hi]
                which = np.repeat(np.arange(lo, hi), n)
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                width = h_count[b[which]]
                check(q_rows[q_start[a[which]] + k // width], h_rows[h_start[b[which]] + k % width])
            lo = hi
    return forest.label


def link_fingerprints(distinct: DataFrame, lanes: int, distances: tuple[int, int], reach: int | None = None) -> DataFrame:
    """distinct: fp0 .. of distinct fingerprints. Returns links u, v of nodes that connect what lies within distances.

    A fingerprint of one lane is its own node; with more lanes, several may share fp0, and the column `node` tells them
    apart. distances: the most bits that may differ in lane 0, and in all lanes. With a reach, what differs in no more
    bits than that in one 16-bit part of any lane is compared, and other pairs are missed; without, none is. A task
    gives a link from each of its fingerprints to the smallest of its class, so links number no more than the rows it
    read.
    """
    spark = distinct.sparkSession
    names = [f"fp{k}" for k in range(lanes)]
    distinct = distinct.select(F.col("fp0").alias("node") if lanes == 1 else "node", *names)
    n = distinct.count()
    leaves = 1 << max(2, min(10, int(np.ceil(np.log2(max(1, n / SHARD_ROWS))))))
    drawn = distinct.where(F.pmod(F.xxhash64("fp0", F.lit("tree")), F.lit(max(1, n // TREE_SAMPLE))) == 0).select(*names).toArrow()
    trees = [VantageTree(np.sort(part_values(drawn.column(c).to_numpy(), p)), leaves) for c in (names[:1] if reach is None else names) for p in range(PARTS)]
    reach = distances[0] // PARTS if reach is None else reach

    def placed(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """part, leaf, rows that visit it, and which of them live there. Of two shards that overlap each other's
        fingerprints, only the later one's go visiting."""
        for p, tree in enumerate(trees):
            values = part_values(batch.column(names[p // PARTS]).to_numpy(), p % PARTS)
            home = np.zeros(len(values), np.int64)
            for leaf, rows in tree.visits(values, 0):
                home[rows] = leaf
            for leaf, rows in tree.visits(values, reach):
                rows = rows[home[rows] >= leaf]
                yield p, leaf, rows, home[rows] == leaf

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(p, leaf, int(own.sum()), len(rows)) for p, leaf, rows, own in placed(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4, names=["part", "leaf", "homes", "visits"])

    sizes = distinct.select(*names).mapInArrow(tidy(tally), "part long, leaf long, homes long, visits long").groupBy("part", "leaf").agg(F.sum("homes"), F.sum("visits")).collect()  # at most 4 x lanes x 1024 rows
    grid = {(r[0], r[1]): (-(-r[2] // TASK_HOMES) or 1, -(-r[3] // TASK_VISITS) or 1) for r in sizes}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mixed = remix(batch.column("node").to_numpy().view(np.uint64), 7)
            for p, leaf, rows, own in placed(batch):
                if not len(rows):
                    continue
                hs, vs = grid[p, leaf]
                whole = batch.take(pa.array(rows))
                h, v = (mixed[rows] >> np.uint64(8)) % np.uint64(hs), (mixed[rows] >> np.uint64(32)) % np.uint64(vs)
                for i in range(hs):
                    for j in range(vs):
                        home, visit = own & (h == i), v == j
                        keep = np.nonzero(home | visit)[0]
                        if len(keep):
                            cell = ((p * 1024 + leaf) << 32) + (i << 16) + j
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(keep), cell)), pa.array(own[keep]), pa.array(home[keep]), pa.array(visit[keep]), *whole.take(pa.array(keep)).columns],
                                names=["cell", "own", "home", "visit", "node", *names],
                            )

    def search(key: tuple, cell: pa.Table) -> pa.Table:
        fp = np.stack([cell.column(c).to_numpy() for c in names], axis=1)
        node = cell.column("node").to_numpy()
        order = np.lexsort([node, *fp.T[::-1]])
        fp, node = fp[order], node[order]
        flag = {c: cell.column(c).to_numpy(zero_copy_only=False)[order] for c in ("own", "home", "visit")}
        # in a grid, a home may meet another home as a visitor: rows are in one order everywhere
        label = linked_in_shard(fp, flag["home"], flag["visit"], (key[0].as_py() >> 32) // 1024, distances, reach)
        rows = np.nonzero(label != np.arange(len(label)))[0]
        return pa.table({"u": pa.array(node[rows]), "v": pa.array(node[label[rows]])})

    lanes_sql = ", ".join(f"{c} long" for c in names)
    dealt = distinct.mapInArrow(tidy(deal), f"cell long, own boolean, home boolean, visit boolean, node long, {lanes_sql}")
    return dealt.groupBy("cell").applyInArrow(search, "u long, v long").where("u <> v")


def near_duplicate_classes(docs: DataFrame, shingle: int = 4, distances: tuple[int, int] = (4, 4), lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fp0 .., component_id: the smallest id that links of fingerprints reach. One row per row of docs.

    Equal texts share a fingerprint and so a component. Null ids are reached but never the smallest; a component of
    null ids alone has a null component_id. Texts without words have fingerprint zero and are linked like any other.
    Other columns are not read; an empty table gives no rows.
    """
    names = [f"fp{k}" for k in range(lanes)]
    rows = stored(fingerprints(docs, shingle, lanes, id_col, text_col), "fingerprints")
    node = F.col("fp0") if lanes == 1 else F.monotonically_increasing_id()
    n = rows.count()
    distinct = stored(few_files(rows.groupBy(*names).agg(F.min(id_col).alias("least")), n).withColumn("node", node), "distinct-fingerprints")
    roots = components(link_fingerprints(distinct, lanes, distances))
    inside = stored(few_files(distinct.join(roots, "node").select(*names, "least", "root"), n), "linked")
    smallest = inside.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = inside.join(smallest, "root").select(*names, "component_id")
    classes = distinct.join(linked, names, "left").select(*names, F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(classes, names)


def shingle_set(text: str, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text.encode(), size))


def alike_in_cell(shingles: np.ndarray, sizes: np.ndarray, block: np.ndarray, similarity: float, most: int = 1 << 20) -> np.ndarray:
    """Classes of sets (their shingles one after the other, and their sizes) under Jaccard similarities of at least that.
    Where there are two blocks, only sets of different blocks are compared; sets that are in one class already are not.
    About `most` shingles are compared with a set at once."""
    forest, n = Forest(len(sizes)), len(sizes)
    order = np.argsort(shingles, kind="stable").astype(np.int32)
    first = np.ones(len(order), bool)
    first[1:] = shingles[order[1:]] != shingles[order[:-1]]
    code = np.empty(len(order), np.int32)
    code[order] = np.cumsum(first, dtype=np.int32) - 1
    del order, first
    shared = np.bincount(code)[code] > 1  # others count in the size only
    kept = np.bincount(np.repeat(np.arange(n, dtype=np.int32), sizes)[shared], minlength=n)
    flat = code[shared]
    del code, shared
    start = np.cumsum(kept) - kept
    mark, across = np.zeros(int(flat.max(initial=0)) + 1, bool), len(np.unique(block)) > 1
    for i in range(n):
        few, many = np.minimum(sizes[i], sizes[i + 1 :]), np.maximum(sizes[i], sizes[i + 1 :])
        apart = (forest.label[i + 1 :] != forest.label[i]) & (few >= similarity * many - 1e-6)
        if across:
            apart &= block[i + 1 :] != block[i]
        js = np.nonzero(apart & (kept[i + 1 :] > 0))[0] + i + 1
        if not len(js) or not kept[i]:
            continue
        own = flat[start[i] : start[i] + kept[i]]
        mark[own] = True
        done = np.cumsum(kept[js])
        lo = 0
        while lo < len(js):
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + most, "right")))
            some = js[lo:hi]
            ends = np.cumsum(kept[some])
            at = np.arange(ends[-1]) + np.repeat(start[some] - ends + kept[some], kept[some])
            both = np.add.reduceat(mark[flat[at]], ends - kept[some], dtype=np.int64)
            some = some[both / (sizes[i] + sizes[some] - both) >= similarity]
            forest.link(np.full(len(some), i), some)
            lo = hi
        mark[own] = False
    return forest.label


def link_alike(members: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """members: candidate (a class of candidates), node, n_shingles, text. Returns links u, v of nodes that connect what is
    at least so similar in each class. A row goes to as many tasks as its class has blocks of TASK_SHINGLES."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in text_chunks(batch.column(4)):
                found = [shingle_set(t, shingle).view(np.int64) for t in texts]
                rows = batch.slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(found, pa.list_(pa.int64()))], names=["candidate", "node", "blocks", "block", "shingles"])

    def search(cell: pa.Table) -> pa.Table:
        node, block = cell.column("node").to_numpy(), cell.column("block").to_numpy()
        column = cell.column("shingles").combine_chunks()
        label = alike_in_cell(column.flatten().to_numpy(), pc.list_value_length(column).to_numpy().astype(np.int64), block, similarity)
        rows = np.nonzero(label != np.arange(len(label)))[0]
        return pa.table({"u": pa.array(node[rows]), "v": pa.array(node[label[rows]])})

    blocks = members.groupBy("candidate").agg(F.ceil(F.sum("n_shingles") / F.lit(TASK_SHINGLES)).cast("long").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    blocks = blocks.select("candidate", F.greatest("blocks", F.lit(1)).alias("blocks"))
    dealt = members.join(blocks, "candidate").select("candidate", "node", "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("block"), "text")
    cells = dealt.mapInArrow(tidy(sets), "candidate long, node long, blocks long, block long, shingles array<long>")
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return cells.groupBy("candidate", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).applyInArrow(search, "u long, v long")


def similar_classes(docs: DataFrame, shingle: int, similarity: float, limit: int, reach: int, lanes: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, component_id: the smallest id that links of texts reach, where a link joins texts whose sets of word
    shingles have at least that Jaccard similarity. One row per row of docs; ids must be whole and no two alike.

    Links are sought by SimHash of the sets (a shingle counts once), among fingerprints that differ in at most `limit`
    bits of all lanes and in at most `reach` of one 16-bit part; every link is checked on the sets. Texts without words
    are one class. Other columns are not read.
    """
    names = [f"fp{k}" for k in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[int]] = [[] for _ in range(lanes + 3)]
            for _, texts in text_chunks(batch.column(1)):
                for t in texts:
                    own = shingle_set(t, shingle)
                    digest = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64).tolist()
                    for column, value in zip(columns, [*simhash(own, lanes), *digest, len(own)]):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=[id_col, *names, "set0", "set1", "n_shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in [*names, "set0", "set1", "n_shingles"])
    rows = stored(docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, {longs}"), "fingerprints")
    distinct = rows.groupBy("set0", "set1", *names, "n_shingles").agg(F.min(id_col).alias("least"))
    n = rows.count()
    distinct = stored(few_files(distinct, n).withColumn("node", F.monotonically_increasing_id()), "distinct-sets")
    near = components(link_fingerprints(distinct, lanes, (64, limit), reach)).select("node", F.col("root").alias("candidate"))
    members = distinct.join(near, "node").select("candidate", "node", "n_shingles", F.col("least").alias(id_col))
    roots = components(link_alike(members.join(docs.select(id_col, F.col(text_col).alias("text")), id_col), shingle, similarity))
    inside = stored(few_files(distinct.join(roots, "node").select("node", "least", "root"), n), "linked")
    smallest = inside.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = inside.join(smallest, "root").select("node", "component_id")
    classes = distinct.join(linked, "node", "left").select("set0", "set1", F.coalesce("component_id", "least").alias("component_id"))
    return rows.select(id_col, "set0", "set1").join(classes, ["set0", "set1"]).select(id_col, "component_id")


def op2_simhash_vp_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")
