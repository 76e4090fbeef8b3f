"""Exact search for the largest integer inner products, by KD-trees.

1. A bounded sample gives the upper levels of a KD-tree, whose cells are the shards; a cell of more rows than a shard may
   hold (one vector may be very common) is split by a hash of the id. Each cell's tight box is taken over all its rows.
2. Every query goes to a shard of the cell with the highest bound: its k-th score there is a floor for the rest.
3. Every query then goes to the other shards whose box can still reach that floor.

In a task, a shard's rows come first and make its tree: median splits of the widest side, a tight box for each node.
Its queries follow in batches, so a task holds one tree and one batch, however many queries there are, and a shard
travels once for QUERY_ROWS of them. A query walks a tree best box first; a box that can't beat the k-th score so far,
at first the propagated one, ends the walk. Every answer is exact, whatever the boxes prune.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.common import matrix, partitions, searched, stored, table, tidy

#: Components are turned into floor(SCALE * x).
SCALE = 1024
#: Vectors that place the upper levels, and their cells at most.
SAMPLE, CELLS = 16_384, 1024
#: Bytes of vectors of a shard, at most, and rows below which a table is not split further.
SHARD_BYTES, SHARD_LEAST = 64 << 20, 4096
#: Queries for which a shard travels once: more than the rows of a shard, so that copies cost less than the queries do.
QUERY_ROWS = 1 << 18
#: Tasks of a wave, at most, where the session asks for fewer; a task may hold several shards, one after the other.
MOST_TASKS = 10_000
#: Distinct vectors of a leaf, at most, and queries that are bounded against a tree at once.
LEAF, BATCH = 128, 64
_LOWEST = np.iinfo(np.int64).min


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array<long>): floor(SCALE * x) of each component x.

    Rows without an id take no part, nor do vectors that are null, hold null or non-finite components, or one so large
    that an inner product of two such vectors might be no long.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.lit(float(SCALE)) * x).alias("v"))
    most = F.least(F.sqrt(F.lit(float(2**62)) / F.greatest(F.size("v"), F.lit(1))), F.lit(float(2**31)))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= most)))
    return rows.select("id", F.transform("v", lambda x: F.floor(x)).alias("v"))


def upper_levels(sample: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Sides and thresholds of the inner nodes of a full tree, in heap order: up to the threshold a vector goes left."""
    side, threshold = np.zeros(2**levels - 1, np.int64), np.zeros(2**levels - 1, np.int64)
    rows = {0: sample}
    for node in range(len(side)):
        x = rows.pop(node)
        if len(x) and x.shape[1]:
            side[node] = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
            threshold[node] = int(np.sort(x[:, side[node]])[(len(x) - 1) // 2])
            left = x[:, side[node]] <= threshold[node]
        else:
            left = np.zeros(len(x), bool)
        rows[2 * node + 1], rows[2 * node + 2] = x[left], x[~left]
    return side, threshold


def cell_of(x: np.ndarray, side: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    for _ in range((len(side) + 1).bit_length() - 1):
        right = x[np.arange(len(x)), side[node]] > threshold[node] if x.shape[1] else np.zeros(len(x), bool)
        node = 2 * node + 1 + right
    return node - len(side)


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product that each query can have with a point of each box."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def exact_kind(size: int, *arrays: np.ndarray) -> type:
    """float64 where all sums of `size` products are whole numbers that it holds exactly: its products are the faster."""
    most = max([1, *(int(np.abs(a).max()) for a in arrays if a.size)])
    return np.float64 if size * most * most < 2**53 else np.int64


class KDTree:
    """ids and x (whole numbers). Equal vectors are one point, of which the k + 1 smallest ids can ever be asked for."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[order], x[order]
        first = np.nonzero(np.append(True, (x[1:] != x[:-1]).any(axis=1)))[0] if len(x) else np.zeros(0, np.int64)
        self.k, points = k, x[first]
        place = np.arange(len(points))
        self.left, self.span, low, high = [], [], [], []
        stack = [(0, len(points), -1)]
        while stack:
            a, b, parent = stack.pop()
            node = len(self.span)
            if parent >= 0:  # the right child is the later one
                self.left[parent] = (self.left[parent][0], node) if self.left[parent] else (node, -1)
            box = points[place[a:b]]
            low.append(box.min(axis=0))
            high.append(box.max(axis=0))
            self.span.append((a, b))
            self.left.append(None)
            if b - a > LEAF:
                widest = int(np.argmax(high[-1] - low[-1]))
                middle = (b - a) // 2
                place[a:b] = place[a:b][np.argpartition(box[:, widest], middle)]
                stack += [(a + middle, b, node), (a, a + middle, node)]
        self.low, self.high, self.points = np.array(low), np.array(high), points[place]
        count = np.diff(np.append(first, len(ids)))[place]
        self.ids = [ids[f : f + min(c, k + 1)] for f, c in zip(first[place].tolist(), count.tolist())]

    def search(self, query_ids: np.ndarray, q: np.ndarray, floor: np.ndarray) -> tuple[list, list, list]:
        """Of each query, the k best rows that reach its floor, its own id left out: places of queries, ids, scores."""
        kind = exact_kind(q.shape[1], self.points, q)
        low, high, points, q = (a.astype(kind) for a in (self.low, self.high, self.points, q))
        at, found, scores = [], [], []
        for lo in range(0, len(q), BATCH):
            reach = bounds(q[lo : lo + BATCH], low, high)
            for i, bound in enumerate(reach.tolist(), lo):
                ids, best = self._walk(q[i], bound, int(query_ids[i]), int(floor[i]), points)
                at.append(np.full(len(ids), i))
                found.append(ids)
                scores.append(best)
        return at, found, scores

    def _walk(self, q: np.ndarray, bound: list, own: int, floor: int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, best, kth = np.zeros(0, np.int64), np.zeros(0, np.int64), floor
        heap = [(-bound[0], 0)]
        while heap:
            reach, node = heapq.heappop(heap)
            if -reach < kth:
                break  # a tie may still have a smaller id
            if self.left[node]:
                for child in self.left[node]:
                    if bound[child] >= kth:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            a, b = self.span[node]
            score = points[a:b] @ q
            hit = np.nonzero(score >= kth)[0]
            if not len(hit):
                continue
            if len(hit) > self.k + 1:  # points that k + 1 others beat can't be among the k best
                hit = hit[score[hit] >= np.partition(score[hit], len(hit) - self.k - 1)[len(hit) - self.k - 1]]
            rows = [self.ids[a + h] for h in hit.tolist()]
            new, value = np.concatenate(rows), np.repeat(score[hit].astype(np.int64), [len(r) for r in rows])
            other = new != own
            ids, best = np.append(ids, new[other]), np.append(best, value[other])
            order = np.lexsort((ids, -best))[: self.k]
            ids, best = ids[order], best[order]
            if len(ids) == self.k:
                kth = max(kth, int(best[-1]))
        return ids, best


def walked(index: DataFrame, asks: DataFrame, k: int, tasks: int) -> DataFrame:
    """index: shard, id, v. asks: shard, id, v, floor. Returns query_id, id, score, at most k rows for each row of asks."""

    def build(ids: np.ndarray, x: np.ndarray):
        tree = KDTree(ids, x, k)

        def search(query_ids: np.ndarray, q: np.ndarray, floor: pa.Array) -> pa.RecordBatch:
            at, found, scores = (np.concatenate(x) for x in tree.search(query_ids, q, floor.to_numpy()))
            return pa.RecordBatch.from_arrays([pa.array(query_ids[at]), pa.array(found), pa.array(scores)], names=["query_id", "id", "score"])

        return search

    return searched(index, asks, tasks, build, "query_id long, id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank. No more than k rows of a query leave a task."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def shard_id(dim: Column, cell: Column, part: Column, block: Column) -> Column:
    return F.xxhash64(dim, cell, part, block)


def top_products(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows with the largest integer inner products for each row of vectors that the condition `queries` names.

    Which rows take part tells `whole_vectors`; empty and zero vectors do. Vectors of different lengths have no inner
    product, so a query's candidates are those of its own length. A query's own id is no candidate of it; of rows that
    repeat a query's id the smallest vector asks, and repeated other rows are candidates each. Ties go to the smaller
    id. Returns query_id, rank (from 1), the id column, score; other columns are not read but by `queries`; an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    rows = stored(whole_vectors(vectors, id_col, vector_col).withColumn("dim", F.size("v")), "whole-vectors")
    asked = whole_vectors(vectors.where(queries), id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    asked = stored(asked.withColumn("dim", F.size("v")), "queries")
    empty = spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    lengths = rows.groupBy("dim").agg(F.count("*").alias("n"))
    commonest = lengths.orderBy(F.desc("n"), "dim").first()
    if commonest is None:
        return empty
    # the upper levels are placed for the commonest length; each other length is a cell of its own
    size, n = commonest
    held = max(SHARD_LEAST, SHARD_BYTES // (8 * max(1, size)))  # rows of a shard
    rest = lengths.where(F.col("dim") != size).agg(F.max(F.col("n") * F.greatest("dim", F.lit(1)))).first()[0] or 0
    others = max(1, -(-8 * rest // SHARD_BYTES))  # shards of each other length
    wanted = max(-(-n // held), min(partitions(spark), n // SHARD_LEAST), 1)
    levels = min(CELLS.bit_length() - 1, math.ceil(math.log2(wanted)))
    sample = matrix(rows.where(F.col("dim") == size).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v"))
    side, threshold = upper_levels(sample, levels)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.full(len(batch), -1, np.int32)
            own = np.nonzero(batch.column(2).to_numpy() == size)[0]
            if len(own):
                cell[own] = cell_of(matrix(batch.column(1).take(pa.array(own))), side, threshold)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["id", "v", "dim", "cell"])

    celled = stored(rows.select("id", "v", "dim").mapInArrow(tidy(placed), "id long, v array<long>, dim int, cell int"), "cells")

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for batch in batches:
            cells, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            for c in np.unique(cells).tolist():
                own = x[cells == c]
                low, high = own.min(axis=0), own.max(axis=0)
                count, l0, h0 = known.get(c, (0, low, high))
                known[c] = count + len(own), np.minimum(l0, low), np.maximum(h0, high)
        columns = list(zip(*((c, *known[c]) for c in known))) or [[]] * 4
        kinds = pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(columns, kinds)], names=["cell", "n", "low", "high"])

    def united(key: tuple, t: pa.Table) -> pa.Table:  # a row for each task that read the cell
        low, high = matrix(t.column("low")).min(axis=0), matrix(t.column("high")).max(axis=0)
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "n": [int(np.sum(t.column("n").to_numpy()))], "low": pa.array([low], pa.list_(pa.int64())), "high": pa.array([high], pa.list_(pa.int64()))})

    box = "cell int, n long, low array<long>, high array<long>"
    partial = celled.where(F.col("dim") == size).select("cell", "v").mapInArrow(tidy(boxes), box)
    cells = partial.groupBy("cell").applyInArrow(united, box).toArrow().sort_by("cell")  # CELLS rows at most
    names, low, high = cells.column("cell").to_numpy(), matrix(cells.column("low")), matrix(cells.column("high"))
    parts = -(-cells.column("n").to_numpy() // held)
    part_counts = np.ones(len(side) + 1, np.int64)
    part_counts[names] = parts

    def routed(asks: DataFrame, first: bool) -> DataFrame:
        """asks (id, v, dim, floor, home_cell, home_part) with cell and part: the home alone, or all but it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, floor = batch.column(0).to_numpy(), batch.column(3).to_numpy()
                own = batch.column(2).to_numpy() == size
                reach = np.zeros((len(batch), len(names)))
                if own.any():
                    q = matrix(batch.column(1).take(pa.array(np.nonzero(own)[0])))
                    kind = exact_kind(size, q, low, high)
                    reach = np.zeros((len(batch), len(names)), kind)
                    reach[own] = bounds(q.astype(kind), low.astype(kind), high.astype(kind))
                row, cell, part = [], [], []
                for i in range(len(batch)):
                    home = int(np.argmax(reach[i])) if own[i] else -1
                    many = int(parts[home]) if own[i] else others
                    start = int(ids[i] % many)
                    if first:
                        to = [(int(names[home]) if own[i] else -1, start)]
                    elif own[i]:
                        hit = np.nonzero(reach[i] >= floor[i])[0].tolist()
                        to = [(int(names[c]), p) for c in hit for p in range(int(parts[c])) if (c, p) != (home, start)]
                    else:
                        to = [(-1, p) for p in range(others) if p != start]
                    row += [i] * len(to)
                    cell += [c for c, _ in to]
                    part += [p for _, p in to]
                taken = batch.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell, pa.int32()), pa.array(part, pa.int32())], names=["id", "v", "dim", "floor", "cell", "part"])

        return asks.select("id", "v", "dim", "floor").mapInArrow(tidy(run), "id long, v array<long>, dim int, floor long, cell int, part int")

    blocks = -(-asked.count() // QUERY_ROWS)
    tasks = max(partitions(spark), min(int(part_counts.sum()) * blocks, MOST_TASKS))
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, blocks))).cast("int")
    many = F.when(F.col("cell") < 0, F.lit(others)).otherwise(F.get(F.array(*[F.lit(int(x)) for x in part_counts]), F.col("cell")))
    part = F.pmod(F.xxhash64("id"), many).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(max(1, blocks) - 1)))
    index = celled.withColumn("part", part).withColumn("block", copies)
    index = index.select(shard_id(F.col("dim"), F.col("cell"), F.col("part"), F.col("block")).alias("shard"), "id", "v")

    def wave(asks: DataFrame, first: bool) -> DataFrame:
        to = routed(asks, first).withColumn("shard", shard_id(F.col("dim"), F.col("cell"), F.col("part"), block))
        return walked(index, to.select("shard", "id", "v", "floor"), k, tasks)

    home = stored(wave(asked.withColumn("floor", F.lit(_LOWEST)), True), "home-wave")
    floors = best_of(home, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("known"))
    asks = asked.join(floors, "id", "left").withColumn("floor", F.coalesce("known", F.lit(_LOWEST)))
    found = home.union(wave(asks, False))
    return best_of(found, k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op11_kd_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


OP11_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM (SELECT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
