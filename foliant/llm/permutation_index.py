"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots in direction, and by its length. A few hundred pivots are drawn,
well under the rows, of which a prefix counts, so the inverted file of a pivot posts some of the vectors, each with the
rank that the pivot has for it. A query adds up, over the files of its own nearest pivots alone, what the induced footrule
distance (a pivot that is missing counts as rank `prefix`) saves for each vector posted there. A line turns that into a
cosine; the vectors for which cosine times length is largest are ranked again by the inner product itself.

The line, and the share of a shard that is ranked again, are fitted once for the whole index, on a bounded sample of rows
and of probes that are not asked: so many as find `target` of the probes' true neighbours in the sample.

Every row is indexed. A shard's files are built once for QUERY_ROWS queries, and queries are sent to the shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.common import matrix, partitions, searched, stored, table

#: Pivots, at most (drawn by a hash of the id: a bounded sample), rows for each of them, at least, and how many pivots
#: represent a vector.
PIVOTS, PIVOT_ROWS, PREFIX = 512, 8, 64
#: Part of the probes' true neighbours that the fitted share must find; rows and probes that it is fitted on, at most.
TARGET, FIT_ROWS, FIT_PROBES = 0.96, 16_384, 256
#: Cosines of pivots: no more than the first, or the next where too few pivots are left. Only copies never count.
ALIKE = (0.7, 0.8, 0.9, 0.95, 0.99, 0.999, 1 - 1e-9)
#: Rows of a shard (at least and at most), and queries for which its files are built once: more than it has rows.
SHARD_ROWS, QUERY_ROWS = (16_384, 65_536), 1 << 18


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array<double>), dim: rows with an id, whose vectors are whole, finite and not zero."""
    v = F.col(vector_col).cast("array<double>")
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    ).withColumn("dim", F.size("v"))


def nearest_pivots(unit: np.ndarray, pivots: np.ndarray, prefix: int, block: int = 1024) -> np.ndarray:
    """The `prefix` nearest pivots of each direction, nearest first; of equally near ones the first."""
    out = np.empty((len(unit), prefix), np.int16)
    for lo in range(0, len(unit), block):
        near = unit[lo : lo + block] @ pivots.T
        some = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix] if prefix < near.shape[1] else np.broadcast_to(np.arange(prefix), near.shape)
        some = np.sort(some, axis=1)
        order = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
        out[lo : lo + block] = np.take_along_axis(some, order, axis=1)
    return out


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors (none of them zero) scaled to length 1, and their lengths."""
    most = np.abs(x).max(axis=1, initial=0, keepdims=True)
    x = x / most
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / length, (most * length)[:, 0]


def spread_pivots(drawn: np.ndarray, most: int, alike: tuple[float, ...] = (0.7,)) -> np.ndarray:
    """The first directions drawn that are no near copies of one chosen before: a common vector gives one pivot. The
    next limit of the cosine holds where the one before leaves too few."""
    chosen: list[np.ndarray] = []
    for limit in alike:
        best = np.max(drawn @ np.stack(chosen).T, axis=1) if chosen else np.full(len(drawn), -1.0)
        for k, x in enumerate(drawn):
            if len(chosen) == most:
                break
            if best[k] < limit:
                chosen.append(x)
                best = np.maximum(best, drawn @ x)
    return np.stack(chosen) if chosen else drawn


class InvertedFiles:
    """Of each pivot, the rows that have it among their nearest ones, and its rank for them."""

    def __init__(self, near: np.ndarray, pivots: int):
        self.rows, self.prefix = near.shape
        order = np.argsort(near.reshape(-1), kind="stable")
        self.posted = (order // self.prefix).astype(np.int32)
        self.rank = (order % self.prefix).astype(np.int32)
        self.start = np.searchsorted(near.reshape(-1)[order], np.arange(pivots + 1))

    def savings(self, asked: np.ndarray) -> np.ndarray:
        """What each row saves in the footrule distance to a query, given the query's nearest pivots."""
        lo, hi = self.start[asked], self.start[asked + 1]
        spans = [slice(a, b) for a, b in zip(lo.tolist(), hi.tolist())]
        rank = np.maximum(np.concatenate([self.rank[s] for s in spans]), np.repeat(np.arange(len(asked)), hi - lo))
        return np.bincount(np.concatenate([self.posted[s] for s in spans]), self.prefix - rank, self.rows)


class PermutationIndex:
    """A shard's rows by id, equal vectors as one entry of the inverted files. Without pivots, all entries are ranked."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray | None, prefix: int):
        order = np.argsort(ids, kind="stable")
        self.ids, x = ids[order], x[order]
        raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1])))[:, 0]
        _, first, member = np.unique(raw, return_index=True, return_inverse=True)
        self.copies = np.argsort(member, kind="stable")  # of each entry its rows, smallest id first
        self.begin = np.searchsorted(member[self.copies], np.arange(len(first) + 1))
        self.distinct, self.pivots, self.prefix = x[first], pivots, prefix
        if pivots is not None:
            unit, self.length = directions(self.distinct)
            self.files = InvertedFiles(nearest_pivots(unit, pivots, prefix), len(pivots))

    def nearest_of(self, q: np.ndarray) -> np.ndarray:
        """The nearest pivots of each query."""
        return nearest_pivots(directions(q)[0], self.pivots, self.prefix).astype(np.int64)

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, share: float, line: tuple[float, float]) -> pa.RecordBatch:
        own = np.searchsorted(self.ids, query_ids, "right") - np.searchsorted(self.ids, query_ids, "left")
        asked = None if self.pivots is None else self.nearest_of(q)
        n, out = len(self.distinct), ([], [], [])
        for i, query in enumerate(query_ids.tolist()):
            most = k + int(own[i])  # rows of the query's own id are no candidates
            keep = n if asked is None else min(n, max(int(np.ceil(share * n)), most))
            found = np.arange(n)
            if keep < n:
                likely = self.length * (line[0] + line[1] * self.files.savings(asked[i]))
                found = np.nonzero(likely >= np.partition(likely, n - keep)[n - keep])[0]
            with np.errstate(over="ignore", invalid="ignore"):
                score = (self.distinct[found] * q[i]).sum(axis=1)
            value = np.where(np.isnan(score), -np.inf, score)  # infinite less infinite ranks last
            if len(found) > most:
                high = value >= np.partition(value, len(value) - most)[len(value) - most]
                found, score, value = found[high], score[high], value[high]
            # of equal vectors the smallest ids are enough
            rows = np.concatenate([self.copies[self.begin[f] : min(self.begin[f + 1], self.begin[f] + most)] for f in found])
            times = np.minimum(np.diff(self.begin)[found], most)
            score, value = np.repeat(score, times), np.repeat(value, times)
            other = self.ids[rows] != query
            rows, score, value = rows[other], score[other], value[other]
            best = np.lexsort((self.ids[rows], -value))[:k]
            for part, x in zip(out, (np.full(len(best), query), self.ids[rows][best], score[best])):
                part.append(x)
        columns = [np.concatenate(x) if x else np.zeros(0) for x in out]
        kinds = pa.int64(), pa.int64(), pa.float64()
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["query_id", "id", "score"])


def fitted(ids: np.ndarray, x: np.ndarray, probe_ids: np.ndarray, probes: np.ndarray, pivots: np.ndarray, prefix: int, sought: int, target: float) -> tuple[float, tuple[float, float]]:
    """The share of entries to rank again, and the line (base and slope) from savings to cosines: what finds `target` of
    the `sought` nearest rows of the probes, whose own rows do not count, among the rows of a sample."""
    sample = PermutationIndex(ids, x, pivots, prefix)
    unit, length = directions(sample.distinct)
    seen = [sample.files.savings(asked) for asked in sample.nearest_of(probes)]
    cosine = directions(probes)[0] @ unit.T
    s, c = np.concatenate(seen), cosine.reshape(-1)
    spread = ((s - s.mean()) ** 2).mean()
    slope = max(((s - s.mean()) * (c - c.mean())).mean() / spread, 1e-9) if spread else 1e-9
    base = c.mean() - slope * s.mean()
    depths = []
    for probe, saved, near in zip(probe_ids, seen, cosine):
        likely, true = length * (base + slope * saved), length * near
        true[(sample.ids[sample.copies[sample.begin[:-1]]] == probe) & (np.diff(sample.begin) == 1)] = -np.inf
        best = np.argpartition(-true, min(sought, len(true)) - 1)[:sought]
        depths.append(len(likely) - np.searchsorted(np.sort(likely), likely[best], "left"))
    return float(np.quantile(np.concatenate(depths), target, method="higher")) / len(length), (base, slope)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            pivots: int = PIVOTS, prefix: int = PREFIX, target: float = TARGET) -> DataFrame:
    """The k rows of vectors with the largest inner product for each row of queries (same columns), approximately.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id. Vectors of
    different lengths have no inner product: a query's candidates are those of its own length; of lengths other than the
    commonest all candidates are ranked. A query's own id is no candidate of it; of rows that repeat a query's id the
    smallest vector asks, repeated other rows are candidates each. A product that is no number ranks last. Ties go to the
    smaller id. Returns query_id, rank (from 1), the id column, score; other columns are not read, and an empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors, id_col, vector_col), "vectors")
    asked = stored(usable(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), "queries")
    lengths = rows.groupBy("dim").agg(F.count("*").alias("n"))
    commonest = lengths.orderBy(F.desc("n"), "dim").first()
    if commonest is None:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    size, n = commonest
    own = rows.where(F.col("dim") == size)
    pivots = max(1, min(pivots, n // PIVOT_ROWS))

    def draw(df: DataFrame, salt: str, most: int) -> tuple[np.ndarray, np.ndarray]:
        t = df.orderBy(F.xxhash64("id", F.lit(salt)), "id").limit(most).select("id", "v").toArrow()
        return t.column("id").to_numpy(), matrix(t.column("v")).reshape(len(t), size)

    drawn = directions(draw(own, "pivot", 2 * pivots)[1])[0]
    chosen = spread_pivots(drawn, pivots)
    if len(chosen) < pivots:  # common vectors fill the draw, or all vectors are alike: draw from distinct ones
        distinct = own.groupBy("v").agg(F.min("id").alias("id"))
        chosen = spread_pivots(np.vstack([drawn, directions(draw(distinct, "pivot", 2 * pivots)[1])[0]]), pivots, ALIKE)
    prefix = max(1, min(prefix, len(chosen)))
    least, most = SHARD_ROWS
    shards = max(1, -(-n // most), min(partitions(spark), n // least))
    sought = min(k, 2 + -(-2 * k // shards))  # what a shard has of the k nearest, with slack
    sample_ids, sample = draw(own, "sample", FIT_ROWS)
    probe_ids, probes = draw(own.join(asked.select("id"), "id", "left_anti"), "probe", FIT_PROBES)
    if not len(probe_ids):  # every row is asked: some of them are probes
        probe_ids, probes = sample_ids[:FIT_PROBES], sample[:FIT_PROBES]
    share, line = fitted(sample_ids, sample, probe_ids, probes, chosen, prefix, sought, target)
    rest = lengths.where(F.col("dim") != size).agg(F.max("n")).first()[0] or 1
    parts = F.when(F.col("dim") == size, F.lit(shards)).otherwise(F.lit(max(1, -(-rest // most))))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    spread = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), m - 1))
    shard = F.xxhash64("dim", "part", "block").alias("shard")
    index = rows.withColumn("part", F.pmod(F.xxhash64("id"), parts)).withColumn("block", spread(F.lit(blocks).cast("long"))).select(shard, "id", "v")
    asks = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks))).withColumn("part", spread(parts.cast("long"))).select(shard, "id", "v", "dim")
    shared = spark.sparkContext.broadcast(chosen)  # at most `pivots` vectors

    def build(ids: np.ndarray, x: np.ndarray):
        held = PermutationIndex(ids, x, shared.value if x.shape[1] == size else None, prefix)
        return lambda query_ids, q, _: held.search(query_ids, q, k, share, line)

    found = searched(index, asks, max(partitions(spark), min(shards * blocks, 10_000)), build, "query_id long, id long, score double")
    value = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc(value), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
