"""A trie of conversation prefixes, merged family by family and then over all.

A family is the conversations of one base id; each borrows up to BORROWED - 1 first turns from the base. Turns travel as
a digest and a number of bytes, never as texts.

1. Turns are numbered by ranges of (conversation, turn), so a conversation of any length is spread over tasks.
2. Families: turns and what they borrow are dealt together by base id and block of depths. A prefix is known by 128 bits:
   running exclusive ors of hashes of (depth, turn). Grouped within the family, prefixes make its small trie: nodes with
   members (a handful) and those that end there.
3. Only these combined nodes are shuffled to be merged: who comes first in each, and how many there are.
4. Sums over subtrees need no walk. The smallest member of a node stands for it; a conversation c stands for the nodes
   of its path below some depth s(c), and for no others. With B(c) the bytes of its first s(c) turns, a node's saved
   bytes are the sum of B over its other members, less what lies above the node, once for each of them; its children are
   the members c with s(c) <= depth < length(c); its leaves the members that stand for a childless end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.common import partitions, stored, table, tidy

#: Conversations of a base id, and the modulus that tells how many turns one borrows.
FAMILY, BORROWED = 5, 9
#: Depths of a family that are dealt to one place.
BLOCK = 4096
NODE = ["depth", "k1", "k2"]


def digested(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (of role and text), bytes (of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    known = conversations.where(F.col("conv_id").isNotNull())
    return known.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest, bytes. Slices of a sorted order are counted apart and then put end to end."""
    order = ["conv_id", F.asc_nulls_first("turn"), "digest", "row"]  # rows that repeat each other can also be split
    turns = digested(conversations).withColumn("row", F.monotonically_increasing_id())
    dealt = turns.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column(0).to_numpy()
            first = np.append(0, np.nonzero(ids[1:] != ids[:-1])[0] + 1)
            at = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
            if ids[0] == last:
                at[: first[1] if len(first) > 1 else len(ids)] += seen
            last, seen = ids[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ids), part, np.int32)), pa.array(at)], names=["conv_id", "digest", "bytes", "slice", "at"])

    runs = stored(dealt.select("conv_id", "digest", "bytes").mapInArrow(tidy(count), "conv_id long, digest binary, bytes long, slice int, at long"), "turn-slices")
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.groupBy("conv_id", "slice").agg(F.count("*").alias("n")).withColumn("start", F.sum("n").over(before)).where("start > 0").drop("n")
    # a slice goes on with one conversation at most: no more rows than slices
    return runs.join(F.broadcast(starts), ["conv_id", "slice"], "left").select("conv_id", (F.col("at") + F.coalesce("start", F.lit(0))).alias("pos"), "digest", "bytes")


def families(turns: DataFrame) -> DataFrame:
    """base, conv_id, own (turns), h (turns given up), lead (turns borrowed), length: of every conversation."""
    each = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    each = each.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % BORROWED).alias("h"))
    lead = F.least("h", F.coalesce("base_own", F.lit(0)))
    bases = each.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    return each.join(bases, "base", "left").select("base", "conv_id", "own", "h", lead.alias("lead"), (lead + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("length"))


def rebuilt(turns: DataFrame, known: DataFrame) -> DataFrame:
    """base, conv_id, depth, digest, bytes, last: the turns of rebuilt conversations, and a row at depth 0 for each."""
    heads = turns.where(F.col("pos") < BORROWED - 1).select(F.col("conv_id").alias("base"), "pos", "digest", "bytes")
    columns = lambda depth: ["base", "conv_id", depth.cast("long").alias("depth"), "digest", "bytes", (depth == F.col("length")).alias("last")]
    borrowed = known.join(heads, "base").where(F.col("pos") < F.col("lead")).select(*columns(F.col("pos") + 1))
    kept = turns.join(known, "conv_id").where(F.col("pos") >= F.col("h")).select(*columns(F.col("lead") + F.col("pos") - F.col("h") + 1))
    roots = known.select("*", F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("bytes")).select(*columns(F.lit(0)))
    return borrowed.union(kept).union(roots)


def family_nodes(rows: DataFrame, longest: int) -> DataFrame:
    """base, depth, k1, k2, bytes, above (bytes up to and with the node), members, ends: the tries of the families."""
    marks = {"k1": F.xxhash64("depth", "digest"), "k2": F.xxhash64(F.lit("second"), "digest", "depth")}
    rows = rows.withColumns({**marks, "block": F.floor(F.col("depth") / BLOCK)}).drop("digest")
    here = Window.partitionBy("base", "block", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = lambda df: df.repartition("base", "block").withColumns({"above": F.sum("bytes").over(here), "k1": F.bit_xor("k1").over(here), "k2": F.bit_xor("k2").over(here)})

    def tries(df: DataFrame) -> DataFrame:
        members = F.array_sort(F.collect_list("conv_id")), F.collect_list(F.when(F.col("last"), F.col("conv_id")))
        grouped = df.groupBy("base", "block", *NODE).agg(F.max("bytes").alias("bytes"), F.max("above").alias("above"), members[0].alias("members"), members[1].alias("ends"))
        return grouped.drop("block")

    if longest < BLOCK:
        return tries(running(rows))
    # blocks after the first go on from those before
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "block").agg(F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"), F.sum("bytes").alias("above"))
    sums = sums.select("conv_id", "block", F.bit_xor("k1").over(earlier).alias("b1"), F.bit_xor("k2").over(earlier).alias("b2"), F.sum("above").over(earlier).alias("b3")).where("block > 0")
    later = running(rows.where("block > 0")).join(sums, ["conv_id", "block"])
    later = later.withColumns({"k1": F.col("k1").bitwiseXOR(F.col("b1")), "k2": F.col("k2").bitwiseXOR(F.col("b2")), "above": F.col("above") + F.col("b3")}).drop("b1", "b2", "b3")
    return tries(running(rows.where("block = 0"))).union(tries(later))


def stand_ins(nodes: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """base, who: for each family a map from conv_id to s (the depth down to which others stand for its nodes), shared
    (bytes of those turns), over (who stands at depth s), leaf (it stands for a childless end) and length."""
    merged = nodes.where("depth > 0").groupBy(*NODE).agg(
        F.sum(F.size("members")).alias("n"), F.min(F.get("members", F.lit(0))).alias("least"), F.sum(F.size("ends")).alias("n_ends"),
    ).where("n > 1")
    met = nodes.join(merged, NODE).select("depth", "above", "least", (F.col("n_ends") < F.col("n")).alias("goes_on"), "ends", F.explode("members").alias("conv_id"))
    other = F.col("least") != F.col("conv_id")
    told = met.groupBy("conv_id").agg(
        F.max(F.when(other, F.col("depth"))).alias("s"), F.max(F.when(other, F.col("above"))).alias("shared"),
        F.max_by("least", F.when(other, F.col("depth"))).alias("over"),
        F.bool_or(~other & F.col("goes_on") & F.array_contains("ends", F.col("conv_id"))).alias("no_leaf"),
    )
    s = F.coalesce("s", F.lit(0)).cast("long")
    leaf = (s < F.col("length")) & ~F.coalesce("no_leaf", F.lit(False))
    who = F.struct(s.alias("s"), F.coalesce("shared", F.lit(0)).cast("long").alias("shared"), F.coalesce("over", F.lit(least)).cast("long").alias("over"), leaf.alias("leaf"), F.col("length").cast("long").alias("length"))
    return known.join(told, "conv_id", "left").groupBy("base").agg(F.map_from_entries(F.collect_list(F.struct("conv_id", who.alias("who")))).alias("who"))


def end_hashes(nodes: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256: of the ids that end at a node. A node's ids pass through one task in order, since the
    hash is sequential, but none of them is held."""
    ends = nodes.select(*NODE, F.explode("ends").alias("conv_id"))
    kinds = pa.int64(), pa.int64(), pa.int64(), pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            out, ids = [], batch.column(3).to_numpy()
            keys = [c.to_numpy() for c in batch.columns[:3]]
            cut = np.nonzero(np.any([np.diff(c) != 0 for c in keys], axis=0))[0] + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(ids)]):
                if a == b:
                    continue
                key, text = tuple(int(c[a]) for c in keys), ",".join(map(str, ids[a:b].tolist())).encode()
                if key == node:
                    digest.update(b"," + text)
                    continue
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[*NODE, "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*node, digest.hexdigest()), kinds)], names=[*NODE, "ends_sha256"])

    dealt = ends.repartition(partitions(ends.sparkSession), *NODE).sortWithinPartitions(*NODE, "conv_id")
    return dealt.mapInArrow(tidy(run), "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations (conv_id, turn, role, text); other columns are not read.

    A null turn comes first; turns of one number go in an order of their own (by a hash of role and text), the same each
    time. Null role or text are empty. Rows without a conv_id belong to no conversation. Rows that repeat are turns
    each; an empty table has no nodes, not even a root. A negative id's base is the next multiple of five towards 0.
    """
    turns = numbered_turns(conversations)
    known = stored(families(turns), "conversations")
    size = known.agg(F.min("conv_id").alias("least"), F.max("length").alias("longest")).first()
    least = size["least"] if size["least"] is not None else 0
    nodes = stored(family_nodes(rebuilt(turns, known), size["longest"] or 0), "family-nodes")
    who: Column = F.transform("members", lambda m: F.col("who")[m])
    total = lambda value: F.aggregate(who, F.lit(0).cast("long"), lambda a, x: a + value(x))
    first = F.get("members", F.lit(0))
    above = F.when(F.col("who")[first]["s"] < F.col("depth") - 1, first).otherwise(F.col("who")[first]["over"])
    told = nodes.join(stand_ins(nodes, known, least), "base").select(
        *NODE, "bytes", "above", F.size("members").cast("long").alias("n"), total(lambda x: x["shared"]).alias("shared"), total(lambda x: x["leaf"].cast("long")).alias("leaves"),
        total(lambda x: ((x["s"] <= F.col("depth")) & (x["length"] > F.col("depth"))).cast("long")).alias("children"),
        F.struct(first.alias("conv_id"), above.alias("parent"), F.col("who")[first]["shared"].alias("shared")).alias("rep"),
    )
    merged = told.groupBy(*NODE).agg(
        F.max("bytes").alias("bytes"), F.max("above").alias("above"), *[F.sum(c).alias(c) for c in ("n", "shared", "leaves", "children")], F.min("rep").alias("rep"),
    )
    saved = F.col("shared") - F.col("rep.shared") - (F.col("n") - 1) * (F.col("above") - F.col("bytes"))
    root = F.col("depth") == 0
    return merged.join(end_hashes(nodes), NODE, "left").select(
        F.col("rep.conv_id").alias("conv_id"), "depth", F.when(~root, F.col("rep.parent")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.when(root & (F.col("children") == 0), 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"), saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), bytes AS (
  SELECT DISTINCT c, list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)) AS b FROM t
), ids AS (
  SELECT c, c - c % 5 AS base, xor(4294967295, list_reduce(b, lambda crc, x: list_reduce(list_concat([xor(crc, x)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
         lambda s, z: xor(s >> 1, 3988292384 * (s & 1))))) % 9 AS h FROM bytes
), turns AS (
  SELECT ids.c, 0 AS own, pos, role, text FROM ids JOIN t ON t.c = ids.base WHERE pos < h
  UNION ALL
  SELECT ids.c, 1 AS own, pos, role, text FROM ids JOIN t ON t.c = ids.c WHERE pos >= h
), paths AS (
  SELECT ids.c, coalesce(list(sha256(length(role) || ':' || role || text) ORDER BY own, pos) FILTER (WHERE text IS NOT NULL), []) AS path,
         coalesce(list(octet_length(encode(text)) ORDER BY own, pos) FILTER (WHERE text IS NOT NULL), []) AS sizes
  FROM ids LEFT JOIN turns USING (c) GROUP BY ids.c
), prefixes AS (
  SELECT c, path, sizes, unnest(range(0, len(path) + 1)) AS depth FROM paths
), nodes AS (
  SELECT depth, array_to_string(path[1:depth], '') AS key, CASE WHEN depth > 0 THEN array_to_string(path[1:depth - 1], '') END AS above, min(c) AS conv_id, count(*) AS n_convs,
         max(CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END) AS bytes, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(path) = depth) AS ends
  FROM prefixes GROUP BY ALL
), below AS (
  SELECT a.key, a.depth, sum((b.n_convs - 1) * b.bytes) AS saved,
         count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM nodes x WHERE x.depth = b.depth + 1 AND x.above = b.key)) AS leaves,
         count(*) FILTER (WHERE b.depth = a.depth + 1) AS children
  FROM nodes a JOIN nodes b ON b.depth >= a.depth AND starts_with(b.key, a.key) GROUP BY a.key, a.depth
)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs, children::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN below USING (key, depth) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.above
"""
