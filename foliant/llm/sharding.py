"""Balanced label propagation: linked documents move to the shards of their neighbours, under quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import numbered, stored, table

SHARDS, ROUNDS = 8, 16


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard: sizes differ by one at most."""
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def admit(asked: dict[tuple[int, ...], int], free: list[int]) -> dict[tuple[int, ...], int]:
    """How many of the asked moves (from, to, and maybe a class) may happen. Higher classes come first.

    First rings of moves, which change no shard's size; what is left has no ring and goes into free places, also such
    as other moves leave.
    """
    order = sorted(asked, key=lambda m: ([-c for c in m[2:]], -asked[m], m))
    rest, given, left = dict(asked), dict.fromkeys(asked, 0), list(free)

    def take(moves: list[tuple[int, ...]], n: int) -> None:
        for m in moves:
            rest[m] -= n
            given[m] += n

    for m in order:
        while rest[m] and (back := trail([k for k in order if rest[k]], m[1], m[0])):
            take([m, *back], min(rest[k] for k in [m, *back]))
    while True:
        m = next((m for m in order if rest[m] and left[m[1]] > 0), None)
        if m is None:
            return given
        n = min(rest[m], left[m[1]])
        left[m[0]] += n
        left[m[1]] -= n
        take([m], n)


def trail(moves: list[tuple[int, ...]], start: int, end: int) -> list[tuple[int, ...]]:
    """The shortest way over moves from one shard to another; none is an empty list."""
    found = {start: []}
    queue = [start]
    for at in queue:
        for m in moves:
            if m[0] == at and m[1] not in found:
                found[m[1]] = [*found[at], m]
                queue.append(m[1])
    return found.get(end, [])


def by_ends(number: Column, ends: list[int]) -> Column:
    """The first shard whose end lies beyond a number."""
    out = F.lit(len(ends) - 1)
    for j in reversed(range(len(ends) - 1)):
        out = F.when(number < ends[j], F.lit(j)).otherwise(out)
    return out


def first_labels(linked: DataFrame, quota: list[int], rows: int) -> DataFrame:
    """node, link_group, shard within the quotas. Groups of over half a quota are packed: rounds that move single nodes
    would leave them in every shard, as each is at home where hundreds of its kind are. Other nodes are strewn over the
    places left."""
    sizes = linked.groupBy("link_group").agg(F.count("*").alias("size")).where(F.col("size") > max(quota, default=0) / 2)
    large = sorted((bytes(r["link_group"]), r["size"]) for r in sizes.collect())  # at most 2 x shards rows
    packed = sum(n for _, n in large)
    starts, at = [], 0
    for group, n in large:
        starts.append((group, at))
        at += n
    start = linked.sparkSession.createDataFrame(starts, "link_group binary, start long")
    ends, room, before = [], [], 0
    for q in quota:
        ends.append(before + q)
        room.append(q - max(0, min(q, packed - before)))
        before += q
    share = [sum(room[: j + 1]) * (rows - packed) // max(1, sum(room)) for j in range(len(quota))]
    big = numbered(linked.select("node", "link_group").join(F.broadcast(start), "link_group"), ["link_group"], "node", rows)
    big = big.select("node", "link_group", by_ends(F.col("start") + F.col("n"), ends).alias("shard"))
    small = numbered(linked.select("node", "link_group").join(F.broadcast(start), "link_group", "left_anti"), [], "node", rows)
    return big.union(small.select("node", "link_group", by_ends(F.col("n"), share).alias("shard")))


def split_groups(tally: DataFrame, room: int) -> DataFrame | None:
    """link_group of groups in more than one shard that fit so much room together, larger ones (by powers of two) first."""
    size = F.aggregate(F.map_values("by_shard"), F.lit(0).cast("long"), lambda a, n: a + n)
    split = tally.where(F.size("by_shard") > 1).select("link_group", F.floor(F.log2(size)).cast("int").alias("class"))
    counts = {r["class"]: r["n"] for r in split.groupBy("class").agg(F.count("*").alias("n")).collect()}  # at most 63 rows
    taken = {}
    for c in sorted(counts, reverse=True):
        taken[c] = min(counts[c], room // (2 << c))
        room -= taken[c] * (2 << c)
    if not any(taken.values()):
        return None
    limit = F.create_map(*[F.lit(x) for c, n in taken.items() for x in (c, n)])
    return numbered(split, ["class"], "link_group", sum(counts.values())).where(F.col("n") < limit[F.col("class")]).select("link_group")


def propagate(linked: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """linked: node (unique), link_group. Returns node, link_group, shard.

    Nodes of a group are each other's neighbours. Each round counts a group's nodes by shard (one row for each group),
    and every node asks for the shard where most of its neighbours are; of two equal ones, the group's hash decides. A
    shard that is full and that nobody wants to leave takes no requests, so that its group's other nodes ask for their
    next one. Moves are admitted by quota, those of larger groups (by powers of two) first. Where none is left, groups
    that are still split move whole into the emptiest shard, if they fit; the places they leave let others move on.
    Groups of over half a quota start packed, one shard after the other (see first_labels).
    """
    shards = len(quota)
    rows = linked.count()
    state = stored(first_labels(linked, quota, rows), "labels")
    for _ in range(rounds if rows else 0):
        tally = (
            state.groupBy("link_group", "shard").agg(F.count("*").alias("n"))
            .groupBy("link_group")
            .agg(F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("by_shard"))  # at most one entry a shard
        )
        tally = stored(tally, "tally")
        each = tally.select("link_group", "by_shard", F.explode("by_shard").alias("shard", "nodes"))
        load = {r["shard"]: r["n"] for r in each.groupBy("shard").agg(F.sum("nodes").alias("n")).collect()}  # one row a shard
        free = [q - load.get(j, 0) for j, q in enumerate(quota)]
        takes = set(range(shards))

        def goal() -> Column:
            open_ = F.array(*[F.lit(j) for j in sorted(takes)]).cast("array<int>")
            turn = F.xxhash64("link_group")
            best = F.array_max(F.transform(
                F.filter(F.map_entries("by_shard"), lambda e: F.array_contains(open_, e["key"]) | (e["key"] == F.col("shard"))),
                lambda e: F.struct(e["value"].alias("n"), F.pmod(turn + e["key"], F.lit(shards)).alias("order"), e["key"].alias("shard")),
            ))
            return best["shard"].alias("goal")

        size = F.aggregate(F.map_values("by_shard"), F.lit(0).cast("long"), lambda a, n: a + n)
        rank = F.floor(F.log2(size)).cast("int").alias("class")
        while True:
            wanted = each.select("shard", "nodes", goal(), rank).where("shard <> goal").groupBy("shard", "goal", "class").agg(F.sum("nodes").alias("n"))
            asked = {(r["shard"], r["goal"], r["class"]): r["n"] for r in wanted.collect()}  # at most shards x shards x 63 rows
            shut = {m[1] for m in asked if free[m[1]] <= 0 and not any(k[0] == m[1] for k in asked)}
            if not shut:
                break
            takes -= shut
        given = admit(asked, free)
        if not sum(given.values()):
            room = free.index(max(free))
            whole = split_groups(tally, free[room])
            if whole is None:
                break
            joined = state.join(whole.withColumn("_in", F.lit(True)), "link_group", "left")
            state = stored(joined.select("node", "link_group", F.when(F.col("_in"), F.lit(room)).otherwise(F.col("shard")).alias("shard")), "labels")
            continue
        wishes = stored(state.join(tally, "link_group").select("node", "link_group", "shard", goal(), rank), "wishes")
        if given == asked:
            moved = wishes.select("node", "link_group", F.col("goal").alias("shard"))
        else:
            number = lambda i, j, c: (i * shards + j) * 64 + c
            limit = F.create_map(*[F.lit(x) for m, n in given.items() for x in (number(*m), n)])
            movers = numbered(wishes.where("shard <> goal"), ["shard", "goal", "class"], "node", sum(asked.values()))
            allowed = F.col("n") < limit[number(F.col("shard"), F.col("goal"), F.col("class"))]
            movers = movers.withColumn("shard", F.when(allowed, F.col("goal")).otherwise(F.col("shard")))
            moved = movers.select("node", "link_group", "shard").union(wishes.where("shard = goal").select("node", "link_group", "shard"))
        state = stored(moved, "labels")
    return state


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Puts all documents into shards whose row counts differ by one at most, copies of a text together.

    Law ``rows``. Equal texts are linked (a null text to none; empty texts to each other). Linked documents are
    placed by label propagation; unlinked ones, which cut no link anywhere, fill the quotas. Null and repeated
    doc_id stay rows of their own; columns other than doc_id and text are not read. An empty table gives no rows.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    base = stored(
        docs.select(
            F.monotonically_increasing_id().alias("node"), "doc_id",
            F.coalesce(F.octet_length("text").cast("long"), F.lit(0)).alias("bytes"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"),
            F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("link_group"),
        ),
        "nodes",
    )
    rows = base.count()
    quota = quotas(rows, shards)
    groups = base.where("link_group is not null").groupBy("link_group").agg(F.count("*").alias("n")).where("n > 1").select("link_group")
    placed = propagate(base.join(groups, "link_group", "left_semi"), quota, rounds).select("node", "shard")
    load = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row a shard
    ends, end = [], 0
    for j, q in enumerate(quota):
        end += q - load.get(j, 0)
        ends.append(end)
    rest = numbered(base.select("node").join(placed, "node", "left_anti"), [], "node", rows).select("node", by_ends(F.col("n"), ends).alias("shard"))
    whole = stored(base.join(placed.union(rest), "node"), "placed")
    return numbered(whole, ["shard"], "node", rows, "slot").select(
        "doc_id", (F.col("bytes") + 1).alias("size"), "text_crc32", F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
