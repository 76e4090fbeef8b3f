"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import few_files, stored


def _summary(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: u, v (long). Returns node, root for every node of a link: root is the component's smallest node.

    Each round replaces links by links to smaller neighbours; a table's rows never outnumber the given links and nodes,
    so a hub costs its degree. The number of rounds is about the logarithm of the longest path.
    """
    pairs = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _summary(pairs)
    for _ in range(rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(few_files(large.where("u <> v").distinct(), before[0]), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs = stored(few_files(small.select("e.u", "e.v").where("u <> v").distinct(), 2 * before[0]), "links")
        after = _summary(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
