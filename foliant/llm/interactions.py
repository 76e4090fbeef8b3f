"""An audit of how filters interact: what each of them removes in every order in which they can be applied.

All of it is DataFrame functions. A text gives a mask with a bit for each filter that it fails; the filter of repeated
texts asks a grouping of all texts for the smallest doc_id. A mask is all that the audit needs of a document, so a
part's documents become a histogram of 32 cells, and every order is worked out from the cells.

With clear(S), the documents that fail no filter of the set S, a filter f after the filters P removes
clear(P) - clear(P with f); removed over all orders, f after P counts in |P|! (4 - |P|)! of the 120.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import WORD, let, stored, table

FILTERS = "ABCDE"
_ALL = 1 << len(FILTERS)


def content_mask(text: Column) -> Column:
    """Bits 0 to 3, for what a text fails by itself: A few words, B few distinct words, C many capitals, D symbols."""
    text = F.coalesce(text, F.lit(""))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    symbols = F.lit(False)
    for c in "#$%&*|":
        symbols = symbols | F.contains(text, F.lit(c))

    def bits(words: Column) -> Column:
        n, distinct = F.size(words), F.size(F.array_distinct(words))
        failed = (n < 50, 100 * distinct.cast("long") < 65 * n.cast("long"), 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), symbols)
        mask = F.lit(0)
        for k, f in enumerate(failed):
            mask = mask + f.cast("int") * (1 << k)
        return mask

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), bits)


def masks(docs: DataFrame, part_col: str = "source") -> DataFrame:
    """doc_id, part, mask: a row for each row of docs, with bit 4 (E) where a smaller doc_id has the same text.

    Texts are grouped by their SHA-256, so none is shuffled; each is read once. Only texts that occur twice are joined
    back: Spark broadcasts them where they are few, and splits a hot one otherwise.
    """
    own = docs.select(
        "doc_id", F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), content_mask(F.col("text")).cast("byte").alias("own"),
        F.unhex(F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)).alias("digest"),
    )
    own = stored(own, "content-masks")
    # written, so that the join deals both sides anew and Spark can split the rows of a hot text
    firsts = stored(own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first-texts")
    repeated = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return own.join(firsts, "digest", "left").select("doc_id", "part", (F.col("own") + repeated.cast("int") * 16).cast("int").alias("mask"))


def histogram(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents in each cell, and those that labels call good or toxic."""
    known = labels.where("quality = 1 OR toxic = 1").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    return masked.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def every_order(cells: DataFrame) -> DataFrame:
    """Of each part's cells (part, mask, n, good, toxic), the counts at every step of every order."""
    sums = ("n", "good", "toxic")
    cell = lambda c, mask: F.sum(F.when(F.col("mask") == mask, F.col(c)).otherwise(0))
    parts = cells.groupBy("part").agg(*[F.array(*[cell(c, m) for m in range(_ALL)]).alias(c) for c in sums])

    def clear(column: Column) -> Column:
        """For each set of filters, the documents that fail none of it."""
        passes = lambda s: F.filter(column, lambda x, mask: mask.bitwiseAND(s) == 0)
        return F.transform(F.sequence(F.lit(0), F.lit(_ALL - 1)), lambda s: F.aggregate(passes(s), F.lit(0).cast("long"), lambda a, x: a + x))

    parts = parts.select("part", F.col("n").alias("cells"), *[clear(F.col(c)).alias(c) for c in sums])
    at: Callable = lambda column, s: F.get(F.col(column), s)

    def value(k: int) -> Column:
        """What filter k removes over all orders."""
        before = [s for s in range(_ALL) if not s >> k & 1]
        times = [math.factorial(s.bit_count()) * math.factorial(len(FILTERS) - 1 - s.bit_count()) for s in before]
        return sum((F.lit(t) * (at("n", F.lit(s)) - at("n", F.lit(s | 1 << k))) for s, t in zip(before, times)), F.lit(0))

    parts = parts.withColumn("values", F.array(*map(value, range(len(FILTERS)))))
    orders = ",".join("".join(x) for x in permutations(FILTERS))
    parts = parts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = {k: F.instr("filter_order", x) for k, x in enumerate(FILTERS)}
    bits = lambda held: sum((F.when(held(at_step), 1 << k).otherwise(0) for k, at_step in place.items()), F.lit(0))
    parts = parts.select("*", bits(lambda p: p < F.col("step")).alias("before"), bits(lambda p: p == F.col("step")).alias("bit"))
    bit, after = F.col("bit"), F.col("before").bitwiseOR(F.col("bit"))
    removed = lambda column: at(column, F.col("before")) - at(column, after)
    return parts.select(
        "part", "filter_order", "step", at("n", after).alias("kept"), removed("n").alias("removed"),
        (at("n", F.lit(0)) - at("n", bit) - removed("n")).alias("redundant"), at("cells", bit).alias("unique_fails"),
        removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"), at("values", F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, part_col: str = "source") -> DataFrame:
    """Every order of the five filters over docs (doc_id, text, and a column of parts), with labels (doc_id, quality, toxic).

    A null text is an empty one, and so repeats those; a null part is the empty string's. A null doc_id is neither
    smaller nor larger than another, so its row repeats nothing and has no label; rows that share the smallest doc_id of
    a text repeat nothing either. Rows that repeat are documents each. Of several labels of a doc_id one that says 1
    counts. Texts are read whole; other columns are not read. An empty table has no parts, and so gives no rows.
    """
    return every_order(histogram(masks(docs, part_col), labels))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM t
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS fails
  FROM w LEFT JOIN l USING (doc_id)
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS k
), orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS ks, a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, fails
), walked AS (
  SELECT part, filter_order, ks, n, good, toxic, fails, unnest([1, 2, 3, 4, 5]) AS step,
         list_position(list_transform(ks, lambda k: fails[k]), true) AS gone
  FROM cells, orders
), steps AS (
  SELECT part, filter_order, step, ks[step] AS k,
         sum(CASE WHEN gone IS NULL OR gone = 0 OR gone > step THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN fails[ks[step]] AND gone < step THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails[ks[step]] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN gone = step THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN gone = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM walked GROUP BY part, filter_order, step, ks
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM steps
"""
