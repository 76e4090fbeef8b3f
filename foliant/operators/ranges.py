"""Page ranges: Column -> Column and generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import strip, whole


def suggest_ranges(df: DataFrame, key: str, total: str, size: int = 50) -> DataFrame:
    """Consecutive ranges of `size` pages: key, page_from, page_to."""
    starts = F.explode(F.sequence(F.lit(1), F.col(total), F.lit(size)))
    return df.where(F.col(total) >= 1).select(key, total, starts.alias("page_from")).select(key, "page_from", F.least(F.col(total), F.col("page_from") + size - 1).alias("page_to"))


def normalize_range(page_from: Column, page_to: Column, total: Column) -> Column:
    """Struct (page_from, page_to) clamped to the document; null if the first page is beyond it."""
    last = F.greatest(F.lit(1), total)
    first = F.greatest(F.lit(1), page_from)
    end = F.least(last, F.greatest(first, F.coalesce(page_to, last)))
    return F.when(first <= end, F.struct(first.alias("page_from"), end.alias("page_to")))


def parse_pages(spec: Column, total: Column) -> Column:
    """Sorted pages of a specification like 1,3,5-10; null if it is empty, reversed, malformed or out of range."""
    n = F.greatest(F.lit(1), total)
    parts = F.filter(F.transform(F.split(whole(spec), ","), strip), lambda p: p != "")
    ends = F.transform(parts, lambda p: F.struct(
        F.try_to_number(strip(F.regexp_extract(p, r"^\s*(\d+)\s*(?:-\s*\d+\s*)?$", 1)), F.lit("999999999")).cast("int").alias("a"),
        F.try_to_number(strip(F.regexp_extract(p, r"^\s*(?:\d+\s*-\s*)?(\d+)\s*$", 1)), F.lit("999999999")).cast("int").alias("b")))
    bad = F.exists(ends, lambda e: e["a"].isNull() | e["b"].isNull() | (e["a"] > e["b"]) | (e["a"] < 1) | (e["b"] > n))
    good = F.array_sort(F.array_distinct(F.flatten(F.transform(ends, lambda e: F.sequence(e["a"], e["b"])))))
    return F.when((F.size(parts) > 0) & ~bad, good)


def pages_to_keep(total: Column, keep: Column, remove: Column) -> Column:
    """Pages by what to keep or what to remove; null for both, neither, or nothing left."""
    n = F.greatest(F.lit(1), total)
    k, r = strip(whole(keep)), strip(whole(remove))
    kept = F.when((k != "") & (r == ""), parse_pages(k, n)).when((k == "") & (r != ""), F.array_except(F.sequence(F.lit(1), n), parse_pages(r, n)))
    return F.when(F.size(kept) > 0, kept)
