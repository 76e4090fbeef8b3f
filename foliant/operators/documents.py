"""Pages, chunks and sections of documents: DataFrame -> DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.text import PAGE_BREAK, compress_markdown, section_title, strip, whole
from foliant.operators.grams import held_strings, maybe_held, window_filter
from foliant.sources.folders import session_folder


def ordered_texts(df: DataFrame, key: str, order: str, text: Column) -> DataFrame:
    """key, parts: an array of structs (order, text) in order of `order`; repeated orders by text."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), whole(text).alias("t")))).alias("parts"))


def join_pages(pages: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """A document's pages with page breaks between them; blank pages are left out."""
    parts = ordered_texts(pages, key, order, strip(F.col(text)))
    return parts.select(key, F.array_join(F.transform(F.filter("parts", lambda p: p["t"] != ""), lambda p: p["t"]), PAGE_BREAK).alias("markdown"))


def banner_pages(pages: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Pages under numbered banners. Numbers count positions, blank pages included; a single page has no banner."""
    parts = ordered_texts(pages, key, order, strip(F.col(text)))
    total = F.size("parts").cast("string")
    lined = F.transform("parts", lambda p, i: F.when(p["t"] != "", F.concat(F.lit("--- Página "), (i + 1).cast("string"), F.lit("/"), total, F.lit(" ---\n"), p["t"])))
    many = F.array_join(F.filter(lined, lambda x: x.isNotNull()), "\n\n")
    return parts.select(key, F.when(F.size("parts") == 1, F.col("parts")[0]["t"]).otherwise(many).alias("text"))


def merge_chunks(chunks: DataFrame, key: str, order: str, text: str, separator: str = PAGE_BREAK) -> DataFrame:
    """Chunks of a document as one Markdown with a final line end; null if all are blank."""
    joined = join_pages(chunks, key, order, text)
    if separator != PAGE_BREAK:
        joined = joined.withColumn("markdown", F.replace("markdown", F.lit(PAGE_BREAK), F.lit(separator)))
    return joined.select(key, F.when(F.col("markdown") != "", F.concat("markdown", F.lit("\n"))).alias("markdown"))


def sections_of(text: Column) -> Column:
    """Array of structs (id, content): split at page breaks, else before second-level headings, else whole.

    Ids are positions before blank parts are dropped, and they keep the gaps where page breaks were split.
    """
    body = strip(F.regexp_replace(whole(text), "\r\n", "\n"))
    numbered = lambda a: F.transform(a, lambda x, i: F.struct(i.cast("string").alias("id"), strip(x).alias("content")))
    broken = F.split(body, r"\n\s*---\s*\n", -1)
    headed = F.filter(F.split(body, r"(?=\n##\s)", -1), lambda x: strip(x) != "")
    parts = F.when(F.size(broken) > 1, numbered(broken)).when(F.size(headed) > 1, numbered(headed)).otherwise(F.array(F.struct(F.lit("0").alias("id"), body.alias("content"))))
    return F.filter(parts, lambda s: s["content"] != "")


def split_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per section: key, id, title, content, chars."""
    s = docs.select(key, F.explode(sections_of(F.col(text))).alias("s")).select(key, "s.id", "s.content")
    return s.select(key, "id", section_title(F.col("content"), F.col("id").cast("int")).alias("title"), "content", F.length("content").alias("chars"))


def keep_sections(docs: DataFrame, key: str, text: str, keep: Column) -> DataFrame:
    """The sections whose ids are in the array `keep`, merged; null if none is. An empty text is compressed."""
    kept = F.filter(sections_of(F.col(text)), lambda s: F.array_contains(keep, s["id"]))
    merged = F.array_join(F.transform(kept, lambda s: s["content"]), PAGE_BREAK)
    return docs.select(key, F.when(strip(whole(F.col(text))) == "", compress_markdown(F.col(text))).when(merged != "", F.concat(merged, F.lit("\n"))).alias("markdown"))


def split_pages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Pages of a joined Markdown, numbered from 0; documents of one page have none."""
    parts = docs.select(key, F.split(whole(F.col(text)), PAGE_BREAK, -1).alias("p")).where(F.size("p") > 1)
    return parts.select(key, F.posexplode("p").alias("index", "page")).select(key, "index", strip(F.col("page")).alias("markdown"))


def markdown_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks of a Markdown document for an exporter: key, block, kind, lines, text.

    Kinds: heading1 to heading3, break, table, bullet, number, paragraph. Table lines and plain lines that follow each
    other are one block; every other line is one of its own; blank lines separate.
    """
    lines = docs.select(key, F.posexplode(F.split(whole(F.col(text)), "\n", -1)).alias("line", "raw")).withColumn("s", strip(F.col("raw")))
    s = F.col("s")
    kind = (
        F.when(s == "", "blank").when(s.rlike(r"^###\s"), "heading3").when(s.rlike(r"^##\s"), "heading2").when(s.rlike(r"^#\s"), "heading1")
        .when(s == "---", "break").when(s.startswith("|"), "table").when(s.rlike(r"^[-*]\s"), "bullet").when(s.rlike(r"^\d+\.\s"), "number").otherwise("paragraph")
    )
    w = Window.partitionBy(key).orderBy("line", "s")  # a key that repeats has several lines of one number
    lines = lines.withColumn("kind", kind).withColumn("before", F.lag("kind").over(w))
    new = F.when((F.col("kind") == F.col("before")) & F.col("kind").isin("table", "paragraph"), 0).otherwise(1)
    lines = lines.withColumn("island", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("kind <> 'blank'")
    blocks = lines.groupBy(key, "island", "kind").agg(F.count("*").alias("lines"), F.sort_array(F.collect_list(F.struct("line", "s"))).alias("ls"))
    order = Window.partitionBy(key).orderBy("island")
    return blocks.select(key, F.row_number().over(order).alias("block"), "kind", "lines", F.array_join(F.transform("ls", lambda x: x["s"]), "\n").alias("text"))


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 0), raw."""
    return docs.select(key, F.posexplode(F.split(whole(F.col(text)), "\n", -1)).alias("line", "raw"))


def lines_not_in(lines: DataFrame, main: DataFrame, line: str, main_key: str, main_text: str, gram: int = 12, stride: int = 4, longest: int = 80) -> DataFrame:
    """Distinct lines (lower case, two characters or more) that no text of main holds, by the anti-substring rule.

    A line goes if a text holds it, or, up to `longest` characters, any of its grams at every `stride`-th place. Long lines
    are known by grams end to end: such as a text holds all of are looked at again in the texts that hold the rarest one.
    Where the texts are few enough for a filter of their grams, it goes to the lines first, and only such as it lets through
    are looked for. A filter of these lines' grams goes to the texts, from which only what it lets through is taken: no text
    is exploded, and none is shuffled but those that a long line is looked for in.
    """
    every = lines.select(F.lower(strip(F.col(line))).alias("key")).where(F.length("key") >= 2)
    texts = main.select(F.lower(F.col(main_text)).alias("t")).where("t <> ''").withColumn("tid", F.xxhash64("t"))
    windows = window_filter(texts, "t", list(range(2, gram + 1)))
    some = every if windows is None else maybe_held(every, "key", windows, gram, stride, longest)
    folder = session_folder(lines.sparkSession, "lines")
    some.distinct().write.parquet(f"{folder}/keys")  # read three times
    keys = lines.sparkSession.read.schema("key string").parquet(f"{folder}/keys")
    n = F.length("key")
    apart = F.when(n <= longest, F.lit(stride)).otherwise(F.lit(gram))
    starts = F.when(n < gram, F.array(F.lit(1))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(1), n - gram + 1, apart), F.when(n > longest, F.array(n - gram + 1)).otherwise(F.array().cast("array<int>")))))
    probes = keys.select("key", F.explode(F.transform(starts, lambda i: F.substr("key", i, F.lit(gram)))).alias("g"))
    known = probes.select("g").distinct()
    held = held_strings(texts, "tid", "t", known, "g").join(known, "g", "left_semi").distinct()
    counted = held.groupBy("g").agg(F.count("*").alias("texts"))
    short = probes.where(n <= longest).join(counted, "g", "left_semi").select("key")
    long = probes.where(n > longest).join(counted, "g", "left").groupBy("key").agg(F.min_by("g", "texts").alias("g"), F.bool_and(F.col("texts").isNotNull()).alias("all"))
    near = long.where("all").select("key", "g").join(held, "g").select("key", "tid")
    found = near.join(texts, "tid").where(F.contains("t", "key")).select("key")
    return every.distinct().join(short.union(found).distinct(), "key", "left_anti")
