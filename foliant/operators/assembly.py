"""Pages to documents: what becomes of a page's text, of a document's pages, and of the readings of several engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.cleaning import normalize_digital_text, summarize_evidence
from foliant.functions.predicates import is_crypto_evidence, is_stamp_line, is_vision_source, source_providers
from foliant.functions.scores import minimum_pdf_text_chars, plain_quality_score, text_quality_score
from foliant.functions.text import PAGE_BREAK, compress_markdown, normalize_markdown, normalize_whitespace, once, strip, strip_markdown_syntax, whole
from foliant.operators.cleaned import cleaned
from foliant.operators.documents import keep_sections, split_sections

PLAIN_METHODS = ("digital_pdf", "markitdown")
HEAVY_MB, MANY_PAGES, LEAST_PAGE_CHARS = 20, 30, 24


def distinct_warnings(warnings: Column) -> Column:
    """Warnings in order, each once, without empty ones."""
    return F.array_distinct(F.filter(warnings, lambda w: F.coalesce(w, F.lit("")) != ""))


def digital_pages(pages: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, markdown: the text layer of pages (keys, flowing; blocks: keys, x, y, text).

    Pages of cryptographic evidence become a summary, such with 24 characters of flowing text that text; the others
    their blocks by bands of four points and from left to right, without stamps.
    """
    text = normalize_whitespace(F.col("text"))
    kept = blocks.withColumn("text", text).where((F.col("text") != "") & ~is_stamp_line(F.col("text")))
    parts = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.bround(F.col("y") / 4).alias("band"), "x", "y", "text"))).alias("bs"))
    joined = pages.select(*keys, normalize_whitespace(F.col("flowing")).alias("flowing")).join(parts, keys, "left")
    by_blocks = F.array_join(F.transform("bs", lambda b: b["text"]), "\n\n")
    body = F.when(F.length("flowing") >= LEAST_PAGE_CHARS, F.col("flowing")).otherwise(F.coalesce(by_blocks, F.lit("")))
    return joined.select(*keys, F.when(is_crypto_evidence(F.col("flowing")), summarize_evidence(F.col("flowing"))).otherwise(normalize_digital_text(body)).alias("markdown"))


def assemble(documents: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Results of documents: key, method, text, markdown, pages (structs index, markdown, text), total_pages, warnings.

    documents: key, method, markdown, warnings (array), size_bytes, is_pdf, file_pages; pages: key, index, markdown, text,
    digital, ocr_sourced. Pages are sanitized (hard, unless the method or the page is plain text), those left blank go.
    A document without pages is split at its page breaks; one that has none of those either is one page, and counts the
    pages of its file if that is a PDF.
    """
    hard = ~F.col("method").isin(*PLAIN_METHODS)
    raw = pages.join(documents.select(key, hard.alias("_h")), key).select(
        key, F.col("index").cast("int").alias("index"), F.coalesce(F.nullif("markdown", F.lit("")), "text", F.lit("")).alias("_raw"), F.col("text").alias("_text"),
        (F.col("_h") & ~F.coalesce("digital", F.lit(False)) & ~F.coalesce("ocr_sourced", F.lit(False))).alias("_hard"),
    )
    # a document's own Markdown counts as page -1, used where no page is left
    raw = raw.unionByName(documents.where(whole(F.col("markdown")) != "").select(key, F.lit(-1).alias("index"), F.col("markdown").alias("_raw"), F.lit(None).cast("string").alias("_text"), hard.alias("_hard")))
    done = raw.select(key, "index", "_text", cleaned(F.col("_raw"), F.col("_hard")).alias("markdown"))
    plain = strip_markdown_syntax(F.coalesce(F.nullif("_text", F.lit("")), "markdown"))
    # blank pages go inside the grouping: a filter would clean the texts a second time before it
    page = F.when(F.col("markdown") != "", F.struct("index", "markdown", plain.alias("text")))
    every = done.groupBy(key).agg(F.sort_array(F.collect_list(page)).alias("_ps")).where(F.size("_ps") > 0)
    own = F.filter("_ps", lambda p: p["index"] >= 0)
    chunks = F.filter(F.transform(F.split(F.get("_ps", F.lit(0))["markdown"], r"\n\s*---\s*\n", -1), strip), lambda c: c != "")
    split = F.transform(chunks, lambda c, i: F.struct(i.alias("index"), c.alias("markdown"), strip_markdown_syntax(c).alias("text")))
    listed = every.select(key, F.when(F.size(own) > 0, own).otherwise(split).alias("pages"), ((F.size(own) > 0) | (F.size(chunks) > 1)).alias("_paged"))
    total = F.size("pages").cast("string")
    banners = F.transform("pages", lambda p, i: F.when(strip(p["text"]) != "", F.concat(F.lit("--- Página "), (i + 1).cast("string"), F.lit("/"), total, F.lit(" ---\n"), strip(p["text"]))))
    merged = F.array_join(F.transform("pages", lambda p: strip(p["markdown"])), PAGE_BREAK)
    text = F.when(F.size("pages") == 1, strip(F.get("pages", F.lit(0))["text"])).otherwise(F.array_join(F.filter(banners, lambda b: b.isNotNull()), "\n\n"))
    out = documents.drop("markdown").join(listed.select(key, "pages", "_paged", merged.alias("markdown"), text.alias("text")), key, "left")
    single = F.when(F.size("pages") > 0, 1).otherwise(0)
    n = F.when(F.col("_paged"), F.size("pages")).when(F.col("is_pdf"), F.greatest(F.lit(1), F.coalesce("file_pages", F.lit(1)))).otherwise(single)
    mb = F.col("size_bytes") / (1024 * 1024)
    heavy = F.when(mb >= HEAVY_MB, F.concat(F.lit("Archivo pesado ("), F.format_string("%.1f", mb), F.lit(" MB). Si el resultado sale incompleto, intenta dividir el documento.")))
    long_ = F.when(F.col("is_pdf") & (n > MANY_PAGES), F.concat(F.lit("PDF largo ("), n.cast("string"), F.lit(" páginas). Revisa el resultado por secciones para validar tablas y texto.")))
    none = F.array().cast("array<struct<index:int,markdown:string,text:string>>")
    return out.select(
        key, "method", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("markdown", F.lit("")).alias("markdown"), F.coalesce("pages", none).alias("pages"), n.alias("total_pages"),
        F.concat(distinct_warnings(F.coalesce("warnings", F.array().cast("array<string>"))), F.filter(F.array(heavy, long_), lambda w: w.isNotNull())).alias("warnings"),
    )


def digital_acceptance(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, chars, text_pages, tables, accepted: whether a document's text layer is enough. pages: key, page, text, tables.

    A page of text has 24 characters; pages are joined with their tables' Markdown (array). The document needs 18
    characters a page, 36 to 100 in all, and a page of text.
    """
    plain = F.length(strip_markdown_syntax(F.col("text")))
    has_text = plain >= LEAST_PAGE_CHARS
    parts = F.concat(F.when(has_text, F.array(F.col("text"))).otherwise(F.array().cast("array<string>")), F.when(has_text & (F.size("tables") > 0), F.array(F.lit("## Tablas detectadas"))).otherwise(F.array().cast("array<string>")), "tables")
    page = strip(F.array_join(F.filter(parts, lambda p: strip(p) != ""), "\n\n"))
    per = pages.select(key, has_text.alias("t"), F.size("tables").alias("k"), F.length(strip_markdown_syntax(page)).alias("c"))
    sums = per.groupBy(key).agg(F.sum("c").alias("chars"), F.count_if("t").alias("text_pages"), F.sum("k").alias("tables"), F.count("*").alias("_n"))
    return sums.select(key, "chars", "text_pages", "tables", ((F.col("chars") >= minimum_pdf_text_chars(F.col("_n"))) & (F.col("text_pages") > 0)).alias("accepted"))


def best_engine(readings: DataFrame, page: str = "page_id", weight: float = 1.35) -> DataFrame:
    """Of each page (page, engine, markdown, confidence) the better local engine: page, engine, markdown, score.

    Only the second engine's score counts its confidence, and it has to be higher to win over 'tesseract'.
    """
    first = F.col("engine") == "tesseract"
    score = text_quality_score(F.col("markdown")) + F.when(first, 0.0).otherwise(F.col("confidence") * weight)
    scored = readings.where(first | (whole(F.col("markdown")) != "")).withColumn("score", score)
    best = scored.groupBy(page).agg(F.max_by(F.struct("engine", "markdown", "score"), F.struct("score", first.alias("first"))).alias("b"))
    return best.select(page, "b.*")


def accepted_reading(readings: DataFrame, page: str = "page_id") -> DataFrame:
    """The cascade of engines: of each page the first reading by priority that is good enough. readings: page, priority,
    engine, markdown, min_score, min_chars. Pages without one have none."""
    good = once(strip_markdown_syntax(F.col("markdown")), lambda p: (F.length(p) >= F.col("min_chars")) & (plain_quality_score(p) >= F.col("min_score")))
    return readings.where(good).groupBy(page).agg(F.min_by(F.struct("engine", "markdown"), "priority").alias("b")).select(page, "b.*")


def settled_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """pages (key, index, markdown, source, local) with final (Markdown), fell_back and providers (of the pages that a hosted
    reading settled): weak readings give way to local ones that are better by more than 8."""
    staged = pages.withColumn("_p", strip_markdown_syntax(F.col("markdown")))
    staged = staged.withColumns({"_score": plain_quality_score(F.col("_p")), "_chars": F.length("_p")}).withColumn("_weak", (F.col("_score") < 28) | (F.col("_chars") < LEAST_PAGE_CHARS))
    staged = staged.withColumn("_back", F.when(F.col("_weak"), text_quality_score(F.col("local")) > F.col("_score") + 8).otherwise(False))
    none = F.array().cast("array<string>")
    used = F.when(~F.col("_weak") & (whole(F.col("source")) != "") & is_vision_source(F.col("source")), source_providers(F.col("source"))).otherwise(none)
    return staged.withColumns({"final": F.when(F.col("_back"), F.col("local")).otherwise(F.col("markdown")), "fell_back": F.col("_back"), "providers": used}).drop("_p", "_score", "_chars", "_weak", "_back")


def provider_usage(pages: DataFrame, key: str = "doc_id", parallel: bool = False) -> DataFrame:
    """Documents of settled pages: key, pages, fallbacks, method: the provider of most pages (of equal ones the one that
    came first), 'parallel' where several are asked at once, or 'vision' without any."""
    # one pass over the pages, each once for each provider or alone; a filter on `final` would score the texts again before it
    full = settled_pages(pages, key).select(key, "index", (F.col("final") != "").alias("_full"), "fell_back", F.posexplode_outer("providers").alias("at", "provider"))
    once_ = F.col("_full") & (F.coalesce("at", F.lit(0)) == 0)
    counts = full.groupBy(key, "provider").agg(
        F.count_if("_full").alias("n"), F.min(F.when(F.col("_full"), F.struct("index", "at"))).alias("first"), F.count_if(once_).alias("_pages"), F.count_if(once_ & F.col("fell_back")).alias("_back"),
    )
    label = F.lit("parallel") if parallel else F.col("provider")
    best = F.min_by(label, F.when(F.col("provider").isNotNull() & (F.col("n") > 0), F.struct(-F.col("n"), "first")))
    totals = counts.groupBy(key).agg(F.sum("_pages").alias("pages"), F.sum("_back").alias("fallbacks"), best.alias("method")).where("pages > 0")
    return totals.select(key, "pages", "fallbacks", F.coalesce("method", F.lit("vision")).alias("method"))


def analyze(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, chars, chars_compressed, sections (structs id, title, chars)."""
    parts = split_sections(docs, key, text).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("id").cast("int").alias("id"), "title", "chars"))).alias("sections"))
    sizes = docs.select(key, F.length(whole(F.col(text))).alias("chars"), F.length(compress_markdown(F.col(text))).alias("chars_compressed"))
    return sizes.join(parts, key, "left")


def edit(docs: DataFrame, key: str, text: str, keep: Column, compress: Column) -> DataFrame:
    """key, markdown, before_chars, after_chars, saved_pct: the sections kept (array of ids; empty: all), compressed where
    asked. Documents without any of the sections have no row."""
    flagged = docs.select(key, F.col(text).alias("_t"), keep.alias("_keep"), compress.alias("_z"))
    some = keep_sections(flagged.where(F.size("_keep") > 0), key, "_t", F.col("_keep")).where("markdown IS NOT NULL").withColumnRenamed("markdown", "_kept")
    joined = flagged.join(some, key, "left").where((F.size("_keep") == 0) | F.col("_kept").isNotNull())
    chosen = joined.select(key, whole(F.col("_t")).alias("_t"), F.when(F.size("_keep") == 0, whole(F.col("_t"))).otherwise(F.col("_kept")).alias("_m"), "_z")
    out = chosen.select(key, F.length("_t").alias("before_chars"), F.when(F.col("_z"), compress_markdown(F.col("_m"))).otherwise(F.col("_m")).alias("markdown"))
    saved = F.when(F.col("before_chars") > 0, F.bround((1 - F.length("markdown") / F.col("before_chars")) * 100, 1)).otherwise(0.0)
    return out.select(key, "markdown", "before_chars", F.length("markdown").alias("after_chars"), saved.alias("saved_pct"))


def clean(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, markdown (sanitized), before_chars, after_chars, lines_removed."""
    both = docs.select(key, whole(F.col(text)).alias("_b")).withColumn("markdown", cleaned(F.col("_b"), F.lit(True), flat=False))
    lines = lambda t: F.when(t == "", 0).otherwise(F.regexp_count(F.regexp_replace(t, r"\n\z", ""), F.lit("\n")) + 1)
    return both.select(key, "markdown", F.length("_b").alias("before_chars"), F.length("markdown").alias("after_chars"), (lines(F.col("_b")) - lines(F.col("markdown"))).alias("lines_removed"))


def merge_requested(ids: DataFrame, outputs: DataFrame) -> DataFrame:
    """request, markdown, parts: outputs (job_id, markdown) of requested ids (request, job_ids: a list with commas) in the
    order asked; a request with an unknown id has null markdown."""
    asked = ids.select("request", F.posexplode(F.filter(F.transform(F.split("job_ids", ","), strip), lambda x: x != "")).alias("at", "job_id"))
    found = asked.join(outputs.select("job_id", F.lit(True).alias("known"), F.col("markdown").alias("m")), "job_id", "left")
    ms = found.groupBy("request").agg(F.sort_array(F.collect_list(F.struct("at", strip(whole(F.col("m"))).alias("m")))).alias("ms"), F.count("*").alias("parts"), F.count("known").alias("hits"))
    joined = F.array_join(F.filter(F.transform("ms", lambda x: x["m"]), lambda m: m != ""), PAGE_BREAK)
    return ms.select("request", F.when((F.col("hits") == F.col("parts")) & (joined != ""), F.concat(joined, F.lit("\n"))).alias("markdown"), "parts")


def stack_pages(documents: DataFrame, key: str = "request") -> DataFrame:
    """Pages of several documents one after the other: key, page (from 1), source, source_page. documents: key, position,
    source, pages, is_base; the base counts once, at its first place, and a document needs two sources at least."""
    first = F.row_number().over(Window.partitionBy(key, F.when(F.col("is_base"), F.col("source"))).orderBy("position"))
    kept = documents.withColumn("_n", first).where(~F.col("is_base") | (F.col("_n") == 1))
    n = kept.groupBy(key).agg(F.count("*").alias("_k")).where("_k >= 2").select(key)
    w = Window.partitionBy(key).orderBy("position")
    placed = kept.join(n, key, "left_semi").withColumn("_before", F.coalesce(F.sum("pages").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = placed.where("pages >= 1").select(key, "source", "_before", F.explode(F.sequence(F.lit(1), "pages")).alias("source_page"))
    return rows.select(key, (F.col("_before") + F.col("source_page")).alias("page"), "source", "source_page")
