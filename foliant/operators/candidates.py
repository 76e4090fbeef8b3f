"""The best of several readings of a page: DataFrame -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.cleaning import append_annotations, format_annotations
from foliant.functions.scores import accent_share, accent_words, default_quality_score, text_quality_score
from foliant.functions.text import once, strip, strip_markdown_syntax, whole

# The variants of a page image, how many configurations read one, what a quick reading has to reach, and what
# a point of confidence counts.
QUICK, PLAIN = "quick", "plain"
VARIANTS = ("base", "soft", "strong", "binary", "invert", "fine")
CONFIGS, GOOD_SCORE, LEAST_CHARS, CONFIDENCE = 5, 36, 24, 1.35


def candidate_scores(words: DataFrame, keys: list[str], conf: str, quality: str) -> DataFrame:
    """keys, confidence (mean of words, -1 left out, 55 without any) and score: quality + 1.35 x confidence."""
    mean = F.coalesce(F.avg(F.when(F.col(conf) != -1, F.col(conf))), F.lit(55.0))
    scored = words.groupBy(*keys).agg(mean.alias("confidence"), F.max(quality).alias("quality"))
    return scored.withColumn("score", F.col("quality") + 1.35 * F.col("confidence"))


def best_candidate(candidates: DataFrame, page: str, score: str, ordinal: str, value: str) -> DataFrame:
    """Of each page the value with the highest score; of equal ones the first by ordinal."""
    best = F.max_by(F.struct(F.col(value).alias("v"), F.col(score).alias("s"), F.col(ordinal).alias("o")), F.struct(score, -F.col(ordinal)))
    return candidates.groupBy(page).agg(best.alias("b")).select(page, F.col("b.v").alias(value), F.col("b.s").alias(score), F.col("b.o").alias(ordinal))


def first_accepted(candidates: DataFrame, page: str, priority: str, accepted: str, value: str) -> DataFrame:
    """Of each page the value of the accepted candidate that comes first; pages without one have none."""
    return candidates.where(accepted).groupBy(page).agg(F.min_by(value, priority).alias(value), F.min(priority).alias(priority))


def vote(readings: DataFrame, page: str, text: str, provider: str, within: float = 0.5) -> DataFrame:
    """page, text, label: the best reading by (score, length, accent ratio), and all providers within 0.5 of its score.

    Readings under eight characters have no vote.
    """
    size = F.length(strip(whole(F.col(text))))
    known = readings.where(size >= 8).withColumns({"_words": accent_words(F.col(text)), "size": size})
    scored = known.withColumns({"score": default_quality_score(F.col(text), F.col("_words")), "ratio": accent_share(F.col("_words"))})
    # one text of a page leaves a task; of the others only the scores do
    best = scored.groupBy(page).agg(
        F.max_by(text, F.struct("score", "size", "ratio", F.col(provider))).alias("text"), F.max("score").alias("best"),
        F.collect_set(F.struct(F.col(provider).alias("p"), F.col("score").alias("s"))).alias("votes"),
    )
    near = F.filter("votes", lambda v: F.abs(v["s"] - F.col("best")) < within)
    tied = F.array_join(F.sort_array(F.array_distinct(F.transform(near, lambda v: v["p"]))), "+")
    return best.select(page, "text", F.concat(F.lit("parallel:"), tied).alias("label"))


def reading_steps() -> list[tuple[str, int, int, str, int]]:
    """plan, step, ordinal, variant, config: the candidates of each plan in order; those of step 0 may settle a page."""
    quick = [(0, 0, QUICK, 0)]

    def every(variants: tuple[str, ...], configs: int) -> list[tuple]:
        return [(1, k, v, c) for k, (v, c) in enumerate((v, c) for v in variants for c in range(configs))]

    plans = {
        "fast": every((QUICK,), 2), "quality": every(VARIANTS, CONFIGS), "balanced": quick + every(VARIANTS[:4], 3),
        "range": quick + every((PLAIN, VARIANTS[1]), 2), "bulk": quick + every(VARIANTS[:2], 2),
    }
    return [(plan, *step) for plan, steps in plans.items() for step in steps]


def read_by_mode(candidates: DataFrame, pages: DataFrame, page: str = "page_id", score: Callable[[Column], Column] = text_quality_score) -> DataFrame:
    """page, variant, config, text, score, early: the reading of each page that its mode settles on.

    pages: page, mode ('fast', 'quality' or 'balanced'), bulk, is_range; candidates: page, variant, config, text, confidence.
    A reading's score is its quality + 1.35 x confidence; one without text has 0 and never wins. A fast page takes the best
    of two quick readings, a page of quality the best of all variants and configurations; of equal ones the first, in the
    order of the plan. Other pages first get one quick reading, which settles them if it reaches 36 and has 48 characters
    without syntax (24 in a range), or in bulk if it has any text; only pages that are left have more readings scored, and
    the best of these replaces the quick one unless it is worse. A page without a reading keeps an empty text.
    """
    plan = (
        F.when(F.col("mode") == "fast", "fast").when((F.col("mode") == "quality") & ~F.col("bulk"), "quality")
        .when(F.col("bulk"), "bulk").when(F.col("is_range"), "range").otherwise("balanced")
    )
    steps = pages.sparkSession.createDataFrame(reading_steps(), "_plan string, _step int, _ordinal int, variant string, config int")  # under 100 rows
    known = pages.select(page, plan.alias("_plan"))
    asked = candidates.select(page, "variant", "config", whole(F.col("text")).alias("text"), "confidence").join(known, page).join(F.broadcast(steps), ["_plan", "variant", "config"])
    value = F.when(F.col("text") == "", 0.0).otherwise(score(F.col("text")) + CONFIDENCE * F.col("confidence"))
    scored = lambda df: df.withColumn("score", value)
    fields = F.struct("variant", "config", "text", "score")
    quick = scored(asked.where("_step = 0")).groupBy(page).agg(F.max_by(F.struct(*[F.col(c) for c in ("variant", "config", "text", "score", "_plan")]), "score").alias("q"))
    size = F.length(strip_markdown_syntax(F.col("q.text")))
    good = (F.col("q.score") >= GOOD_SCORE) & (size >= F.when(F.col("q._plan") == "range", LEAST_CHARS).otherwise(2 * LEAST_CHARS))
    quick = quick.withColumn("early", good | ((F.col("q._plan") == "bulk") & (F.col("q.text") != "")))
    left = asked.where("_step = 1").join(quick.where("early").select(page), page, "left_anti")
    # a filter on the score would work it out a second time, before the rows
    order = F.when(F.col("score") > 0, F.struct("score", -F.col("_ordinal")))
    best = scored(left).groupBy(page).agg(F.max_by(fields, order).alias("f"))
    joined = known.join(quick, page, "left").join(best, page, "left").withColumn("early", F.coalesce("early", F.lit(False)))
    zero = F.lit(0.0)
    better = F.coalesce(F.col("f.score"), zero) >= F.coalesce(F.col("q.score"), zero)
    pick = lambda c: F.when(better, F.col(f"f.{c}")).otherwise(F.col(f"q.{c}"))
    taken = lambda c: F.when(F.col("early"), F.col(f"q.{c}")).otherwise(pick(c))
    has_text = whole(taken("text")) != ""
    return joined.select(page, *[F.when(has_text, taken(c)).alias(c) for c in ("variant", "config")], whole(taken("text")).alias("text"), F.coalesce(taken("score"), zero).alias("score"), "early")


def top_lines(lines: DataFrame, page: str, line: str, score: str, most: int = 24) -> DataFrame:
    """Of each page the `most` best distinct lines (lower case; of equal ones the best reading): page, rank, line, score."""
    key = F.lower(F.col(line))
    best = lines.groupBy(page, key.alias("key")).agg(F.max_by(line, F.struct(score, line)).alias("line"), F.max(score).alias("score"))
    rank = F.row_number().over(Window.partitionBy(page).orderBy(F.desc("score"), "key"))
    return best.withColumn("rank", rank).where(F.col("rank") <= most).select(page, "rank", "line", "score")


def new_to(lines: Column, main: Column, gram: int = 12, stride: int = 4, longest: int = 80) -> Column:
    """Lines of an array that a text does not hold: neither whole nor, up to `longest` characters, by a gram at every
    `stride`-th place."""
    def held(line: Column, low: Column, key: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.length(key) - gram, F.lit(0)), F.lit(stride))
        return F.contains(low, key) | ((F.length(line) <= longest) & (F.length(key) >= gram) & F.exists(places, lambda i: F.contains(low, F.substr(key, i + 1, F.lit(gram)))))

    def fresh(low: Column) -> Column:
        return F.filter(F.transform(lines, strip), lambda x: (F.length(x) >= 2) & ~once(F.lower(x), lambda key: held(x, low, key)))

    return once(F.lower(whole(main)), fresh)


def enrich_pages(pages: DataFrame, lines: DataFrame, page: str, markdown: str, most: int = 24) -> DataFrame:
    """page, markdown: pages with a section of what a second reading (lines: page, line, score) has and they have not."""
    some = lines.withColumn("line", strip(F.col("line"))).where(F.length("line") >= 2)
    best = top_lines(some, page, "line", "score", most)
    extra = best.groupBy(page).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("_ls"))
    joined = pages.select(page, F.col(markdown).alias("_md")).join(extra, page, "left").withColumn("_plain", strip_markdown_syntax(F.col("_md")))
    fresh = new_to(F.split(format_annotations(F.coalesce("_ls", F.array().cast("array<string>"))), "\n", -1), F.col("_plain"))
    bare = F.transform(fresh, lambda x: strip(F.regexp_replace(x, r"^-\s*\*\*[^*]+\*\*:\s*", "")))
    body = joined.select(page, "_md", format_annotations(bare).alias("_body"))
    return body.select(page, append_annotations(F.col("_md"), F.col("_body")).alias("markdown"))
