"""Quality rules as a short-circuit cascade: the rules that reject most for their cost come first.

All of it is DataFrame functions. Each rule is a boolean expression over the text alone, so a rule after the one that
rejects a document is not computed for it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import SPACE, WORD, let, stored, table

#: Rows of the sample that orders the rules, about; it decides the order, never the outcome.
SAMPLE_ROWS = 2000


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(whole(text), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def word_chars(text: Column) -> Column:
    return (F.length(whole(text)) - F.regexp_count(whole(text), F.lit(SPACE))).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(r"[#*$%&|<>]")).cast("long")


def full_lines(text: Column) -> Column:
    return F.filter(F.split(whole(text), "\n", -1), lambda x: x.rlike(WORD))


def n_dup_lines(text: Column) -> Column:
    return let(full_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_words(w: Column, size: int = 3) -> Column:
    """Words in windows of `size` words that an array of words holds twice or more, the first included.

    Equal hashes are looked for first; only a text that has some sorts its windows themselves, which decides.
    """
    n = F.size(w) - (size - 1)
    at = lambda i: [F.element_at(w, (i + k).cast("int")) for k in range(size)]
    starts = F.sequence(F.lit(1), n)
    hashes = F.transform(starts, lambda i: F.xxhash64(*at(i)))

    def covered(keys: Column) -> Column:
        def same(i: Column, step: int) -> Column:
            return F.coalesce(F.get(keys, i)["k"] == F.get(keys, i + step)["k"], F.lit(False))

        found = F.filter(keys, lambda x, i: F.when(i > 0, same(i, -1)).otherwise(False) | same(i, 1))
        places = F.array_sort(F.transform(found, lambda x: x["p"]))
        return let(places, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(size), F.get(p, i + 1) - x), F.lit(size))),
            F.lit(0).cast("long"), lambda a, x: a + x,
        ))

    exact = let(F.array_sort(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *at(i)).alias("k"), i.alias("p")))), covered)
    none = F.lit(0).cast("long")
    return F.when(n < 2, none).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(exact)))


def n_repeat_words(text: Column) -> Column:
    return let(words(text), lambda w: repeated_words(w))


def upper_chars(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(r"\p{Lu}")).cast("long")


METRICS: dict[str, Callable[[Column], Column]] = {
    "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
}


@dataclass(frozen=True)
class Rule:
    """rejects: from the text column, and a function that gives a metric of it, to a boolean column."""

    name: str
    rejects: Callable[[Callable[[str], Column], Column], Column]


BASE_RULES = (
    Rule("few_words", lambda m, t: m("n_words") < 50),
    Rule("repeated_words", lambda m, t: 100 * m("n_repeat_words") > 50 * m("n_words")),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda m, t: 10 * m("n_symbols") > m("n_words")),
    Rule("long_or_short_words", lambda m, t: (m("word_chars") > 12 * m("n_words")) | (2 * m("n_words") > m("word_chars"))),
    Rule("repeated_lines", lambda m, t: 2 * m("n_dup_lines") > F.size(full_lines(t))),
    Rule("capitals", lambda m, t: 2 * upper_chars(t) > m("word_chars")),
)


def from_text(text: Column) -> Callable[[str], Column]:
    return lambda name: METRICS[name](text)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, measured: tuple[str, ...] = ()) -> list[Rule]:
    """The rules by rejections per second, as measured on a sample of about `sample_rows` rows.

    The sample is drawn over the whole table (row counts come from file footers). Each rule runs alone over it, with the
    metrics named in `measured` as columns that are there already; the time of a pass without a rule is taken off.
    Rejections are those among what the rules before leave: after each choice the others are counted anew. Equal and
    unknown rates keep the given order; an empty table too.
    """
    rows = docs.count()
    if not rows:
        return list(rules)
    drawn = docs.select(F.col(text_col).alias("text"))
    drawn = drawn.sample(min(1.0, sample_rows / rows), seed=17) if rows > sample_rows else drawn
    text = F.col("text")
    sample = stored(drawn.select("text", *[METRICS[k](text).alias(k) for k in measured]), "quality-sample")

    def metric(name: str) -> Column:
        return F.col(name) if name in measured else METRICS[name](text)

    def timed(condition: Column) -> float:
        began = time.perf_counter()
        sample.agg(F.count_if(condition)).first()
        return time.perf_counter() - began

    idle = min(timed(F.length(text) < 0) for _ in range(2))
    cost = [max(min(timed(rule.rejects(metric, text)) for _ in range(2)) - idle, 1e-3) for rule in rules]
    # how many rows each set of rules rejects: no more groups than the sample has rows
    met = sample.select(*[F.coalesce(rule.rejects(metric, text), F.lit(False)).alias(f"r{k}") for k, rule in enumerate(rules)])
    counts = [(r[:-1], r[-1]) for r in met.groupBy(*met.columns).count().collect()]
    ordered, left = [], list(range(len(rules)))
    while left:
        best = max(left, key=lambda k: sum(n for hit, n in counts if hit[k]) / cost[k])
        ordered.append(rules[best])
        left.remove(best)
        counts = [(hit, n) for hit, n in counts if not hit[best]]
    return ordered


def verdict(rules: list[Rule], metric: Callable[[str], Column], text: Column) -> Column:
    """The name of the first rule that rejects, else null. CASE stops at the first true branch."""
    out = None
    for rule in rules:
        out = F.when(rule.rejects(metric, text), rule.name) if out is None else out.when(rule.rejects(metric, text), rule.name)
    return F.lit(None).cast("string") if out is None else out


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that no rule rejects, with docs' columns and types. A null text counts as an empty one, which the
    rule of few words rejects; a text is measured whole, whatever its length; rows that repeat are judged each on its own;
    no other column is read, and an empty table stays empty."""
    text = F.col(text_col)
    return docs.where(verdict(order_rules(docs, rules, text_col, sample_rows), from_text(text), text).isNull())


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of docs (doc_id, text): every metric, the base verdict and the cascade's.

    A null text counts as empty: no words, base_failed, not kept. Null or repeated doc_id are rows of their own;
    other columns are not read; an empty table gives no rows. `failed_rule` is the first rule that rejects, in the measured
    order. The metrics are results of their own and there for every row; what a rule needs besides (capitals, lines) is
    worked out only for rows that the rules before leave.
    """
    ordered = order_rules(docs, rules, "text", sample_rows, tuple(METRICS))
    text = F.col("text")
    measured = docs.select("doc_id", "text", words(text).alias("w"))
    measured = measured.select(
        "doc_id", "text", F.size("w").cast("long").alias("n_words"),
        *[METRICS[k](text).alias(k) for k in ("word_chars", "n_symbols", "n_dup_lines")],
        repeated_words(F.col("w")).alias("n_repeat_words"),
    )
    base = F.lit(False)
    for rule in BASE_RULES:
        base = base | rule.rejects(F.col, text)
    return measured.select(
        "doc_id", *METRICS, base.alias("base_failed"), verdict(ordered, F.col, text).alias("failed_rule"),
    )


def op1_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", *METRICS, "base_failed", (~F.col("base_failed") & F.col("failed_rule").isNull()).alias("kept"))


OP1_SQL = r"""
WITH base AS (
  SELECT doc_id, row_number() OVER () AS rn, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, rn, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM base
), win AS (
  SELECT rn, unnest(range(1, len(words) - 1)) AS p, words FROM w
), keyed AS (
  SELECT rn, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] AS k FROM win
), counted AS (
  SELECT rn, p, count(*) OVER (PARTITION BY rn, k) AS c FROM keyed
), gaps AS (
  SELECT rn, least(3, coalesce(lead(p) OVER (PARTITION BY rn ORDER BY p) - p, 3)) AS g FROM counted WHERE c > 1
), rep AS (
  SELECT rn, sum(g)::BIGINT AS n_repeat_words FROM gaps GROUP BY rn
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
         length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS upper_chars
  FROM w LEFT JOIN rep USING (rn)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars > 12 * n_words OR 2 * n_words > word_chars
            OR 2 * n_dup_lines > n_lines OR 2 * upper_chars > word_chars) AS kept
FROM b
"""
