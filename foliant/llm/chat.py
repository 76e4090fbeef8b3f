"""Preference formatting: a shared prompt, rendered once, and the two completions with their masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import table

#: A turn is header, text, end; completions are learned from the assistant's text and end.
END = "<|end|>\n"
TRAINED_ROLE = "assistant"


def header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(header(t), t["text"], F.lit(END))))


def masks(turns: Column) -> Column:
    """Runs of characters that are learned from (1) or not (0), as "0:14,1:33,..": they add up to the rendered text."""
    own = lambda t: F.length(header(t))
    body = lambda t: F.length(t["text"]) + len(END)
    return F.concat_ws(",", F.transform(turns, lambda t: F.when(
        t["role"] == TRAINED_ROLE, F.concat(F.lit("0:"), own(t).cast("string"), F.lit(",1:"), body(t).cast("string")),
    ).otherwise(F.concat(F.lit("0:"), (own(t) + body(t)).cast("string")))))


def trained(turns: Column) -> Column:
    return F.aggregate(turns, F.lit(0).cast("long"), lambda n, t: n + F.when(t["role"] == TRAINED_ROLE, F.length(t["text"]) + len(END)).otherwise(0))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns: an array of structs (turn, role, text), in order of turn, and of role and text in repeated ones.

    A null turn comes first; a null role is "unknown" and a null text empty. Rows without conv_id belong to none.
    """
    one = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))


def preference_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, text. pairs: pair_id, chosen_id, rejected_id.

    The prompt is the longest run of first turns whose role and text are equal in both; it is rendered once. What
    follows in each is its completion, with a mask. A conversation that is missing has no turns; equal ones have empty
    completions. Other columns are not read.
    """
    known = conversations(turns)
    side = lambda key, name: known.select(F.col("conv_id").alias(key), F.col("turns").alias(name))
    joined = pairs.select("pair_id", "chosen_id", "rejected_id").join(side("chosen_id", "c"), "chosen_id", "left").join(side("rejected_id", "r"), "rejected_id", "left")
    empty = F.array().cast(known.schema["turns"].dataType)
    joined = joined.withColumns({"c": F.coalesce("c", empty), "r": F.coalesce("r", empty)})
    same = F.zip_with("c", "r", lambda a, b: a.isNotNull() & b.isNotNull() & (a["role"] == b["role"]) & (a["text"] == b["text"]))
    joined = joined.withColumn("n", F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int"))
    joined = joined.withColumns({"p": F.slice("c", F.lit(1), F.col("n")), "c": F.slice("c", F.col("n") + 1, F.size("c")), "r": F.slice("r", F.col("n") + 1, F.size("r"))})
    return joined.select(
        "pair_id", "chosen_id", "rejected_id", F.col("n").cast("long").alias("prompt_turns"), rendered(F.col("p")).alias("prompt"),
        rendered(F.col("c")).alias("chosen"), masks(F.col("c")).alias("chosen_mask"), trained(F.col("c")).alias("chosen_trained"),
        rendered(F.col("r")).alias("rejected"), masks(F.col("r")).alias("rejected_mask"), trained(F.col("r")).alias("rejected_trained"),
    )


def op3_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) are pair k."""
    turns = table(spark, sf_dir, "conversations")
    pair = F.expr("conv_id div 2")
    pairs = turns.where("conv_id IS NOT NULL").select(pair.alias("pair_id")).distinct()
    return preference_pairs(turns, pairs.select("pair_id", (F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id")))


OP3_SQL = r"""
WITH conv AS (
  SELECT conv_id, list({'turn': turn, 'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')} ORDER BY turn, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), pairs AS (
  SELECT DISTINCT conv_id // 2 AS pair_id FROM conv
), j AS (
  SELECT pair_id, coalesce(a.turns, []) AS c, coalesce(b.turns, []) AS r
  FROM pairs LEFT JOIN conv a ON a.conv_id = 2 * pair_id LEFT JOIN conv b ON b.conv_id = 2 * pair_id + 1
), l AS (
  SELECT *, (SELECT coalesce(min(i) - 1, greatest(len(c), len(r))) FROM (SELECT unnest(range(1, greatest(len(c), len(r)) + 1)) AS i)
             WHERE i > least(len(c), len(r)) OR c[i].role <> r[i].role OR c[i].text <> r[i].text) AS n
  FROM j
), s AS (
  SELECT pair_id, n, c[1:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM l
)
SELECT pair_id, 2 * pair_id AS chosen_id, 2 * pair_id + 1 AS rejected_id, n::BIGINT AS prompt_turns,
       coalesce(array_to_string(list_transform(p, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS prompt,
       coalesce(array_to_string(list_transform(c, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS chosen,
       coalesce(array_to_string(list_transform(c, lambda t: CASE WHEN t.role = 'assistant' THEN '0:' || (length(t.role) + 5) || ',1:' || (length(t.text) + 8)
                ELSE '0:' || (length(t.role) + length(t.text) + 13) END), ','), '') AS chosen_mask,
       coalesce(list_sum(list_transform(c, lambda t: CASE WHEN t.role = 'assistant' THEN length(t.text) + 8 ELSE 0 END)), 0)::BIGINT AS chosen_trained,
       coalesce(array_to_string(list_transform(r, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS rejected,
       coalesce(array_to_string(list_transform(r, lambda t: CASE WHEN t.role = 'assistant' THEN '0:' || (length(t.role) + 5) || ',1:' || (length(t.text) + 8)
                ELSE '0:' || (length(t.role) + length(t.text) + 13) END), ','), '') AS rejected_mask,
       coalesce(list_sum(list_transform(r, lambda t: CASE WHEN t.role = 'assistant' THEN length(t.text) + 8 ELSE 0 END)), 0)::BIGINT AS rejected_trained
FROM s
"""
