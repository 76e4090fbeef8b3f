"""The corpus pipeline: documents through five of the training-data operators, each stage written and reread.

Each stage is a function of (spark, docs, sf_dir); all but the last return the columns of documents, whatever other
columns docs has. Texts are read whole, whatever their length. doc_id, lang, source and n_chars may be null, ids may
repeat, and rows that repeat are rows of their own, but for near_dedup; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import stored, table
from foliant.llm.language_id import fit_languages, identified
from foliant.llm.packing import pack, public_paths, tokenized_pieces
from foliant.llm.quality import quality_filter
from foliant.llm.simhash import similar_classes
from foliant.llm.suffix_dedup import without_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Near duplicates: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 at least, compared as sets.
SHINGLE, SIMILARITY = 5, 0.8
#: Candidates differ in at most 72 of 4 x 64 bits, and in at most 2 of one of the sixteen 16-bit parts. At 0.8 a bit
#: differs with a probability of 0.1515 (0.1875 in texts of 8 and 9 words that share 4 of 5 shingles): by binomial
#: tails 1 pair in 400,000 is no candidate (1 in 2600).
LIMIT, REACH = 72, 2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; rejected are those without letters (null and empty texts too) and such as fit
    no language learned. Where nothing can be learned, all are rejected."""
    return identified(docs.select(COLUMNS), fit_languages(docs)).where("accepted").select(COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; a null text is an empty one, which has too few words."""
    return quality_filter(docs).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest doc_id (null last); of rows that repeat it,
    one. Texts without words (null and empty ones too) are a class."""
    keyed = stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "keyed")
    # rows in order of doc_id (null last), so that the smallest row of a class is the one that stays
    classes = similar_classes(keyed.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("key"), "text"), SHINGLE, SIMILARITY, LIMIT, REACH, id_col="key")
    kept = classes.where(F.col("key") == F.col("component_id")).select(F.col("key.row").alias("row"))
    return keyed.join(kept, "row", "left_semi").select(COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings leave the texts. A character that is cut in two goes as a whole; n_chars is counted anew (null for
    a null text, which stays). No row goes, also where nothing of its text is left."""
    cut = without_repeats(docs.select(COLUMNS), characters=True)
    text = F.when(F.size("removed") > 0, F.col("kept").cast("string")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 1024: the training set. A null or empty text is one piece, the end."""
    return pack(tokenized_pieces(docs, public_paths()))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: Language models and packing by a linear program have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
