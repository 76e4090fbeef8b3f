"""Sources: files, job states and Markdown, by Spark's readers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What can be ingested.
SUFFIXES = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")
MAX_BYTES = 300 * 1024 * 1024
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
JOB_SCHEMA = "job_id string, status string, progress int, pages_total int, updated_at string, created_at string, _corrupt_record string"


def file_id(path=None):
    """An eight-character id, the same for the same path."""
    return F.substring(F.sha2(path if path is not None else F.col("path"), 256), 1, 8)


def documents(spark: SparkSession, folder: str, streaming: bool = False, max_bytes: int = MAX_BYTES, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Files of known suffixes up to a size, with file_id and suffix; a stream needs the schema spelled out."""
    reader = spark.readStream.schema(FILE_SCHEMA) if streaming else spark.read.schema(FILE_SCHEMA)
    files = reader.format("binaryFile").load(folder)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumns({"file_id": file_id(), "suffix": suffix}).where(F.col("suffix").isin(*suffixes) & (F.col("length") <= max_bytes))


def job_states(spark: SparkSession, folder: str) -> DataFrame:
    """Job states from JSON files; malformed ones and such as are no objects are left out."""
    states = spark.read.schema(JOB_SCHEMA).option("mode", "PERMISSIVE").option("multiLine", True).json(folder)
    return states.where("_corrupt_record IS NULL AND job_id IS NOT NULL").drop("_corrupt_record")


def rescued_states(spark: SparkSession, folder: str) -> DataFrame:
    """Job states from files of JSON lines: the states' columns, raw and reason.

    A line that is no state is not lost: raw is the line and reason tells why: 'malformed' JSON, 'no object', 'no job_id' or
    'wrong type' of a column. Both are null for a state. Blank lines are nothing.
    """
    lines = spark.read.text(folder).where(F.trim("value") != "")
    states = F.from_json("value", JOB_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = lines.select("value", states.alias("s")).select("value", "s.*")
    reason = (
        F.when(F.try_parse_json("value").isNull(), "malformed").when(~F.trim("value").startswith("{"), "no object")
        .when(F.get_json_object("value", "$.job_id").isNull(), "no job_id").when(F.col("_corrupt_record").isNotNull(), "wrong type")
    )
    return parsed.select(*[F.when(reason.isNull(), F.col(c)).alias(c) for c in parsed.columns if c not in ("value", "_corrupt_record")], F.when(reason.isNotNull(), F.col("value")).alias("raw"), reason.alias("reason"))


def written_results(spark: SparkSession, folder: str, asked: DataFrame, key: str = "job_id") -> DataFrame:
    """key, markdown: the results of writers.write_results that are asked for, and null where there is none."""
    kept = spark.read.text(f"{folder}/md", wholetext=True).select(F.col(key).cast(dict(asked.dtypes)[key]).alias(key), F.col("value").alias("markdown"))
    return asked.select(key).join(kept, key, "left")


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """job_id (the file's name) and markdown, a file a row."""
    files = spark.read.text(folder, wholetext=True).withColumn("path", F.input_file_name())
    return files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("job_id"), F.col("value").alias("markdown"))


def page_batches(documents_: DataFrame, key: str, pages: str, size: int = 8) -> DataFrame:
    """key, page (from 1), batch: pages of a document in batches for an engine. Unknown counts are one page."""
    n = F.greatest(F.lit(1), F.coalesce(F.col(pages), F.lit(1)))
    return documents_.select(key, F.explode(F.sequence(F.lit(1), n)).alias("page")).withColumn("batch", ((F.col("page") - 1) / size).cast("int"))


def with_engine(pages: DataFrame, engine: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Pages through an external engine (optical recognition, a converter): whole Arrow batches go in and out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield engine(batch)

    return pages.mapInPandas(run, schema)
