"""Sinks: Markdown, text and job states, by Spark's writers."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import normalize_markdown, safe_stem, strip_markdown_syntax

SEPARATOR = "\n\n---\n\n"
EMPTY_RESULT = "# Resultado OCR"
#: Files of a subfolder, at most.
FOLDER_FILES = 4096


def result_markdown(markdown: Column) -> Column:
    """Normalized Markdown, or a heading alone where nothing is left."""
    return F.coalesce(F.nullif(normalize_markdown(markdown), F.lit("")), F.lit(EMPTY_RESULT))


def full_markdown(saved: Column, joined: Column, pages: Column, slack: int = 32) -> Column:
    """The saved Markdown, or the pages joined anew where it is missing, shorter, or has too few page breaks."""
    breaks = (F.length(saved) - F.length(F.replace(saved, F.lit(SEPARATOR), F.lit("")))) / len(SEPARATOR)
    stale = saved.isNull() | (F.length(saved) + slack < F.length(joined)) | (breaks < pages - 1)
    return F.when((pages > 1) & stale, joined).otherwise(saved)


def write_results(results: DataFrame, folder: str, key: str = "job_id", markdown: str = "markdown") -> None:
    """One folder of Markdown and one of plain text per key, and a manifest of links."""
    rows = results.select(key, result_markdown(F.col(markdown)).alias("value"))
    rows.write.partitionBy(key).mode("overwrite").text(f"{folder}/md")
    rows.withColumn("value", strip_markdown_syntax(F.col("value"))).write.partitionBy(key).mode("overwrite").text(f"{folder}/txt")
    rows.select(key, F.concat(F.lit("/download/"), key, F.lit("/md")).alias("md"), F.concat(F.lit("/download/"), key, F.lit("/txt")).alias("txt")).write.mode("overwrite").json(f"{folder}/manifest")


def write_files(rows: DataFrame, folder: str, suffix: str, content: str, suffixes: tuple[str, ...]) -> None:
    """A file for each row, of the row's suffix (one of suffixes), with its content and a line end, in subfolders of folder;
    none for a row without content.

    Where folder is a mount that all machines share (file:), tasks write the files themselves: Spark's writer starts
    processes there to set the mode of every file, and its driver renames them one by one. A file is named by task and row
    and gets its name when it is whole, so a task that runs again changes nothing. Other stores get Spark's writer.
    """
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    some = rows.where(F.col(content).isNotNull() & F.col(suffix).isin(*suffixes)).select(suffix, content)
    if store.getScheme() != "file":
        for s in suffixes:
            some.where(F.col(suffix) == s).select(content).write.option("maxRecordsPerFile", 1).option("extension", s).text(f"{folder}/{s}")
        return
    store.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(path, "0"))  # a subfolder also where there are no rows
    root = path.toUri().getPath()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        for batch in batches:
            for s, c in zip(*(x.to_pylist() for x in batch.columns)):
                place = f"{root}/{task.partitionId()}-{n // FOLDER_FILES}"
                if n % FOLDER_FILES == 0:
                    os.makedirs(place, exist_ok=True)
                with open(f"{place}/.{task.taskAttemptId()}", "wb") as file:
                    file.write(c.encode() + b"\n")
                os.replace(file.name, f"{place}/{n}.{s}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    some.mapInArrow(run, "files long").agg(F.sum("files")).collect()


def download_links(job_id: Column, filename: Column, written: Column) -> Column:
    """Struct (txt, md, pdf, docx, name): links to a result's files, null for those formats (of an array) that were not
    written, and the name under which its Markdown is kept."""
    link = lambda f: F.when(F.array_contains(written, f), F.concat(F.lit("/download/"), job_id, F.lit(f"/{f}"))).alias(f)
    return F.struct(*map(link, ("txt", "md", "pdf", "docx")), F.concat(safe_stem(filename), F.lit(".md")).alias("name"))


def append_states(states: DataFrame, folder: str) -> None:
    """Job states as events: the latest one of a job counts."""
    states.write.mode("append").json(folder)
