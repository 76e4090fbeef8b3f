"""Words on pages to lines, rows, columns and tables: DataFrame -> DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.tables import flatten
from foliant.functions.text import normalize_cell, once, strip, whole
from foliant.operators.runs import group_bounds, mean_breaks


def layout_lines(words: DataFrame, page: str = "page_id", min_conf: float = 28) -> DataFrame:
    """Text lines of pages: page, block, par, line, text. words: page, block, par, line, pos, left, conf, text.

    Words of a confidence from 0 to under min_conf go (negative ones stay); the rest stand in order of `left`.
    """
    kept = words.where((strip(F.col("text")) != "") & ~F.col("conf").between(0, min_conf - 1e-9))
    parts = kept.groupBy(page, "block", "par", "line").agg(F.sort_array(F.collect_list(F.struct("left", "pos", strip(F.col("text")).alias("t")))).alias("ws"))
    return parts.select(page, "block", "par", "line", F.array_join(F.transform("ws", lambda w: w["t"]), " ").alias("text"))


def page_texts(lines: DataFrame, page: str = "page_id") -> DataFrame:
    """Lines of a page in order, one text."""
    ls = lines.groupBy(page).agg(F.sort_array(F.collect_list(F.struct("block", "par", "line", "text"))).alias("ls"))
    return ls.select(page, F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("text"))


def table_words(words: DataFrame, min_conf: int = 15) -> DataFrame:
    """Words that may stand in a table cell, with right edge and vertical centre."""
    kept = words.where((strip(F.col("text")) != "") & (F.col("conf") >= min_conf))
    return kept.withColumns({"right": F.col("left") + F.col("width"), "cy": F.col("top") + F.col("height") / 2})


def cluster_positions(points: DataFrame, keys: list[str], position: str, min_gap: int) -> DataFrame:
    """Sorted positions split where a gap is wider than min_gap: keys, cluster (from 0), centre (integer mean), size."""
    w = Window.partitionBy(*keys).orderBy(position)
    new = F.when(F.col(position) - F.lag(position).over(w) <= min_gap, 0).otherwise(1)  # min_gap: a number or a column
    islands = points.withColumn("_new", new).withColumn("cluster", (F.sum("_new").over(w) - 1).cast("int"))
    return islands.groupBy(*keys, "cluster").agg(F.floor(F.sum(position) / F.count("*")).alias("centre"), F.count("*").alias("size"))


def longest_run(points: DataFrame, keys: list[str], order: str, flag: Column, min_length: int) -> DataFrame:
    """The longest run of rows whose flag holds, 0 if shorter than min_length: keys, run. Of rows of equal order those
    whose flag does not hold come first."""
    w = Window.partitionBy(*keys).orderBy(order, "_f")
    marked = points.withColumn("_f", F.coalesce(flag, F.lit(False)))
    marked = marked.withColumn("_n", F.row_number().over(w)).withColumn("_k", F.sum(F.when(F.col("_f"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(*keys, (F.col("_n") - F.col("_k")).alias("_island")).agg(F.count_if("_f").alias("_size"))
    best = runs.groupBy(*keys).agg(F.max("_size").alias("run"))
    return best.select(*keys, F.when(F.col("run") >= min_length, F.col("run")).otherwise(0).alias("run"))


def cluster_rows(words: DataFrame, page: str = "page_id") -> DataFrame:
    """Rows of a page: words in order of (cy, left) join the current row if they are near its running mean.

    The tolerance is 0.55 of the mean height of the page's words, 10 at least (14 without heights). A running mean that
    starts anew is no window: rows stream in order of page, cy and left, and only the current row's sum is held. Words
    without a place are in no row. Returns page, row (from 0), pos, left, cy, text.
    """
    tall = words.groupBy(page).agg(F.avg(F.when(F.col("height") > 0, F.col("height"))).alias("_h"))
    known = words.where("cy IS NOT NULL").select(page, "pos", "left", "cy", "text").join(tall, page).withColumn("_tol", F.greatest(F.lit(10.0), F.coalesce(F.col("_h") * 0.55, F.lit(14.0)))).drop("_h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, row, total, n = None, 0, 0.0, 0
        for batch in batches:
            if not len(batch):
                continue
            codes = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            bounds, cy, tol = group_bounds(codes), batch.column(3).to_numpy(), batch.column(5).to_numpy()
            goes_on = now is not None and batch.column(0)[0].as_py() == now[0]
            breaks = mean_breaks(bounds, cy, tol, total if goes_on else 0.0, n if goes_on else 0)
            upto = np.cumsum(breaks)
            rows = upto - np.repeat(upto[bounds[:-1]] - breaks[bounds[:-1]], np.diff(bounds))
            if goes_on:
                rows[: bounds[1]] += row
            last = max(int(bounds[-2]), int(np.nonzero(breaks)[0][-1]) if breaks.any() else 0)  # where the current row begins
            whole_row = last > 0 or not goes_on or bool(breaks[0])
            total, n = float(cy[last:].sum()) + (0.0 if whole_row else total), len(cy) - last + (0 if whole_row else n)
            now, row = (batch.column(0)[len(batch) - 1].as_py(),), int(rows[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows.astype(np.int32)), *(batch.column(c) for c in (1, 2, 3, 4))], names=[page, "row", "pos", "left", "cy", "text"])

    kinds = dict(known.dtypes)
    ordered = known.select(page, "pos", "left", F.col("cy").cast("double"), "text", F.col("_tol").cast("double")).repartition(page).sortWithinPartitions(page, "cy", "left", "pos")
    return ordered.mapInArrow(run, f"`{page}` {kinds[page]}, row int, pos {kinds['pos']}, left {kinds['left']}, cy double, text string")


def assign_columns(words: DataFrame, bounds: list[float]) -> DataFrame:
    """Adds col: the interval of bounds that holds a word's centre, else the last one."""
    cx = F.col("left") + F.col("width") / 2
    last = max(0, len(bounds) - 2)
    col = F.lit(last)
    for i in reversed(range(len(bounds) - 1)):
        col = F.when((cx >= bounds[i]) & (cx < bounds[i + 1]), F.lit(i)).otherwise(col)
    return words.withColumn("col", col)


def cells_to_markdown(cells: DataFrame, table: str, row: str, col: str, cell: str) -> DataFrame:
    """Tables in long form to Markdown: table, markdown. Rows of blank cells go; fewer than two rows give "".

    Rows are padded to the widest; the first row that is left is the header. Of a repeated cell the greatest text counts.
    """
    # one shuffle: rows are made where their table is; the greatest of a sorted row's equal places comes last
    placed = cells.select(table, F.col(row).alias("r"), F.col(col).alias("c"), normalize_cell(F.col(cell)).alias("v")).repartition(table)
    last = lambda e: F.filter(e, lambda x, i: F.coalesce(F.get(e, i + 1)["c"] != x["c"], F.lit(True)))
    rows = placed.groupBy(table, "r").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("e")).withColumn("e", once(F.col("e"), last)).where(F.exists("e", lambda x: x["v"] != ""))
    sheets = rows.groupBy(table).agg(F.sort_array(F.collect_list(F.struct("r", "e"))).alias("rows"), F.max(F.element_at("e", -1)["c"] + 1).alias("w"))
    index = F.sequence(F.lit(0), F.col("w") - 1)

    def line(x):
        cells_ = once(F.map_from_entries(x["e"]), lambda m: F.transform(index, lambda i: F.coalesce(F.try_element_at(m, i), F.lit(""))))
        return F.concat(F.lit("| "), F.array_join(cells_, " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.transform(index, lambda i: F.lit("---")), " | "), F.lit(" |"))
    lines = F.transform("rows", line)
    text = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines))), "\n")
    return sheets.select(table, F.when(F.size("rows") < 2, "").otherwise(text).alias("markdown"))


def flatten_tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, markdown: pipe blocks that make no good table become lines of text; texts without pipes stay as they are."""
    return docs.select(key, flatten(F.col(text)).alias("markdown"))
