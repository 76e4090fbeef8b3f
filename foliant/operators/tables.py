"""Tables from words and rulings: DataFrame -> DataFrame. Words are those of `layout.table_words`, in rows of
`layout.cluster_rows`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import tables as T
from foliant.functions.scores import header_hits, score_table_markdown
from foliant.functions.text import once, strip
from foliant.operators.layout import cluster_positions


def grid_lines(profiles: DataFrame, page: str = "page_id") -> DataFrame:
    """page, h_bounds, v_bounds: the rulings of a page. profiles: page, axis ('row' or 'column'), pos, density (share of
    dark pixels of a row of pixels), run (longest dark run of a column of pixels).

    A row of pixels is a line from the 0.92 quantile of density on, 0.22 at least; a column from a run of 72 % of the
    height on, 70 at least. Lines that touch are one, those too close to the last one kept go, narrow columns merge.
    Pages under 40 pixels either way or with fewer than three lines of a kind have none.
    """
    sizes = profiles.groupBy(page).agg(
        F.count_if(F.col("axis") == "row").cast("int").alias("h"), F.count_if(F.col("axis") == "column").cast("int").alias("w"),
        F.percentile(F.when(F.col("axis") == "row", F.col("density")), F.lit(0.92)).alias("q"),
    )
    known = profiles.join(sizes.where("h >= 40 AND w >= 40"), page)
    tall = F.greatest(F.floor(F.col("h") * 0.72), F.lit(70))
    line = F.when(F.col("axis") == "row", F.col("density") >= F.greatest(F.lit(0.22), F.col("q"))).otherwise(F.col("run") >= tall)
    marked = known.where(line)
    gap = F.greatest(F.lit(4), F.floor(F.when(F.col("axis") == "row", F.col("h")).otherwise(F.col("w")) * 0.002)).cast("int")
    lines = cluster_positions(marked.withColumn("_gap", gap), [page, "axis"], "pos", F.col("_gap"))
    bounds = lines.groupBy(page).agg(*[
        F.sort_array(F.collect_list(F.when(F.col("axis") == axis, F.col("centre").cast("int")))).alias(name) for axis, name in (("row", "hs"), ("column", "vs"))
    ])
    both = bounds.join(sizes, page)

    def apart(b: str, share: float, least: int):
        return F.greatest(F.lit(least), F.floor(T.typical_gap(F.col(b)) * share).cast("int"))

    some = (F.size("hs") >= 3) & (F.size("vs") >= 3)
    both = both.where(some).withColumns({"hs": T.spaced(F.col("hs"), apart("hs", 0.45, 14)), "vs": T.spaced(F.col("vs"), apart("vs", 0.55, 28))})
    both = both.withColumn("vs", T.merge_narrow(F.col("vs"), F.col("w"))).withColumn("vs", T.cap_columns(F.col("vs"), F.col("w")))
    none = F.array().cast("array<int>")
    return sizes.select(page).join(both, page, "left").select(page, F.coalesce("hs", none).alias("h_bounds"), F.coalesce("vs", none).alias("v_bounds"))


def infer_bounds(rows: DataFrame, pages: DataFrame, page: str = "page_id") -> DataFrame:
    """page, bounds: column edges of a page without rulings. rows: page, row (from 0), pos, left, width; pages: page, width.

    The middles of the twelve widest gaps of the first eight rows, 28 apart; where they give fewer than four columns,
    quantiles of the words' centres, 30 apart.
    """
    words = F.sort_array(F.collect_list(F.struct("row", "left", "pos", "width")))
    joined = pages.select(page, F.col("width").cast("double").alias("_w")).join(rows.groupBy(page).agg(words.alias("ws")), page, "left")
    return joined.select(page, F.coalesce(bounds_of(F.col("ws"), F.col("_w")), F.array(F.lit(0.0), F.col("_w"))).alias("bounds"))


def bounds_of(words: Column, width: Column) -> Column:
    """The bounds of infer_bounds from a page's words (an array of structs with row, left and width) by row and left edge."""
    right = lambda w: w["left"] + w["width"]

    def gap(w: Column, i: Column) -> Column:
        after = F.get(words, i + 1)
        wide = (w["row"] < 8) & after["row"].eqNullSafe(w["row"]) & (after["left"] - right(w) >= 14)
        return F.when(wide, F.struct((right(w) - after["left"]).alias("d"), i.alias("i"), F.bround((right(w) + after["left"]) / 2, 1).alias("mid")))

    def middles(gaps: Column) -> Column:
        return F.sort_array(F.array_distinct(F.transform(F.slice(F.sort_array(gaps), 1, 12), lambda g: g["mid"])))

    zero, edge, n = F.array(F.lit(0.0)), F.array(width), F.size(words)

    def by_gaps(mids: Column) -> Column:
        return F.when(F.size(mids) > 0, once(F.concat(T.spaced(F.concat(zero, mids), F.lit(28)), edge), lambda b: F.when(F.size(b) >= 5, b)))

    def quantiles(centres: Column) -> Column:
        m = F.least(F.lit(8), F.greatest(F.lit(4), F.floor(n / 6))).cast("int")

        def between(at: Column) -> Column:
            low, high = F.get(centres, F.floor(at).cast("int")), F.get(centres, F.ceil(at).cast("int"))
            return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

        return F.transform(F.sequence(F.lit(1), m - 2), lambda i: once(i / (m - 1) * (F.size(centres) - 1), between))

    def by_centres() -> Column:
        centres = F.array_sort(F.filter(F.transform(words, lambda w: w["left"] + w["width"] / 2), lambda c: c.isNotNull()))
        return F.when(n < 8, F.concat(zero, edge)).otherwise(F.concat(T.spaced(F.concat(zero, once(centres, quantiles)), F.lit(30)), edge))

    gaps = F.filter(F.transform(words, gap), lambda g: g.isNotNull())
    return once(once(gaps, middles), lambda mids: F.coalesce(by_gaps(mids), by_centres()))


def rows_of_cells(words: DataFrame, bounds: DataFrame, page: str = "page_id") -> DataFrame:
    """page, rows (array of rows of cells). words: page, row, pos, left, width, text; bounds: page, bounds.

    A word stands in the column that holds its centre, else in the last; the words of a cell in order of their left edge.
    """
    placed = words.join(bounds, page).withColumn("col", T.column_of(F.col("left") + F.col("width") / 2, F.col("bounds")))
    cells = placed.groupBy(page, "row", "col").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("left", "pos", "text"))), lambda x: x["text"]), " ").alias("cell"), F.max(F.size("bounds") - 1).alias("n")
    )
    lines = cells.groupBy(page, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "cell"))).alias("m"), F.max("n").alias("n"))
    row = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("")))
    sheets = lines.select(page, "row", row.alias("cells")).groupBy(page).agg(F.sort_array(F.collect_list(F.struct("row", "cells"))).alias("ls"))
    return sheets.select(page, F.transform("ls", lambda x: x["cells"]).alias("rows"))


def grid_tables(words: DataFrame, grids: DataFrame, page: str = "page_id") -> DataFrame:
    """page, markdown by rulings. words: page, pos, left, width, cy, text; grids: page, h_bounds, v_bounds.

    Bands under 14 high are no rows; header rows that are split are merged.
    """
    known = grids.where((F.size("h_bounds") >= 3) & (F.size("v_bounds") >= 3))
    bands = known.select(page, F.posexplode(F.slice("h_bounds", F.lit(1), F.size("h_bounds") - 1)).alias("row", "y0"), "h_bounds")
    bands = bands.withColumn("y1", F.get("h_bounds", F.col("row") + 1)).where(F.col("y1") - F.col("y0") >= 14).drop("h_bounds")
    inside = words.join(bands, page).where((F.col("cy") >= F.col("y0")) & (F.col("cy") < F.col("y1")))
    rows = rows_of_cells(inside, known.select(page, F.col("v_bounds").cast("array<double>").alias("bounds")), page)
    return rows.select(page, T.rows_to_markdown(T.merge_header(T.trim_edges(F.col("rows")))).alias("markdown"))


def cluster_tables(words: DataFrame, pages: DataFrame, page: str = "page_id") -> DataFrame:
    """page, markdown from words in rows alone (page, row, pos, left, width, text); three rows at least. pages: page, width."""
    ordered = F.sort_array(F.collect_list(F.struct("row", "left", "pos", "text", "width")))
    sheets = words.groupBy(page).agg(F.max("row").alias("_last"), ordered.alias("ws")).where("_last >= 2").select(page, "ws")
    wide = sheets.join(pages.select(page, F.col("width").cast("double").alias("_w")).hint("shuffle_hash"), page)
    known = wide.select(page, "ws", bounds_of(F.col("ws"), F.col("_w")).alias("bounds"))
    rows = known.select(page, cells_of(F.col("ws"), F.col("bounds")).alias("rows"))
    return rows.select(page, T.rows_to_markdown(T.trim_edges(F.col("rows"))).alias("markdown"))


def cells_of(words: Column, bounds: Column) -> Column:
    """The rows of cells of rows_of_cells from a page's words (an array of structs with row, left, width and text) in order
    of row, left edge, pos and text."""
    begins = F.filter(F.transform(words, lambda w, i: F.when((i == 0) | ~F.get(words, i - 1)["row"].eqNullSafe(w["row"]), i)), lambda i: i.isNotNull())

    def cells(line: Column, edges: Column) -> Column:
        n = F.size(edges)
        # T.column_of for bounds that ascend, but for the last one, by the left edges that a word's centre has passed
        passed = lambda w: F.size(F.filter(edges, lambda e: e <= w["left"] + w["width"] / 2))
        placed = F.transform(line, lambda w: F.struct(((passed(w) + n - 1) % n).alias("col"), w["text"].alias("text")))
        return once(placed, lambda ws: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.transform(F.filter(ws, lambda w: w["col"] == i), lambda w: w["text"]), " ")))

    def lines(starts: Column, edges: Column) -> Column:
        return F.transform(starts, lambda s, k: once(F.slice(words, s + 1, F.coalesce(F.get(starts, k + 1), F.size(words)) - s), lambda line: cells(line, edges)))

    return once(F.slice(bounds, F.lit(1), F.size(bounds) - 1), lambda edges: once(begins, lambda starts: lines(starts, edges)))


def header_tables(words: DataFrame, pages: DataFrame, page: str = "page_id", least_words: int = 24) -> DataFrame:
    """page, markdown under a header row: the first of ten rows with three header words. words: page, row, pos, left,
    width, text; pages: page, width.

    Short words of the header that are no header word belong to the name before; edges lie midway between the names.
    Rows that repeat the header and blank rows go.
    """
    lines = words.groupBy(page, "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("left", "pos", "text"))), lambda x: x["text"]).alias("ts"), F.count("*").alias("k"))
    enough = lines.groupBy(page).agg(F.sum("k").alias("n"), F.min(F.when((F.col("row") < 10) & (header_hits(F.array_join("ts", " ")) >= 3), F.col("row"))).alias("header"))
    headed = words.join(enough.where((F.col("n") >= least_words) & F.col("header").isNotNull()).select(page, "header"), page)
    w = Window.partitionBy(page).orderBy("left", "pos", "text")
    head = headed.where("row = header")
    part = (header_hits(F.col("text")) == 0) & (F.length(F.upper("text")) <= 3)
    head = head.withColumn("_new", F.when(part & (F.row_number().over(w) > 1), 0).otherwise(1)).withColumn("col", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    names = head.groupBy(page, "col").agg(
        F.min("left").alias("l"), F.max_by(F.col("left") + F.col("width"), F.struct("left", "pos", "text")).alias("r"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("left", "pos", "text"))), lambda x: x["text"]), " ").alias("name"),
    )
    heads = names.groupBy(page).agg(F.sort_array(F.collect_list(F.struct("col", ((F.col("l") + F.col("r")) / 2).alias("c"), "name"))).alias("h")).where(F.size("h") >= 3)
    middles = F.zip_with(F.slice("h", F.lit(2), F.size("h")), F.slice("h", F.lit(1), F.size("h") - 1), lambda b, a: (a["c"] + b["c"]) / 2)
    heads = heads.join(pages.select(page, "width"), page).select(
        page, F.concat(F.array(F.lit(0.0)), middles, F.array(F.col("width").cast("double"))).alias("bounds"), F.transform("h", lambda x: x["name"]).alias("names"))
    body = rows_of_cells(headed.where("row > header"), heads.select(page, "bounds"), page)
    kept = F.filter("rows", lambda r: T.filled(r) & ~T.is_header(F.array_join(r, " ")))
    joined = heads.join(body, page).select(page, "names", kept.alias("rows")).where(F.size("rows") >= 1)
    return joined.select(page, T.rows_to_markdown(T.trim_edges(F.concat(F.array("names"), "rows"))).alias("markdown"))


def best_table(candidates: DataFrame, page: str = "page_id") -> DataFrame:
    """Of each page (page, ordinal, markdown) the table with the highest score, of equal ones the first, if it is accepted."""
    scored = candidates.where(F.col("markdown") != "").withColumn("score", score_table_markdown(F.col("markdown")))
    best = scored.groupBy(page).agg(F.max_by(F.struct("markdown", "score", "ordinal"), F.struct("score", -F.col("ordinal"))).alias("b"))
    return best.select(page, "b.*").where(T.accept_table(F.col("markdown"), F.col("score")))


def best_tables(candidates: DataFrame, page: str = "page_id") -> DataFrame:
    """Of each page (page, ordinal, markdown) all tables that have the page's highest score, if that is over 0, in order:
    page, position (from 0), markdown, score."""
    scored = candidates.withColumn("score", score_table_markdown(F.col("markdown")))
    # a filter on the score before the ranks would work it out a second time
    ranked = scored.withColumn("_r", F.rank().over(Window.partitionBy(page).orderBy(F.desc("score")))).where("_r = 1 AND score > 0")
    return ranked.withColumn("position", F.row_number().over(Window.partitionBy(page).orderBy("ordinal")) - 1).select(page, "position", "markdown", "score")


def first_fit_lines(words: DataFrame, page: str = "page_id", within: float = 18, least: float = 0.28, noise=None) -> DataFrame:
    """page, text, confidence (per cent): words (page, pos, left, top, conf, text) in lines of a layout engine.

    Words by (top, left) join the first line whose first word is at most `within` higher or lower, so a line begins
    where a word is beyond that from the last beginning. Lines that are noise go, with their words' confidences.
    """
    kept = words.where((strip(F.coalesce("text", F.lit(""))) != "") & (F.coalesce("conf", F.lit(0.0)) >= least))
    tops = kept.select(page, "top").distinct().groupBy(page).agg(F.array_sort(F.collect_list("top")).alias("tops"))
    # words come in order of top, so of the lines so far only the last can be near: beginnings are spaced positions
    starts = tops.select(page, F.aggregate("tops", F.slice("tops", 1, 1), lambda s, t: F.when(t - F.element_at(s, -1) > within, F.concat(s, F.array(t))).otherwise(s)).alias("starts"))
    first = F.array_max(F.filter("starts", lambda s: s <= F.col("top")))
    lines = kept.join(starts, page).withColumn("line", first).groupBy(page, "line").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("left", "top", "pos", strip(F.col("text")).alias("t")))), lambda x: x["t"]), " ").alias("t"),
        F.sum("conf").alias("c"), F.count("*").alias("n"),
    )
    lines = lines if noise is None else lines.where(~noise(F.col("t")))
    out = lines.groupBy(page).agg(F.sort_array(F.collect_list(F.struct("line", "t"))).alias("ls"), (F.sum("c") / F.sum("n") * 100).alias("confidence"))
    return out.select(page, F.array_join(F.transform("ls", lambda x: x["t"]), "\n").alias("text"), "confidence")
