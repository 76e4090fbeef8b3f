"""Tables as arrays of rows of cells, and the lines of a grid as arrays of positions: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.cleaning import replace_each
from foliant.functions.scores import HEADER_HINTS, HEADER_KEYS, bounded, header_hits, looks_like_payroll, score_table_markdown, table_columns, table_content_quality
from foliant.functions.text import normalize_cell, once, strip, whole

__all__ = ["HEADER_KEYS", "accept_table", "box_to_xyxy", "cap_columns", "column_of", "flatten", "has_grid", "merge_header", "merge_narrow", "rows_to_markdown", "spaced", "trim_edges", "typical_gap"]


def padded(rows: Column) -> Column:
    """Rows with empty cells added up to the widest."""
    width = F.array_max(F.transform(rows, F.size))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def filled(row: Column) -> Column:
    return F.exists(row, lambda c: F.coalesce(c, F.lit("")) != "")


def trim_edges(rows: Column) -> Column:
    """Rows of equal width without empty rows at either end and without columns that are blank all the way down."""

    def inner(full: Column) -> Column:
        places = F.filter(F.transform(full, lambda r, i: F.when(filled(r), i)), lambda i: i.isNotNull())
        kept = F.slice(full, F.array_min(places) + 1, F.array_max(places) - F.array_min(places) + 1)
        return F.when(F.size(places) > 0, once(kept, without_blank_columns)).otherwise(F.array().cast("array<array<string>>"))

    return F.when(F.size(rows) > 0, once(padded(rows), inner)).otherwise(rows)


def without_blank_columns(rows: Column) -> Column:
    columns = F.filter(F.sequence(F.lit(0), F.size(rows[0]) - 1), lambda i: F.exists(rows, lambda r: strip(F.get(r, i)) != ""))
    return once(columns, lambda keep: F.transform(rows, lambda r: F.transform(keep, lambda i: F.get(r, i))))


def merge_header(rows: Column) -> Column:
    """A header that is spread over the first three rows as one: their different cells in order. Rows after the first
    that hold two cells at most go; the others get the header's width, what is beyond in the last cell.

    Tables without a header word there, of one row, or with fewer than three different cells stay.
    """
    head = F.slice(rows, 1, 3)
    header = F.array_distinct(F.filter(F.transform(F.flatten(head), normalize_cell), lambda c: c != ""))
    hinted = F.array_join(F.flatten(head), " ").rlike("(?iu)" + bounded(HEADER_HINTS))

    def merged(names: Column) -> Column:
        n = F.size(names)
        body = F.slice(rows, F.lit(2), F.size(rows))
        full = F.filter(F.transform(body, lambda r, i: F.when(F.size(F.filter(r, lambda c: strip(c) != "")) > 2, i)), lambda i: i.isNotNull())
        kept = F.when(F.size(full) > 0, F.slice(body, F.array_min(full) + 1, F.size(body))).otherwise(F.array().cast("array<array<string>>"))

        def fitted(r: Column) -> Column:
            rest = strip(F.array_join(F.slice(r, n, F.greatest(F.size(r) - n + 1, F.lit(0))), " "))
            return F.when(F.size(r) > n, F.concat(F.slice(r, F.lit(1), n - 1), F.array(rest))).otherwise(F.concat(r, F.array_repeat(F.lit(""), n - F.size(r))))

        return F.when(n < 3, rows).otherwise(F.concat(F.array(names), F.transform(kept, fitted)))

    return F.when((F.size(rows) < 2) | ~hinted, rows).otherwise(once(header, merged))


def rows_to_markdown(rows: Column) -> Column:
    """Rows that hold anything as a Markdown table; fewer than two give ""."""

    def line(r: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))

    def table(full: Column) -> Column:
        rule = line(F.transform(full[0], lambda c: F.lit("---")))
        return F.array_join(F.concat(F.array(line(full[0]), rule), F.transform(F.slice(full, F.lit(2), F.size(full)), line)), "\n")

    some = F.filter(F.transform(rows, lambda r: F.transform(r, normalize_cell)), filled)
    return once(some, lambda s: F.when(F.size(s) < 2, "").otherwise(once(padded(s), table)))


def accept_table(markdown: Column, score: Column, least: float = 28.0, most_columns: int = 8) -> Column:
    """Whether a table is taken: a score of 28, and eight columns at most unless it is a payroll."""
    return (score >= least) & ((table_columns(markdown) <= most_columns) | looks_like_payroll(markdown))


# positions of lines; a page's are as few as it has rulings


def typical_gap(bounds: Column) -> Column:
    """The upper median of the gaps between sorted positions."""
    gaps = F.array_sort(F.zip_with(F.slice(bounds, F.lit(2), F.size(bounds)), F.slice(bounds, F.lit(1), F.size(bounds) - 1), lambda b, a: b - a))
    return F.get(gaps, F.floor(F.size(gaps) / 2).cast("int"))


def spaced(bounds: Column, apart: Column) -> Column:
    """Sorted positions without those that come closer than `apart` after the last one kept."""
    start = F.slice(bounds, 1, 1)
    return F.aggregate(bounds, start, lambda kept, b: F.when(b - F.element_at(kept, -1) >= apart, F.concat(kept, F.array(b))).otherwise(kept))


def narrowest(bounds: Column) -> Column:
    """Struct (at, width) of the narrowest column, the first of equal ones."""
    widths = F.zip_with(F.slice(bounds, F.lit(2), F.size(bounds)), F.slice(bounds, F.lit(1), F.size(bounds) - 1), lambda b, a: b - a)
    return F.struct((F.array_position(widths, F.array_min(widths)) - 1).cast("int").alias("at"), F.array_min(widths).alias("width"))


def without(bounds: Column, at: Column) -> Column:
    return F.concat(F.slice(bounds, F.lit(1), at), F.slice(bounds, at + 2, F.greatest(F.size(bounds) - at - 1, F.lit(0))))


def merge_narrow(bounds: Column, width: Column) -> Column:
    """The right edge of the narrowest column goes while that is under 28 and 4.5 % of the page's width."""
    least = F.greatest(F.lit(28), F.floor(width * 0.045).cast("int"))

    def step(b: Column, _: Column) -> Column:
        return once(narrowest(b), lambda n: F.when((F.size(b) >= 3) & (n["width"] < least) & (n["width"] < width), without(b, n["at"] + 1)).otherwise(b))

    return F.when(F.size(bounds) < 3, bounds).otherwise(F.aggregate(bounds, bounds, step))


def cap_columns(bounds: Column, width: Column, most: int = 9) -> Column:
    """An edge of the narrowest column goes while there are more than `most` columns and it is under 40 or 6 % of the width."""
    least = F.greatest(F.lit(40), F.floor(width * 0.06).cast("int"))

    def step(b: Column, _: Column) -> Column:
        def edge(n: Column) -> Column:
            at = n["at"] + 1
            return F.when(at >= F.size(b) - 1, at - 1).otherwise(at)

        return once(narrowest(b), lambda n: F.when((F.size(b) > most + 1) & (n["width"] < least), without(b, edge(n))).otherwise(b))

    return F.aggregate(bounds, bounds, step)


def has_grid(h_bounds: Column, v_bounds: Column) -> Column:
    """Four lines each way at least."""
    return (F.size(h_bounds) >= 4) & (F.size(v_bounds) >= 4)


def column_of(centre: Column, bounds: Column) -> Column:
    """The interval of bounds that holds a centre, else the last one."""
    inside = F.transform(F.slice(bounds, F.lit(1), F.size(bounds) - 1), lambda a, i: (centre >= a) & (centre < F.get(bounds, i + 1)))
    at = F.array_position(inside, F.lit(True))
    return F.when(at > 0, at - 1).otherwise(F.greatest(F.size(bounds) - 2, F.lit(0))).cast("int")


def box_to_xyxy(polygon: Column) -> Column:
    """Struct (x0, y0, x1, y1) around the points of a polygon (array of arrays), zeros without two points of two numbers."""
    xs, ys = F.transform(polygon, lambda p: F.get(p, F.lit(0))), F.transform(polygon, lambda p: F.get(p, F.lit(1)))
    whole = (F.size(polygon) >= 2) & F.forall(polygon, lambda p: F.size(p) >= 2)
    zero = F.lit(0.0)
    parts = {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}
    return F.struct(*[F.when(F.coalesce(whole, F.lit(False)), v.cast("double")).otherwise(zero).alias(k) for k, v in parts.items()])


def is_header(text: Column, least: int = 3) -> Column:
    return header_hits(text) >= least


#: Lines, one after the other, that begin with a pipe.
PIPE_BLOCK = r"(?<![^\n])[ \t\x0b\f\r]*+\|[^\n]*+(?:\n[ \t\x0b\f\r]*+\|[^\n]*+)*+"


def flatten(text: Column) -> Column:
    """A text in which pipe blocks that make no good table are lines of text; one without pipes stays as it is.

    A block stays if it is a payroll of ten columns at most, has five at most and a quality of 0.48, or four and a score
    of 35.
    """

    def piped(t: Column) -> Column:
        return strip(F.regexp_replace(once(F.regexp_replace(t, r"\n\z", ""), lambda x: replace_each(x, PIPE_BLOCK, _flat_block)), r"\n{3,}", "\n\n"))

    return once(whole(text), lambda t: F.when(t.contains("|"), piped(t)).otherwise(t))


def _flat_block(block: Column) -> Column:
    def cells(row: Column) -> Column:
        return F.filter(F.transform(F.split(F.regexp_replace(strip(row), r"^\|+|\|+$", ""), r"\|", -1), strip), lambda c: c != "")

    def good(columns: Column, quality: Column) -> Column:
        return (looks_like_payroll(block) & (columns <= 10)) | ((columns <= 5) & (quality >= 0.48)) | ((columns <= 4) & (score_table_markdown(block, quality) >= 35))

    keep = once(table_columns(block), lambda n: once(table_content_quality(block), lambda q: good(n, q)))
    flat = F.filter(F.transform(F.filter(F.split(block, "\n", -1), lambda r: ~r.contains("---")), lambda r: F.array_join(cells(r), " ")), lambda r: r != "")
    return F.when(keep, F.concat(block, F.lit("\n"))).otherwise(once(flat, lambda ls: F.when(F.size(ls) == 0, "").otherwise(F.concat(F.array_join(ls, "\n"), F.lit("\n")))))
