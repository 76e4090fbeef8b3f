"""Queries over tables made of words and rulings, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import tables as T
from foliant.functions.scores import HEADER_HINTS, HEADER_KEYS
from foliant.operators import tables
from foliant.plans.queries import query, sql_has, table

# Pages of eight orders: an order is a row, its items are words; the first row holds names of columns.
NAMES = ("Fecha", "de", "Nombre", "Concepto", "x", "Pago", "Importe")


def _page_words(spark, sf_dir):
    n, header = F.col("l_linenumber"), F.col("l_orderkey") % 8 == 1
    text = F.when(header, F.element_at(F.array(*map(F.lit, NAMES)), n.cast("int"))).when(n % 3 == 0, F.date_format("l_shipdate", "dd/MM/yyyy")).otherwise(F.concat("l_returnflag", F.lit(" | "), "l_suppkey"))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") / 8).cast("long").alias("page_id"), ((F.col("l_orderkey") + 7) % 8).cast("int").alias("row"), n.alias("pos"), (n * 130 + F.col("l_partkey") % 90).cast("double").alias("left"),
        (n + 10.0).alias("width"), ((F.col("l_orderkey") + 7) % 8 * 20 + F.col("l_suppkey") % 15).cast("double").alias("cy"), text.alias("text"),
    )


WORDS = """
WITH w AS (SELECT l_orderkey // 8 AS page_id, ((l_orderkey + 7) % 8)::INT AS "row", l_linenumber AS pos, (l_linenumber * 130 + l_partkey % 90)::DOUBLE AS "left", l_linenumber + 10.0 AS width,
  ((l_orderkey + 7) % 8 * 20 + l_suppkey % 15)::DOUBLE AS cy,
  CASE WHEN l_orderkey % 8 = 1 THEN ['Fecha', 'de', 'Nombre', 'Concepto', 'x', 'Pago', 'Importe'][l_linenumber] WHEN l_linenumber % 3 = 0 THEN strftime(l_shipdate, '%d/%m/%Y') ELSE l_returnflag || ' | ' || l_suppkey END AS text FROM lineitem)
"""


def _pages(words):
    return words.select("page_id").distinct().withColumn("width", F.lit(1040.0))


def sql_spaced(bounds: str, apart: str) -> str:
    return f"list_reduce(list_transform({bounds}, lambda x: [x]), lambda a, b: CASE WHEN b[1] - a[len(a)] >= {apart} THEN list_concat(a, b) ELSE a END)"


BOUNDS = f"""
, o AS (SELECT *, lead("left") OVER v AS nxt, row_number() OVER v AS i, "left" + width AS r FROM w WINDOW v AS (PARTITION BY page_id, "row" ORDER BY "left", pos, text)),
g AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY nxt - r DESC, "row", i) AS n FROM o WHERE "row" < 8 AND nxt - r >= 14),
m AS (SELECT page_id, list_sort(list_distinct(list(round_even((r + nxt) / 2, 1)))) AS mids FROM g WHERE n <= 12 GROUP BY page_id),
c AS (SELECT page_id, count(*) AS n, least(8, greatest(4, count(*) // 6)) AS k, list("left" + width / 2) AS cs FROM w GROUP BY page_id),
q AS (SELECT page_id, n, list_transform(range(1, k - 1), lambda i: list_aggregate(cs, 'quantile_cont', 0.5)) AS none, k, list_sort(cs) AS cs FROM c),
p AS (SELECT page_id, n, list_transform(range(1, k - 1), lambda i: cs[(i * (n - 1) // (k - 1)) + 1] + (i * (n - 1) / (k - 1) - i * (n - 1) // (k - 1)) * (cs[least(n, i * (n - 1) // (k - 1) + 2)] - cs[i * (n - 1) // (k - 1) + 1])) AS qs FROM q),
b AS (SELECT p.page_id, CASE WHEN mids IS NOT NULL AND len({sql_spaced('list_prepend(0.0, mids)', '28')}) >= 4 THEN list_append({sql_spaced('list_prepend(0.0, mids)', '28')}, 1040.0)
  WHEN n < 8 THEN [0.0, 1040.0] ELSE list_append({sql_spaced('list_prepend(0.0, qs)', '30')}, 1040.0) END AS bounds FROM p LEFT JOIN m USING (page_id))
"""


@query(WORDS + BOUNDS + "SELECT page_id, len(bounds) AS n, round(list_sum(list_transform(bounds, lambda x, i: x * i)), 6) AS weighted FROM b")
def column_bounds(spark, sf_dir):
    words = _page_words(spark, sf_dir)
    weighted = F.aggregate(F.transform("bounds", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return tables.infer_bounds(words, _pages(words)).select("page_id", F.size("bounds").cast("long").alias("n"), F.round(weighted, 6).alias("weighted"))


def sql_rows(words: str, bounds: str) -> str:
    """Tables `cells` and `sheets` (page_id, rows) from words and bounds."""
    return f"""
, placed AS (SELECT page_id, "row", pos, "left", text, len(bounds) - 1 AS n, coalesce(list_position(list_transform(range(1, len(bounds)), lambda i: "left" + width / 2 >= bounds[i] AND "left" + width / 2 < bounds[i + 1]), true), len(bounds) - 1) AS col FROM {words} JOIN {bounds} USING (page_id)),
cells AS (SELECT page_id, "row", col, max(n) AS n, string_agg(text, ' ' ORDER BY "left", pos, text) AS cell FROM placed GROUP BY ALL),
lines AS (SELECT page_id, "row", max(n) AS n, map_from_entries(list(row(col, cell))) AS m FROM cells GROUP BY ALL),
sheets AS (SELECT page_id, list(list_transform(range(1, n + 1), lambda i: coalesce(m[i], '')) ORDER BY "row") AS rows FROM lines GROUP BY page_id)
"""


def sql_trimmed(rows: str) -> str:
    """Rows without blank ends (no row of these is blank) and without columns that are blank all the way down."""
    keep = f"list_filter(range(1, len({rows}[1]) + 1), lambda i: len(list_filter({rows}, lambda r: trim(r[i]) <> '')) > 0)"
    return f"list_transform({rows}, lambda r: list_transform({keep}, lambda i: r[i]))"


def sql_cell(x: str) -> str:
    return f"trim(replace(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '|', '/'))"


def sql_markdown(rows: str) -> str:
    line = "'| ' || array_to_string({}, ' | ') || ' |'"
    some = f"list_filter(list_transform({rows}, lambda r: list_transform(r, lambda c: {sql_cell('c')})), lambda r: len(list_filter(r, lambda c: c <> '')) > 0)"
    return f"(SELECT CASE WHEN len(s) < 2 THEN '' ELSE array_to_string(list_concat([{line.format('s[1]')}, {line.format('list_transform(s[1], lambda c: ' + chr(39) + '---' + chr(39) + ')')}], list_transform(s[2:], lambda r: {line.format('r')})), chr(10)) END FROM (SELECT {some} AS s))"


@query(WORDS + BOUNDS + ", many AS (SELECT w.* FROM w JOIN (SELECT page_id FROM w GROUP BY page_id HAVING max(\"row\") >= 2) USING (page_id))" + sql_rows("many", "b") + f", z AS (SELECT page_id, {sql_trimmed('rows')} AS rows FROM sheets) SELECT page_id, {sql_markdown('rows')} AS markdown FROM z")
def tables_by_gaps(spark, sf_dir):
    words = _page_words(spark, sf_dir)
    return tables.cluster_tables(words, _pages(words))


def sql_hits(x: str) -> str:
    return "(" + " + ".join(f"contains(upper({x}), '{k}')::INT" for k in HEADER_KEYS) + ")"


HEADED = f"""
, ls AS (SELECT page_id, "row", count(*) AS k, string_agg(text, ' ' ORDER BY "left", pos, text) AS t FROM w GROUP BY ALL),
e AS (SELECT page_id, sum(k) AS n, min(CASE WHEN "row" < 10 AND {sql_hits('t')} >= 3 THEN "row" END) AS header FROM ls GROUP BY page_id HAVING n >= 24 AND header IS NOT NULL),
hw AS (SELECT w.*, row_number() OVER (PARTITION BY page_id ORDER BY "left", pos, text) AS i FROM w JOIN e USING (page_id) WHERE "row" = header),
hg AS (SELECT *, sum(CASE WHEN {sql_hits('text')} = 0 AND length(text) <= 3 AND i > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) AS col FROM hw),
hn AS (SELECT page_id, col, min("left") AS l, arg_max("left" + width, i) AS r, string_agg(text, ' ' ORDER BY i) AS name FROM hg GROUP BY page_id, col),
hh AS (SELECT page_id, list(name ORDER BY col) AS names, list((l + r) / 2 ORDER BY col) AS c FROM hn GROUP BY page_id HAVING count(*) >= 3),
b AS (SELECT page_id, names, list_concat([0.0], list_transform(range(1, len(c)), lambda i: (c[i] + c[i + 1]) / 2), [1040.0]) AS bounds FROM hh),
body AS (SELECT w.* FROM w JOIN e USING (page_id) WHERE "row" > header)
"""


@query(WORDS + HEADED + sql_rows("body", "b") + f"""
, kept AS (SELECT page_id, list_filter(rows, lambda r: len(list_filter(r, lambda c: c <> '')) > 0 AND {sql_hits("array_to_string(r, ' ')")} < 3) AS rows FROM sheets),
z AS (SELECT page_id, list_prepend(names, rows) AS rows FROM kept JOIN b USING (page_id) WHERE len(rows) >= 1), y AS (SELECT page_id, {sql_trimmed('rows')} AS rows FROM z)
SELECT page_id, {sql_markdown('rows')} AS markdown FROM y""")
def tables_by_header(spark, sf_dir):
    words = _page_words(spark, sf_dir)
    return tables.header_tables(words, _pages(words))


RULED = """
, grid AS (SELECT DISTINCT page_id, [0, 20, 33, 60, 80, 100, 160] AS hs, [0.0, 260.0, 520.0, 650.0, 1040.0] AS bounds FROM w),
bands AS (SELECT page_id, unnest(range(1, len(hs))) AS i, hs FROM grid), band AS (SELECT page_id, i, hs[i] AS y0, hs[i + 1] AS y1 FROM bands WHERE hs[i + 1] - hs[i] >= 14),
inside AS (SELECT w.page_id, i AS "row", pos, "left", width, text FROM w JOIN band ON w.page_id = band.page_id AND cy >= y0 AND cy < y1)
"""


@query(WORDS + RULED + sql_rows("inside", "grid") + f"""
, t AS (SELECT page_id, {sql_trimmed('rows')} AS rows FROM sheets),
h AS (SELECT *, flatten(rows[1:3]) AS head FROM t),
n AS (SELECT *, list_filter(list_transform(head, lambda c: {sql_cell('c')}), lambda c: c <> '') AS full_cells, {sql_has("array_to_string(head, ' ')", HEADER_HINTS)} AS hinted FROM h),
d AS (SELECT *, list_filter(full_cells, lambda c, i: NOT list_contains(full_cells[:i - 1], c)) AS names, rows[2:] AS body FROM n),
f AS (SELECT *, list_filter(list_transform(body, lambda r, i: CASE WHEN len(list_filter(r, lambda c: trim(c) <> '')) > 2 THEN i END), lambda i: i IS NOT NULL)[1] AS first FROM d),
x AS (SELECT page_id, CASE WHEN len(rows) < 2 OR NOT hinted OR len(names) < 3 THEN rows ELSE list_prepend(names, CASE WHEN first IS NULL THEN [] ELSE list_transform(body[first:], lambda r: CASE WHEN len(r) > len(names) THEN list_append(r[:len(names) - 1], trim(array_to_string(r[len(names):], ' '))) ELSE list_concat(r, list_transform(range(len(names) - len(r)), lambda i: '')) END) END) END AS rows FROM f)
SELECT page_id, {sql_markdown('rows')} AS markdown FROM x""")
def tables_by_rulings(spark, sf_dir):
    words = _page_words(spark, sf_dir)
    grids = _pages(words).select("page_id", F.array(*map(F.lit, (0, 20, 33, 60, 80, 100, 160))).alias("h_bounds"), F.array(*map(F.lit, (0, 260, 520, 650, 1040))).alias("v_bounds"))
    return tables.grid_tables(words.drop("row"), grids)


def _profiles(spark, sf_dir):
    """Pages of 100 x 600 pixels with rulings at distances that vary by page."""
    d, p = F.col("doc_id"), F.col("pos")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    rows = docs.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(99)))).select(d.alias("page_id"), F.lit("row").alias("axis"), "pos", F.when(p % (13 + d % 9) < 2, 0.9).otherwise((p * 7 + d) % 20 / 100).alias("density"), F.lit(None).cast("int").alias("run"))
    columns = docs.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(599)))).select(d.alias("page_id"), F.lit("column").alias("axis"), "pos", F.lit(None).cast("double").alias("density"), F.when((p + p * p * (d % 5) / 300).cast("int") % (31 + d % 23) < 3, 100).otherwise((p % 60).cast("int")).alias("run"))
    return rows.union(columns)


RULINGS = f"""
WITH pr AS (SELECT doc_id AS page_id, 'row' AS axis, pos::INT AS pos, CASE WHEN pos % (13 + doc_id % 9) < 2 THEN 0.9 ELSE (pos * 7 + doc_id) % 20 / 100 END AS d, NULL::INT AS run FROM documents, range(100) t(pos)
  UNION ALL SELECT doc_id, 'column', pos::INT, NULL, CASE WHEN trunc(pos + pos * pos * (doc_id % 5) / 300)::BIGINT % (31 + doc_id % 23) < 3 THEN 100 ELSE pos % 60 END FROM documents, range(600) t(pos)),
q AS (SELECT page_id, quantile_cont(d, 0.92) AS q FROM pr WHERE axis = 'row' GROUP BY page_id),
l AS (SELECT page_id, axis, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY page_id, axis ORDER BY pos) <= 4 THEN 0 ELSE 1 END AS new FROM pr JOIN q USING (page_id) WHERE CASE axis WHEN 'row' THEN d >= greatest(0.22, q) ELSE run >= 72 END),
i AS (SELECT *, sum(new) OVER (PARTITION BY page_id, axis ORDER BY pos) AS island FROM l), c AS (SELECT page_id, axis, island, sum(pos) // count(*) AS centre FROM i GROUP BY ALL),
a AS (SELECT page_id, list(centre::INT ORDER BY centre) FILTER (axis = 'row') AS hs, list(centre::INT ORDER BY centre) FILTER (axis = 'column') AS vs FROM c GROUP BY page_id HAVING len(hs) >= 3 AND len(vs) >= 3),
g AS (SELECT *, list_sort(list_transform(range(1, len(hs)), lambda i: hs[i + 1] - hs[i])) AS hg, list_sort(list_transform(range(1, len(vs)), lambda i: vs[i + 1] - vs[i])) AS vg FROM a),
s AS (SELECT page_id, {sql_spaced('hs', 'greatest(14, floor(hg[len(hg) // 2 + 1] * 0.45))')} AS hs, {sql_spaced('vs', 'greatest(28, floor(vg[len(vg) // 2 + 1] * 0.55))')} AS vs FROM g),
m AS (WITH RECURSIVE r AS (SELECT page_id, hs, vs AS v, 0 AS k FROM s UNION ALL
  SELECT page_id, hs, list_concat(list_slice(v, 1, j), list_slice(v, j + 2, len(v))), k + 1 FROM (SELECT *, list_position(ws, list_min(ws)) AS j FROM (SELECT *, list_transform(range(1, len(v)), lambda i: v[i + 1] - v[i]) AS ws FROM r) WHERE len(v) >= 3 AND list_min(ws) < 28)) SELECT page_id, hs, arg_max(v, k) AS v FROM r GROUP BY page_id, hs),
z AS (WITH RECURSIVE r AS (SELECT page_id, hs, v, 0 AS k FROM m UNION ALL
  SELECT page_id, hs, CASE WHEN j >= len(v) - 1 THEN list_concat(list_slice(v, 1, j - 1), list_slice(v, j + 1, len(v))) ELSE list_concat(list_slice(v, 1, j), list_slice(v, j + 2, len(v))) END, k + 1 FROM (SELECT *, list_position(ws, list_min(ws)) AS j FROM (SELECT *, list_transform(range(1, len(v)), lambda i: v[i + 1] - v[i]) AS ws FROM r) WHERE len(v) > 10 AND list_min(ws) < 40)) SELECT page_id, hs, arg_max(v, k) AS v FROM r GROUP BY page_id, hs)
SELECT d.doc_id AS page_id, coalesce(array_to_string(hs, ','), '') AS h_bounds, coalesce(array_to_string(v, ','), '') AS v_bounds, coalesce(len(hs) >= 4 AND len(v) >= 4, false) AS grid FROM documents d LEFT JOIN z ON z.page_id = d.doc_id
"""


@query(RULINGS)
def page_rulings(spark, sf_dir):
    found = tables.grid_lines(_profiles(spark, sf_dir))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return found.select("page_id", joined("h_bounds"), joined("v_bounds"), T.has_grid(F.col("h_bounds"), F.col("v_bounds")).alias("grid"))
