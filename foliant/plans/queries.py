"""Queries over the driver's tables, one or more for each family of operators, with their DuckDB SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import predicates as P
from foliant.functions import scores as S
from foliant.functions import text as T
from foliant.operators import candidates, documents, jobs, layout, ranges
from foliant.sources.folders import session_folder
from foliant.streaming import jobs as streams

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an instant; the files hold local times, read as UTC where the session says so."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# DuckDB forms of the functions, written out on their own


def sub(x: str, *steps: tuple[str, str], flags: str = "g") -> str:
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern}', {to}, '{flags}')"
    return x


def sql_strip(x: str) -> str:
    return sub(x, (r"^\s+|\s+$", "''"))


def sql_count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


NL, BREAK = "chr(10)", "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


def sql_normalize(x: str) -> str:
    return sql_strip(sub(x, (r"\r\n", NL), (r"\r", NL), (r"\f", BREAK), (r"\n{3,}", f"{NL} || {NL}")))


def sql_plain(x: str) -> str:
    return sql_strip(sub(
        sql_normalize(x), (r"(?m)^#{1,6}\s+", "''"), (r"(?m)^\s*[-*]\s+", "''"), (r"(?m)^\s*\d+\.\s+", "''"),
        (r"(?m)^\s*\|?(?:\s*:?-+:?\s*\|)+\s*$", "''"), (r"\|", "' '"), (r"\*\*", "''"), ("__", "''"), (r"\*", "''"), ("_", "''"),
        (r"\[(.*?)\]\((.*?)\)", r"'\1'"), (r"\n\s*---\s*\n", f"{NL} || {NL}"), (r"[ \t]{2,}", "' '"), (r"\n{3,}", f"{NL} || {NL}"),
    ))


#: Markdown made of a document, the same in both engines.
def derived(text="text"):
    return F.concat(F.lit("# "), "source", F.lit("\n\n- "), text, F.lit("\r\n\n\n---\n\n**b** [link](x)\n\n| a | b |\n| --- | --- |\n| 1 | "), F.col("doc_id").cast("string"), F.lit(" |\n\n## Fin\ncola  "))


DERIVED = "'# ' || source || chr(10) || chr(10) || '- ' || text || chr(13) || chr(10) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '**b** [link](x)' || chr(10) || chr(10) || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | ' || doc_id || ' |' || chr(10) || chr(10) || '## Fin' || chr(10) || 'cola  '"
QUALITY_SQL = (
    "CASE WHEN p = '' THEN 0.0 ELSE " + sql_count("p", r"[a-zA-ZáéíóúÁÉÍÓÚñÑüÜ0-9\s,.;:!?()\"''\-/%$#@&]") + " / length(p) * 55 + least(length(p), 3000) / 60 + least("
    + sql_count("p", r"[\p{L}\p{N}_]+") + ", 400) / 10 + least(len(list_filter(string_split(p, chr(10)), lambda x: regexp_matches(x, '\\S'))), 80) / 4 END"
)


@query(f"""
WITH d AS (SELECT lang, {sql_plain('text')} AS p FROM documents), s AS (SELECT lang, length(p) AS n, {QUALITY_SQL} AS score FROM d)
SELECT lang, count(*) AS pages, sum(n)::BIGINT AS chars, round(min(score), 6) AS low, round(max(score), 6) AS high, sum(round(score * 1000)::BIGINT)::BIGINT AS total FROM s GROUP BY lang
""")
def flagship(spark, sf_dir):
    """Pages cleaned of Markdown and scored, by language."""
    d = table(spark, sf_dir, "documents").select("lang", T.strip_markdown_syntax(F.col("text")).alias("p"), S.text_quality_score(F.col("text")).alias("score"))
    return d.groupBy("lang").agg(
        F.count("*").alias("pages"), F.sum(F.length("p")).alias("chars"), F.round(F.min("score"), 6).alias("low"), F.round(F.max("score"), 6).alias("high"),
        F.sum(F.round(F.col("score") * 1000).cast("long")).alias("total"),
    )


@query(f"SELECT doc_id, {sql_plain(DERIVED)} AS plain, {sql_normalize(DERIVED)} AS normalized FROM documents")
def strip_markdown(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.strip_markdown_syntax(derived()).alias("plain"), T.normalize_markdown(derived()).alias("normalized"))


@query(f"WITH d AS (SELECT doc_id, {sql_plain('x')} AS p FROM (SELECT doc_id, {DERIVED} AS x FROM documents)) SELECT doc_id, round({QUALITY_SQL}, 9) AS score FROM d")
def quality_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(S.text_quality_score(derived()), 9).alias("score"))


def _ratio(tokens: str, good: str) -> str:
    return f"CASE WHEN len({tokens}) = 0 THEN 0.0 ELSE round(len(list_filter({tokens}, lambda t: {good})) / len({tokens}), 9) END"


@query(rf"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[a-záéíóúñA-ZÁÉÍÓÚÑ]{{3,}}') AS a, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS w FROM documents)
SELECT doc_id, {_ratio('a', "regexp_matches(t, '[aeiouáéíóúAEIOUÁÉÍÓÚ]')")} AS tokens, {_ratio('w', "regexp_matches(t, '[aeiouáéíóúüAEIOUÁÉÍÓÚÜ]') OR length(t) >= 5")} AS words,
       {_ratio('w', "regexp_matches(t, '[áéíóúÁÉÍÓÚñÑ]') OR length(t) >= 4")} AS accents,
       CASE WHEN length(text) = 0 THEN 0.0 ELSE round({sql_count('text', '[A-Za-z0-9+/=]')} / length(text), 9) END AS base64
FROM d
""")
def spanish_ratios(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.round(S.token_vowel_ratio(t), 9).alias("tokens"), F.round(S.word_vowel_ratio(t), 9).alias("words"),
        F.round(S.word_accent_ratio(t), 9).alias("accents"), F.round(S.base64_char_ratio(t), 9).alias("base64"),
    )


COMPRESSED = "(SELECT CASE WHEN b = '' THEN '' ELSE b || chr(10) END FROM (SELECT " + sql_strip(sub(
    "array_to_string(list_transform(string_split(x, chr(10)), lambda y: regexp_replace(regexp_replace(y, '\\s+$', ''), '[ \\t]+', ' ', 'g')), chr(10))", (r"\n{3,}", f"{NL} || {NL}"))) + " AS b))"


@query(f"""
WITH d AS (SELECT doc_id, {DERIVED} AS x FROM documents), c AS (SELECT doc_id, x, {COMPRESSED} AS z FROM d)
SELECT doc_id, z AS compressed, length(x) AS chars, length(z) AS chars_compressed, round_even((1 - length(z) / length(x)) * 100, 1) AS saved_pct,
       {sql_strip(sub("replace(x, chr(160), ' ')", (r"[ \t]+", "' '"), (r"\n{3,}", f"{NL} || {NL}")))} AS spaced FROM c
""")
def compress_stats(spark, sf_dir):
    x = derived()
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.compress_markdown(x).alias("compressed"), F.length(x).cast("long").alias("chars"), F.length(T.compress_markdown(x)).cast("long").alias("chars_compressed"),
        S.saved_pct(x).alias("saved_pct"), T.normalize_whitespace(x).alias("spaced"),
    )


@query(rf"""
WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda y: {sql_strip('y')}) AS ls FROM documents),
c AS (SELECT doc_id, list_transform(ls, lambda s: CASE WHEN s = '' THEN '' WHEN {sql_count('s', r"[a-zA-ZáéíóúÁÉÍÓÚñÑüÜ0-9\s,.;:!?()\"''\-/]")} / length(s) < 0.55 AND length(s) < 40 THEN NULL
       ELSE nullif({sql_strip(sub('s', (r'[^\x20-\x7EáéíóúÁÉÍÓÚñÑüÜ«»°\n]', "''")))}, '') END) AS cs FROM l)
SELECT doc_id, {sub("array_to_string(list_filter(cs, lambda y: y IS NOT NULL), chr(10))", (r'^\n+', "''"), (r'\n{3,}', f"{NL} || {NL}"))} AS cleaned FROM c
""")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


EDGE = r"[^\p{L}\p{N}_]"
UPPER_LINES = r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS raw FROM documents),
s AS (SELECT doc_id, line, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS s FROM l),
f AS (SELECT *, regexp_replace(s, '[^A-Za-zÁÉÍÓÚáéíóúÑñ]', '', 'g') AS letters, len(list_filter(regexp_split_to_array(s, '\s+'), lambda t: t <> '')) AS n FROM s),
g AS (SELECT *, letters <> '' AND NOT regexp_matches(letters, '[a-záéíóúñ]') AS caps FROM f)
"""


@query(UPPER_LINES + rf"""
SELECT doc_id, line,
  s <> '' AND NOT regexp_matches(s, '(?i){P.LEGAL_LINE}') AND ((regexp_matches(s, '{P.STAMP_DATETIME}') AND length(s) < 40) OR (regexp_matches(s, '{P.DOTTED_SERIAL}') AND length(s) < 100)
    OR regexp_matches(s, '{P.HEX_CHAIN}') OR (caps AND n BETWEEN 2 AND 5 AND length(s) < 56 AND NOT regexp_matches(s, '[a-záéíóúñ]')
    AND NOT (contains(s, ' DE ') OR contains(s, ' DEL ') OR contains(s, ' LA ') OR contains(s, ' EL ') OR contains(s, ' Y ')))) AS stamp,
  s <> '' AND length(s) <= 100 AND NOT regexp_matches(s, '[a-záéíóúñ]') AND NOT regexp_matches(s, '(?i)(?:^|{EDGE})(?:{P.SENTENCE})(?:$|{EDGE})') AND (
    (s LIKE '%:' AND length(s) <= 72 AND caps) OR regexp_matches(s, '(?i){P.ORDINAL}') OR regexp_matches(s, '(?i){P.CLAUSE}')
    OR (caps AND length(letters) >= 4 AND length(s) <= 48 AND n <= 6 AND NOT (n BETWEEN 2 AND 5 AND regexp_matches(s, '^[A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ\s.]{{3,}}$')))) AS heading,
  s LIKE '|%|' AND length(s) - length(replace(s, '|', '')) >= 3 AS table_line
FROM g
""")
def line_kinds(spark, sf_dir):
    lines = documents.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text")
    raw = F.col("raw")
    return lines.select("doc_id", "line", P.is_stamp_line(raw).alias("stamp"), P.is_heading_line(raw).alias("heading"), P.is_table_line(raw).alias("table_line"))


PHRASES = ("Checklist de ingreso", "Clave de elector y CURP", "Acta de nacimiento", "Total a pagar del recibo de luz", "Curriculum y experiencia laboral",
           "Contrato de arrendamiento entre las partes", "FECHA NOMBRE CONCEPTO IMPORTE", "DOMICILIO y VIGENCIA", "agreement party hereby", "sin marcas")


def sql_has(x: str, words: str) -> str:
    return rf"regexp_matches({x}, '(?i)(?:^|{EDGE})(?:{words})(?:$|{EDGE})')"


def sql_parts(x: str, parts) -> str:
    return "(" + " + ".join(f"contains({x}, '{p}')::INT" for p in parts) + ")"


def sql_hits(x: str, words: str) -> str:
    return rf"len(regexp_extract_all(regexp_replace({x}, '({EDGE})', '\1\1', 'g'), '(?i)(?:^|{EDGE})(?:{words})(?:$|{EDGE})'))"


KIND_SQL = f"""CASE WHEN regexp_matches(t, '(?i){P.CHECKLIST}') OR {sql_parts('lo', P.CHECKLIST_PARTS)} >= 2 THEN 'checklist' WHEN {sql_has('t', P.CREDENTIAL)} THEN 'credential'
 WHEN regexp_matches(t, '{P.MRZ}') AND {sql_has('t', P.ID_LAYOUT)} THEN 'credential' WHEN {sql_has('t', P.FORM)} THEN 'form' WHEN {sql_has('t', P.RECEIPT)} THEN 'receipt' WHEN {sql_has('t', P.CV)} THEN 'cv'
 WHEN length(st) >= 40 AND ({sql_hits('t', P.CONTRACT)} >= 2 OR ({sql_parts('lo', P.CONTRACT_STRONG)} >= 1 AND {sql_hits('t', P.CONTRACT)} >= 1)) THEN 'contract'
 WHEN NOT {sql_has('t', P.SPREADSHEET_VETO)} AND contains(up, 'FECHA') AND contains(up, 'NOMBRE') AND contains(up, 'CONCEPTO') AND (contains(up, 'IMPORTE') OR contains(up, 'PAGO')) THEN 'spreadsheet'
 WHEN regexp_matches(t, '{P.MRZ}') THEN 'credential' WHEN nw < 40 AND ({sql_parts('up', P.ID_TOKENS)} >= 2 OR ({sql_has('t', P.ID_LAYOUT)} AND {sql_parts('up', P.ID_TOKENS)} >= 1)) THEN 'credential'
 WHEN nw < 40 AND {sql_has('t', P.RECEIPT)} THEN 'receipt' WHEN nw < 40 AND {sql_has('t', P.FORM)} THEN 'form' ELSE 'generic' END"""


@query(rf"""
WITH d AS (SELECT doc_id, text || chr(10) || CASE doc_id % 10 {' '.join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES))} END AS t FROM documents),
e AS (SELECT *, lower(t) AS lo, upper(replace(t, 'ß', 'ss')) AS up, {sql_strip('t')} AS st, len(list_filter(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 3)) AS nw,
      len(list_filter(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 4)) AS n4, length({sql_strip(sub('t', (r'\s+', "' '")))}) AS flat FROM d),
k AS (SELECT *, {KIND_SQL} AS kind FROM e)
SELECT doc_id, kind, kind <> 'spreadsheet' AS legal, kind NOT IN ('spreadsheet', 'generic') OR (kind = 'generic' AND (flat < 100 OR (n4 < 10 AND flat > 50))) AS docs FROM k
""")
def page_kinds(spark, sf_dir):
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % 10 + 1).cast("int"))
    t = F.col("t")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n"), phrase).alias("t")).withColumn("kind", P.page_kind(t))
    return d.select("doc_id", "kind", P.needs_legal_vision(F.col("kind")).alias("legal"), P.needs_docs_vision(F.col("kind"), t).alias("docs"))


@query(rf"""
WITH d AS (SELECT doc_id, (doc_id % 10) / 10 AS cov, (doc_id % 5)::INT AS blocks, CASE doc_id % 4 WHEN 0 THEN regexp_replace(text, '[a-z]', '', 'g') WHEN 1 THEN regexp_replace(text, '[^A-Z]', '', 'g') ELSE text END AS raw, text FROM documents),
e AS (SELECT *, length({sql_strip(sub("replace(raw, chr(160), ' ')", (r"[ \t]+", "' '"), (r"\n{3,}", f"{NL} || {NL}")))}) AS n, length({sql_plain('text')}) AS p,
      regexp_extract_all({sql_strip(sub("replace(raw, chr(160), ' ')", (r"[ \t]+", "' '"), (r"\n{3,}", f"{NL} || {NL}")))}, '[a-záéíóúñA-ZÁÉÍÓÚÑ]{{3,}}') AS a FROM d),
f AS (SELECT *, cov >= 0.52 OR (cov >= 0.38 AND blocks <= 3 AND n < 250) OR (cov >= 0.22 AND n < 36) AS scan, CASE WHEN len(a) = 0 THEN 0 ELSE len(list_filter(a, lambda t: regexp_matches(t, '[aeiouáéíóúAEIOUÁÉÍÓÚ]'))) / len(a) END AS r FROM e),
g AS (SELECT *, NOT scan AND p >= 72 AND n >= 48 AND ((blocks >= 3 AND r >= 0.28) OR (p >= 280 AND r >= 0.22)) AS ok FROM f)
SELECT doc_id, scan, CASE WHEN ok AND cov >= 0.28 THEN 'both' WHEN ok THEN 'digital' ELSE 'ocr' END AS route, least(100, greatest(36, greatest(blocks, 1) * 18)) AS least_chars FROM g
""")
def page_routes(spark, sf_dir):
    d = F.col("doc_id")
    raw = F.when(d % 4 == 0, F.regexp_replace("text", "[a-z]", "")).when(d % 4 == 1, F.regexp_replace("text", "[^A-Z]", "")).otherwise(F.col("text"))
    cov, blocks = d % 10 / 10, (d % 5).cast("int")
    return table(spark, sf_dir, "documents").select(
        "doc_id", P.is_scan_dominant(cov, blocks, raw).alias("scan"), P.page_route(cov, blocks, raw, F.col("text")).alias("route"), S.minimum_pdf_text_chars(blocks).alias("least_chars")
    )


PARTS = rf"WITH c AS (SELECT conv_id, list({sql_strip('text')} ORDER BY turn) AS ps FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN ' ' ELSE text END AS text FROM conversations) GROUP BY conv_id)"


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 3 == 1, " ").otherwise(F.col("text")))


@query(PARTS + f" SELECT conv_id, array_to_string(list_filter(ps, lambda p: p <> ''), {BREAK}) AS markdown FROM c")
def join_pages(spark, sf_dir):
    return documents.join_pages(_turns(spark, sf_dir), "conv_id", "turn", "text")


@query(PARTS + """
, b AS (SELECT conv_id, ps, list_filter(list_transform(ps, lambda p, i: CASE WHEN p <> '' THEN '--- Página ' || i || '/' || len(ps) || ' ---' || chr(10) || p END), lambda x: x IS NOT NULL) AS bs FROM c)
SELECT conv_id, CASE WHEN len(ps) = 1 THEN ps[1] ELSE array_to_string(bs, chr(10) || chr(10)) END AS text FROM b""")
def page_banners(spark, sf_dir):
    return documents.banner_pages(_turns(spark, sf_dir), "conv_id", "turn", "text")


@query(PARTS + f" SELECT conv_id, nullif(array_to_string(list_filter(ps, lambda p: p <> ''), {BREAK}), '') || chr(10) AS markdown FROM c")
def merge_chunks(spark, sf_dir):
    return documents.merge_chunks(_turns(spark, sf_dir), "conv_id", "turn", "text")


def _sectioned():
    doc = F.col("doc_id")
    parts = [F.lit("# "), F.col("source"), F.lit("\n\n"), F.col("text"), F.when(doc % 3 == 0, "\n---\n\n  \n---\ncola").when(doc % 3 == 1, "\n## Dos\nmas\n## Tres\nfin").otherwise("")]
    return F.concat(*parts)


SECTIONED = "'# ' || source || chr(10) || chr(10) || text || CASE doc_id % 3 WHEN 0 THEN chr(10) || '---' || chr(10) || chr(10) || '  ' || chr(10) || '---' || chr(10) || 'cola' WHEN 1 THEN chr(10) || '## Dos' || chr(10) || 'mas' || chr(10) || '## Tres' || chr(10) || 'fin' ELSE '' END"
SECTIONS = rf"""
WITH d AS (SELECT doc_id, {sql_strip(f"replace({SECTIONED}, chr(13) || chr(10), chr(10))")} AS b FROM documents),
p AS (SELECT doc_id, b, string_split(regexp_replace(b, '\n\s*---\s*\n', chr(1), 'g'), chr(1)) AS x, list_filter(string_split(regexp_replace(b, '\n(##\s)', chr(1) || '\1', 'g'), chr(1)), lambda y: {sql_strip('y')} <> '') AS h FROM d),
q AS (SELECT doc_id, CASE WHEN len(x) > 1 THEN x WHEN len(h) > 1 THEN h ELSE [b] END AS s FROM p),
r AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS i, unnest(s) AS c FROM q),
z AS (SELECT doc_id, i::VARCHAR AS id, i, {sql_strip('c')} AS content FROM r WHERE {sql_strip('c')} <> ''),
t AS (SELECT *, list_filter(list_transform(string_split(content, chr(10)), lambda y: {sql_strip('y')}), lambda y: y LIKE '#%' OR (y LIKE '---%' AND contains(y, 'Página')))[1] AS f FROM z)
"""


@query(SECTIONS + rf"""
SELECT doc_id, id, CASE WHEN f LIKE '#%' THEN coalesce(nullif({sql_strip(r"regexp_replace(f, '^#+\s*', '')")}[1:80], ''), 'Sección ' || (i + 1)) WHEN f IS NOT NULL THEN {sql_strip("replace(f, '---', '')")}[1:80]
  ELSE {sub('content', (r'\s+', "' '"))}[1:60] || CASE WHEN length(content) > 60 THEN '…' ELSE '' END END AS title, content, length(content)::INT AS chars FROM t
""")
def split_sections(spark, sf_dir):
    return documents.split_sections(table(spark, sf_dir, "documents").select("doc_id", _sectioned().alias("x")), "doc_id", "x")


@query(SECTIONS + f"SELECT doc_id, array_to_string(list(content ORDER BY i), {BREAK}) || chr(10) AS markdown FROM t WHERE id IN ('0', '2') GROUP BY doc_id")
def keep_sections(spark, sf_dir):
    return documents.keep_sections(table(spark, sf_dir, "documents").select("doc_id", _sectioned().alias("x")), "doc_id", "x", F.array(F.lit("0"), F.lit("2")))


@query("""
WITH t AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
SELECT source, s::INT AS page_from, least(n, s + 19)::INT AS page_to FROM (SELECT source, n, unnest(range(1, n + 1, 20)) AS s FROM t)
""")
def page_ranges(spark, sf_dir):
    totals = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").cast("int").alias("n"))
    return ranges.suggest_ranges(totals, "source", "n", 20)


@query("""
WITH p AS (SELECT doc_id, (doc_id % 9)::INT - 1 AS a, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE (doc_id % 7)::INT END AS b, (doc_id % 6)::INT AS n FROM documents),
c AS (SELECT doc_id, greatest(1, a) AS f, least(greatest(1, n), greatest(greatest(1, a), coalesce(b, greatest(1, n)))) AS t FROM p)
SELECT doc_id, CASE WHEN f <= t THEN f END AS page_from, CASE WHEN f <= t THEN t END AS page_to FROM c
""")
def clamp_ranges(spark, sf_dir):
    k = F.col("doc_id")
    r = ranges.normalize_range((k % 9).cast("int") - 1, F.when(k % 4 == 0, None).otherwise((k % 7).cast("int")), (k % 6).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", r.alias("r")).select("doc_id", "r.page_from", "r.page_to")


SPECS = ("1,3,5-10", "2,2,1", "9-4", "13", "", "4 - 6, 1", "x", "0", "12")


@query("""
WITH d AS (SELECT doc_id, (doc_id % 12 + 1)::INT AS n, (doc_id % 9)::INT AS k FROM documents),
g AS (SELECT *, CASE k WHEN 0 THEN [1, 3, 5, 6, 7, 8, 9, 10] WHEN 1 THEN [1, 2] WHEN 3 THEN [13] WHEN 5 THEN [1, 4, 5, 6] WHEN 7 THEN [0] WHEN 8 THEN [12] END AS p FROM d),
h AS (SELECT doc_id, n, CASE WHEN list_min(p) >= 1 AND list_max(p) <= n THEN p END AS p FROM g)
SELECT doc_id, array_to_string(p, ',') AS pages, nullif(array_to_string(CASE WHEN p IS NOT NULL THEN list_filter(range(1, n + 1), lambda i: NOT list_contains(p, i)) END, ','), '') AS others FROM h
""")
def page_specs(spark, sf_dir):
    n = (F.col("doc_id") % 12 + 1).cast("int")
    spec = F.element_at(F.array(*map(F.lit, SPECS)), (F.col("doc_id") % 9 + 1).cast("int"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return table(spark, sf_dir, "documents").select("doc_id", joined(ranges.parse_pages(spec, n)).alias("pages"), joined(ranges.pages_to_keep(n, F.lit(""), spec)).alias("others"))


READINGS = r"""
WITH v AS (SELECT doc_id, unnest([{'o': 0, 'p': 'alpha', 't': text}, {'o': 1, 'p': 'beta', 't': upper(replace(text, 'ß', 'ss'))}, {'o': 2, 'p': 'gamma', 't': regexp_replace(text, '[aeiou]+', '', 'g')}]) AS u FROM documents),
w AS (SELECT doc_id, u.o AS ordinal, u.p AS provider, u.t AS text FROM v)
"""


def _readings(spark, sf_dir):
    one = lambda o, p, t: F.struct(F.lit(o).alias("ordinal"), F.lit(p).alias("provider"), t.alias("text"))
    t = F.col("text")
    u = F.explode(F.array(one(0, "alpha", t), one(1, "beta", F.upper(F.replace(t, F.lit("ß"), F.lit("ss")))), one(2, "gamma", F.regexp_replace(t, "[aeiou]+", ""))))
    return table(spark, sf_dir, "documents").select("doc_id", u.alias("u")).select("doc_id", "u.*")


@query(READINGS + f", p AS (SELECT *, {sql_plain('text')} AS p FROM w), s AS (SELECT doc_id, ordinal, {QUALITY_SQL} AS score FROM p) SELECT doc_id, arg_max(ordinal, row(score, -ordinal)) AS ordinal, round(max(score), 9) AS score FROM s GROUP BY doc_id")
def best_candidate(spark, sf_dir):
    scored = _readings(spark, sf_dir).withColumn("score", S.text_quality_score(F.col("text")))
    return candidates.best_candidate(scored, "doc_id", "score", "ordinal", "provider").select("doc_id", "ordinal", F.round("score", 9).alias("score"))


DEFAULT_SCORE = rf"CASE WHEN q = '' THEN 0.0 ELSE least(length(q), 3000) / 60 + least({sql_count('q', r'[\p{L}\p{N}_]+')}, 400) / 10 + (CASE WHEN len(qw) = 0 THEN 0.0 ELSE len(list_filter(qw, lambda t: regexp_matches(t, '[áéíóúÁÉÍÓÚñÑ]') OR length(t) >= 4)) / len(qw) END) * 20 END"


@query(READINGS + rf"""
, a AS (SELECT *, length({sql_strip('text')}) AS n, {sql_strip(sub('text', (r'[#*|_>`\[\]()]', "' '"), (r'\s+', "' '")))} AS q, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS tw FROM w),
b AS (SELECT *, regexp_extract_all(q, '[\p{{L}}\p{{N}}_]+') AS qw FROM a WHERE n >= 8),
s AS (SELECT *, {DEFAULT_SCORE} AS score, CASE WHEN len(tw) = 0 THEN 0.0 ELSE len(list_filter(tw, lambda t: regexp_matches(t, '[áéíóúÁÉÍÓÚñÑ]') OR length(t) >= 4)) / len(tw) END AS r FROM b),
m AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best FROM s)
SELECT doc_id, length(arg_max(text, row(score, n, r, provider)))::INT AS chars, 'parallel:' || array_to_string(list_sort(list_distinct(list(provider) FILTER (abs(score - best) < 0.5))), '+') AS label FROM m GROUP BY doc_id
""")
def provider_vote(spark, sf_dir):
    return candidates.vote(_readings(spark, sf_dir), "doc_id", "text", "provider").select("doc_id", F.length("text").alias("chars"), "label")


@query(rf"""
WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT source, line, lower(line) AS k, length(line) AS score FROM l),
b AS (SELECT source, k, arg_max(line, row(score, line)) AS line, max(score) AS score FROM s GROUP BY source, k)
SELECT source, rank::INT AS rank, line, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, k) AS rank FROM b) WHERE rank <= 24
""")
def annotation_topk(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n", -1)).alias("line"))
    return candidates.top_lines(lines.withColumn("score", F.length("line").cast("long")), "source", "line", "score")


@query(rf"""
WITH k AS (SELECT DISTINCT lower({sql_strip('x')}) AS key FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents) WHERE length({sql_strip('x')}) >= 2), m AS (SELECT lower(text) AS t FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT key, key AS g FROM k UNION SELECT key, key[i:i + 11] FROM (SELECT key, unnest(range(1, length(key) - 10, 4)) AS i FROM k WHERE length(key) BETWEEN 12 AND 80))
SELECT key FROM k WHERE key NOT IN (SELECT key FROM g JOIN m ON contains(t, g))
""")
def lines_not_in_main(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return documents.lines_not_in(lines, table(spark, sf_dir, "benchmark"), "line", "item_id", "text")


WORDS = "WITH w AS (SELECT l_orderkey AS page_id, l_linenumber // 3 AS line, l_linenumber AS pos, (l_partkey % 1000)::DOUBLE AS \"left\", (l_suppkey % 40)::DOUBLE AS top, 30.0 AS width, 8.0 + l_linenumber AS height, l_quantity * 2 - 1 AS conf, 'w' || l_suppkey AS text FROM lineitem)"


def _words(spark, sf_dir):
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), F.lit(0).alias("block"), F.lit(0).alias("par"), (n / 3).cast("int").alias("line"), n.alias("pos"), (F.col("l_partkey") % 1000).cast("double").alias("left"),
        (F.col("l_suppkey") % 40).cast("double").alias("top"), F.lit(30.0).alias("width"), (n + 8.0).alias("height"), (F.col("l_quantity") * 2 - 1).alias("conf"), F.concat(F.lit("w"), "l_suppkey").alias("text"),
    )


@query(WORDS + """
, l AS (SELECT page_id, line, string_agg(text, ' ' ORDER BY "left", pos, text) AS text FROM w WHERE NOT (conf >= 0 AND conf < 28) GROUP BY page_id, line)
SELECT page_id, string_agg(text, chr(10) ORDER BY line) AS text FROM l GROUP BY page_id
""")
def layout_lines(spark, sf_dir):
    return layout.page_texts(layout.layout_lines(_words(spark, sf_dir)))


@query(WORDS + """
, b AS (SELECT *, "left" + width / 2 AS cx FROM w WHERE conf >= 15),
c AS (SELECT page_id, CASE WHEN cx >= 0 AND cx < 250 THEN 0 WHEN cx >= 250 AND cx < 500 THEN 1 WHEN cx >= 500 AND cx < 800 THEN 2 ELSE 2 END AS col, "left" + width AS r FROM b)
SELECT page_id, col, count(*) AS words, sum(r) AS right_sum FROM c GROUP BY page_id, col
""")
def assign_columns(spark, sf_dir):
    words = layout.assign_columns(layout.table_words(_words(spark, sf_dir)), [0, 250, 500, 800])
    return words.groupBy("page_id", "col").agg(F.count("*").alias("words"), F.sum("right").alias("right_sum"))


@query("""
WITH p AS (SELECT l_orderkey AS page_id, (l_partkey % 1000)::INT AS x FROM lineitem), g AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY page_id ORDER BY x) <= 90 THEN 0 ELSE 1 END AS n FROM p),
i AS (SELECT *, sum(n) OVER (PARTITION BY page_id ORDER BY x) - 1 AS cluster FROM g)
SELECT page_id, cluster::INT AS cluster, floor(sum(x) / count(*))::BIGINT AS centre, count(*) AS size FROM i GROUP BY page_id, cluster
""")
def cluster_positions(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), (F.col("l_partkey") % 1000).cast("int").alias("x"))
    return layout.cluster_positions(points, ["page_id"], "x", 90)


@query("""
WITH e AS (SELECT user_id, event_id, event_type IN ('click', 'view') AS f FROM events), n AS (SELECT *, row_number() OVER w - sum(f::INT) OVER w AS island FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT user_id, island, count(*) FILTER (f) AS c FROM n GROUP BY user_id, island)
SELECT user_id, CASE WHEN max(c) >= 2 THEN max(c) ELSE 0 END AS run FROM r GROUP BY user_id
""")
def longest_run(spark, sf_dir):
    return layout.longest_run(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", F.col("event_type").isin("click", "view"), 2)


@query(WORDS + """
, o AS (SELECT *, top + height / 2 AS cy, row_number() OVER (PARTITION BY page_id ORDER BY top + height / 2, "left", pos) AS k, greatest(10.0, avg(height) OVER (PARTITION BY page_id) * 0.55) AS tol FROM w WHERE conf >= 15)
, f AS (
  WITH RECURSIVE r AS (
    SELECT page_id, k, cy, tol, 0 AS row, cy AS s, 1 AS n, pos FROM o WHERE k = 1
    UNION ALL
    SELECT o.page_id, o.k, o.cy, o.tol, CASE WHEN abs(o.cy - r.s / r.n) <= o.tol THEN r.row ELSE r.row + 1 END, CASE WHEN abs(o.cy - r.s / r.n) <= o.tol THEN r.s + o.cy ELSE o.cy END,
           CASE WHEN abs(o.cy - r.s / r.n) <= o.tol THEN r.n + 1 ELSE 1 END, o.pos
    FROM r JOIN o ON o.page_id = r.page_id AND o.k = r.k + 1
  ) SELECT * FROM r)
SELECT page_id, row, pos FROM f
""")
def cluster_rows(spark, sf_dir):
    return layout.cluster_rows(layout.table_words(_words(spark, sf_dir))).select("page_id", "row", "pos")


CELLS = "WITH c AS (SELECT l_orderkey AS t, l_linenumber AS r, unnest([{'c': 0, 'v': l_returnflag}, {'c': 1, 'v': strftime(l_shipdate, '%d/%m/%Y')}, {'c': 2, 'v': '$ ' || l_partkey}, {'c': 3, 'v': CASE WHEN l_linenumber = 1 THEN 'FECHA total' ELSE ' x|y  ' || l_suppkey END}]) AS u FROM lineitem)"


def _tables(spark, sf_dir):
    one = lambda c, v: F.struct(F.lit(c).alias("c"), v.alias("v"))
    n = F.col("l_linenumber")
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("t"), n.alias("r"), F.explode(F.array(
        one(0, F.col("l_returnflag")), one(1, F.date_format("l_shipdate", "dd/MM/yyyy")), one(2, F.concat(F.lit("$ "), "l_partkey")),
        one(3, F.when(n == 1, "FECHA total").otherwise(F.concat(F.lit(" x|y  "), "l_suppkey"))))).alias("u")).select("t", "r", "u.c", "u.v")
    return layout.cells_to_markdown(cells, "t", "r", "c", "v")


TABLES = CELLS + rf"""
, n AS (SELECT t, r, u.c AS c, max(replace({sql_strip(sub('u.v', (r'\s+', "' '")))}, '|', '/')) AS v FROM c GROUP BY t, r, u.c),
l AS (SELECT t, r, '| ' || string_agg(v, ' | ' ORDER BY c) || ' |' AS line FROM n GROUP BY t, r),
m AS (SELECT t, list(line ORDER BY r) AS ls FROM l GROUP BY t),
md AS (SELECT t, CASE WHEN len(ls) < 2 THEN '' ELSE array_to_string(list_concat([ls[1], '| --- | --- | --- | --- |'], ls[2:]), chr(10)) END AS markdown FROM m)
"""


@query(TABLES + "SELECT t, markdown FROM md")
def table_markdown(spark, sf_dir):
    return _tables(spark, sf_dir)


@query(TABLES + rf"""
, q AS (SELECT t, markdown, {sql_has('markdown', S.HEADER_HINTS)} AS hint, list_filter(string_split(markdown, chr(10)), lambda x: x LIKE '|%') AS ls FROM md),
x AS (SELECT *, flatten(list_transform(list_filter(ls, lambda y: NOT contains(y, '---')), lambda y: list_transform(string_split(regexp_replace(y, '^\|+|\|+$', '', 'g'), '|'), lambda z: {sql_strip('z')}))) AS cells FROM q),
y AS (SELECT *, list_filter(cells, lambda z: z <> '') AS fullc FROM x),
g AS (SELECT *, len(list_filter(fullc, lambda z: length(z) >= 2 AND NOT ((length(z) <= 2 AND NOT regexp_matches(z, '^[0-9]+$')) OR {sql_count('z', r'[\p{L}\p{N}$.,/-]')} / length(z) < 0.45 OR regexp_matches(z, '^(?:[^\p{{L}}\p{{N}}_]|_){{1,4}}$')))) AS good FROM y),
s AS (SELECT *, CASE WHEN len(ls) < 3 OR len(fullc) = 0 THEN 0.0 ELSE least(1.0, good / len(fullc) + (0.15 + 0.15 + CASE WHEN hint THEN 0.1 ELSE 0 END)) END AS quality FROM g)
SELECT t, round(quality, 9) AS quality, CASE WHEN len(ls) < 3 OR quality < 0.28 THEN 0.0 ELSE round(least(len(ls), 80) * 0.8 * quality + CASE WHEN hint THEN 24 * quality ELSE 0 END + 18 + 22 + 12, 9) END AS score, len(ls)::INT AS lines FROM s
""")
def table_scores(spark, sf_dir):
    md, quality = F.col("markdown"), F.col("quality")
    scored = _tables(spark, sf_dir).withColumn("quality", S.table_content_quality(md))
    return scored.select("t", F.round(quality, 9).alias("quality"), F.round(S.score_table_markdown(md, quality), 9).alias("score"), F.size(S.table_lines(md)).alias("lines"))


STATUS = {"signup": "queued", "view": "processing", "purchase": "completed", "error": "failed", "click": "paused"}
STATES = "WITH j AS (SELECT *, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'paused' END AS status FROM events), s AS (SELECT user_id AS job_id, arg_max(status, row(ts, event_id)) AS status, max(ts) AS updated_at FROM j GROUP BY user_id)"


def _states(spark, sf_dir):
    status = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.col("event_type"))
    e = events_of(spark, sf_dir).select(F.col("user_id").alias("job_id"), status.alias("status"), F.col("ts").alias("updated_at"), "event_id")
    return jobs.latest_states(e, "job_id", "updated_at", "event_id").select("job_id", "status", "updated_at")


@query(STATES + """
, p AS (SELECT c_custkey % 40 AS batch_id, c_custkey AS job_id, (c_custkey // 40)::INT * 10 + 1 AS a, (c_custkey // 40)::INT * 10 + 10 AS b FROM customer), x AS (SELECT p.*, coalesce(s.status, 'queued') AS status FROM p LEFT JOIN s USING (job_id)),
g AS (SELECT batch_id, count(*) FILTER (status = 'completed') AS c, count(*) AS n, min(CASE WHEN status = 'completed' AND a = 1 AND b >= 10 THEN job_id END) AS f FROM x GROUP BY batch_id)
SELECT batch_id, c AS parts_completed, n AS parts_total, c > 0 AND c = n AS merge_ready, f IS NOT NULL AS full_document_ready, f AS full_document_job_id FROM g
""")
def batch_sync(spark, sf_dir):
    batches, parts = _batches(spark, sf_dir)
    return jobs.sync_batches(batches, parts, _states(spark, sf_dir))


def _batches(spark, sf_dir):
    k = F.col("c_custkey")
    first = (k / 40).cast("int") * 10
    parts = table(spark, sf_dir, "customer").select((k % 40).alias("batch_id"), k.alias("job_id"), (first + 1).alias("page_from"), (first + 10).alias("page_to"), F.lit("queued").alias("status"))
    return parts.select("batch_id").distinct().withColumns({"total_pages": F.lit(10), "source_filename": F.concat(F.lit("libro"), "batch_id", F.lit(".pdf"))}), parts


@query(STATES + """
, p AS (SELECT c_custkey % 40 AS batch_id, c_custkey AS job_id, (c_custkey // 40)::INT * 10 + 1 AS a, (c_custkey // 40)::INT * 10 + 10 AS b FROM customer JOIN s ON s.job_id = c_custkey WHERE status = 'completed'),
m AS (SELECT batch_id, string_agg(chr(10) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Parte: páginas ' || a || '–' || b || chr(10) || chr(10) || chr(10) || trim(text), chr(10) ORDER BY a, b, job_id) AS body FROM p JOIN documents ON doc_id = job_id GROUP BY batch_id)
SELECT batch_id, rtrim('# libro' || batch_id || chr(10) || chr(10) || chr(10) || '> Documento completo por partes — 10 páginas en el PDF original.' || chr(10) || chr(10) || body) || chr(10) AS markdown FROM m
""")
def batch_merge(spark, sf_dir):
    batches, parts = _batches(spark, sf_dir)
    done = parts.drop("status").join(_states(spark, sf_dir).select("job_id", "status"), "job_id")
    return jobs.merge_batches(batches, done, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.col("text").alias("markdown")))


@query(STATES + """
, h AS (SELECT job_id, updated_at AS completed_at FROM s WHERE status = 'completed' AND job_id % 2 = 0), a AS (SELECT * FROM h UNION ALL SELECT job_id, updated_at FROM s WHERE status IN ('completed', 'failed', 'cancelled') AND job_id NOT IN (SELECT job_id FROM h))
SELECT job_id, completed_at FROM a ORDER BY completed_at DESC, job_id LIMIT 30
""")
def job_history(spark, sf_dir):
    """The newest 30 jobs: a top-k report."""
    states = _states(spark, sf_dir)
    saved = states.where("status = 'completed' AND job_id % 2 = 0").select("job_id", F.col("updated_at").alias("completed_at"))
    return jobs.history(saved, states).withColumn("completed_at", F.col("completed_at").cast("timestamp_ntz"))


@query(STATES + """
, q AS (SELECT job_id, row_number() OVER (ORDER BY updated_at, job_id) + (SELECT count(*) > 0 FROM s WHERE status = 'processing')::INT AS position FROM s WHERE status IN ('queued', 'paused'))
SELECT s.job_id, status, CASE WHEN status = 'processing' THEN 0 ELSE coalesce(position, 99) END AS position, status = 'processing' AS is_active FROM s LEFT JOIN q USING (job_id) WHERE status IN ('queued', 'processing', 'paused')
""")
def active_jobs(spark, sf_dir):
    states = _states(spark, sf_dir)
    return jobs.active_jobs(states, jobs.queue_positions(states, "job_id", "updated_at"))


@query(STATES + """
, n AS (SELECT max(ts) AS now FROM events), x AS (SELECT job_id, status, epoch_us(now - updated_at) / 60000000 AS idle, job_id % 5 = 0 AS mem, job_id % 7 <> 0 AS up FROM s, n)
SELECT job_id, CASE WHEN status IN ('queued', 'processing', 'paused') AND NOT up THEN 'cancelled' WHEN status = 'processing' AND NOT mem AND idle > 8 THEN 'failed' WHEN status IN ('queued', 'paused') AND NOT mem AND idle > 180 THEN 'cancelled'
  WHEN status IN ('queued', 'paused') AND NOT mem THEN 'requeued' ELSE status END AS outcome,
  CASE WHEN status IN ('queued', 'processing') THEN 'paused' END AS if_paused, CASE WHEN status IN ('queued', 'processing', 'paused') THEN 'cancelled' END AS if_cancelled FROM x
""")
def reconcile_jobs(spark, sf_dir):
    now = events_of(spark, sf_dir).agg(F.max("ts").alias("now"))
    s = _states(spark, sf_dir).crossJoin(F.broadcast(now))  # one row
    idle = (F.unix_micros("now") - F.unix_micros("updated_at")) / 60_000_000
    status = F.col("status")
    return s.select("job_id", jobs.reconcile(status, idle, F.col("job_id") % 5 == 0, F.col("job_id") % 7 != 0).alias("outcome"), jobs.transition(F.lit("pause"), status).alias("if_paused"), jobs.transition(F.lit("cancel"), status).alias("if_cancelled"))


@query("""
WITH c AS (SELECT event_id, event_type AS provider, ts FROM events WHERE event_type <> 'error'), e AS (SELECT CASE user_id % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'signup' ELSE 'purchase' END AS provider, ts FROM events WHERE event_type = 'error')
SELECT event_id, EXISTS (SELECT 1 FROM e WHERE e.provider = c.provider AND e.ts <= c.ts AND e.ts + INTERVAL 300 SECOND > c.ts) AS disabled FROM c
""")
def open_circuits(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    calls = e.where("event_type <> 'error'").select(F.col("event_type").alias("provider"), "ts", "event_id")
    names = F.element_at(F.array(*map(F.lit, ("click", "view", "signup", "purchase"))), (F.col("user_id") % 4 + 1).cast("int"))
    return jobs.open_circuits(e.where("event_type = 'error'").select(names.alias("provider"), "ts"), calls, "provider", "ts").select("event_id", "disabled")


THROTTLE = """
WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, t AS last, true AS go FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.event_id, o.k, CASE WHEN o.t - r.last >= 86400000000 THEN o.t ELSE r.last END, o.t - r.last >= 86400000000 FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT user_id, event_id FROM r WHERE go
"""


@query(THROTTLE)
def throttled_progress(spark, sf_dir):
    return jobs.throttled(events_of(spark, sf_dir), "user_id", "ts", "event_id", 86_400)


def _stream(spark, sf_dir, build, mode):
    """What a stream over the events table gives when it has read all there is."""
    events = table(spark, sf_dir, "events")
    name = session_folder(spark, "stream")
    source = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet" if os.path.isdir(f"{sf_dir}/events.parquet") else f"{sf_dir}/events.parquet*")
    out = build(source.withColumn("ts", F.col("ts").cast("timestamp")))
    sink = out.writeStream.outputMode(mode).option("checkpointLocation", f"{name}/state").trigger(availableNow=True)
    if mode == "append":
        sink.format("parquet").start(f"{name}/out").awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{name}/out")
    sink.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{name}/out")).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{name}/out")


@query(THROTTLE)
def stream_throttled_progress(spark, sf_dir):
    return _stream(spark, sf_dir, lambda e: streams.throttle(e, "user_id", "ts", "event_id", 86_400), "append")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_status_counts(spark, sf_dir):
    return _stream(spark, sf_dir, lambda e: streams.status_counts(e, "ts", "event_type"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(rf"""
WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'parallel:beta+alpha-tables' WHEN 1 THEN 'gemini-x' WHEN 2 THEN 'tesseract' ELSE 'vision' END AS src, CASE doc_id % 6 WHEN 0 THEN ' RAPIDO ' WHEN 1 THEN 'best' WHEN 2 THEN NULL ELSE 'x' END AS mode,
  'a/b/' || source || ':<' || doc_id || '>.v1.pdf' AS f, CASE doc_id % 5 WHEN 0 THEN 429 WHEN 1 THEN 403 ELSE 500 END AS code, CASE WHEN doc_id % 3 = 0 THEN 'Quota left' ELSE 'down' END AS body FROM documents)
SELECT doc_id, src LIKE 'parallel:%' OR split_part(src, '-', 1) IN ('gemini', 'vision') AS vision, CASE WHEN src LIKE 'parallel:%' THEN 'beta,alpha' WHEN src LIKE 'gemini%' THEN 'gemini' ELSE '' END AS providers,
  CASE WHEN mode = ' RAPIDO ' THEN 'fast' WHEN mode = 'best' THEN 'quality' ELSE 'balanced' END AS mode, regexp_replace(f[5:length(f) - 4], '[<>:"/\\|?*]', '_', 'g') AS stem, code = 429 OR contains(lower(body), 'quota') AS quota FROM d
""")
def labels_and_names(spark, sf_dir):
    k = F.col("doc_id")
    src = F.when(k % 4 == 0, "parallel:beta+alpha-tables").when(k % 4 == 1, "gemini-x").when(k % 4 == 2, "tesseract").otherwise("vision")
    mode = F.when(k % 6 == 0, " RAPIDO ").when(k % 6 == 1, "best").when(k % 6 == 2, None).otherwise("x")
    name = F.concat(F.lit("a/b/"), "source", F.lit(":<"), k.cast("string"), F.lit(">.v1.pdf"))
    code, body = F.when(k % 5 == 0, 429).when(k % 5 == 1, 403).otherwise(500), F.when(k % 3 == 0, "Quota left").otherwise("down")
    return table(spark, sf_dir, "documents").select(
        "doc_id", P.is_vision_source(src).alias("vision"), F.array_join(P.source_providers(src), ",").alias("providers"), P.normalize_mode(mode).alias("mode"),
        T.safe_stem(name).alias("stem"), P.is_quota_error(code, body).alias("quota"),
    )


@query(f"""
SELECT page_id, {sql_strip(sub(
    "html", (r'(?is)<(?:script|style|head|nav|footer)[^>]*>.*?</(?:script|style|head|nav|footer)>', "' '"), (r'(?is)<!--.*?-->', "' '"), (r'(?i)<br[^>]*>', NL), (r'(?i)</(?:p|h1|h2|h3|li|tr|div|article)>', f"{NL} || {NL}"),
    (r'(?i)<h1[^>]*>', "'# '"), (r'(?i)<h2[^>]*>', "'## '"), (r'(?i)<li[^>]*>', "'- '"), (r'(?s)<[^>]*>', "''"), ('&nbsp;', "' '"), ('&lt;', "'<'"), ('&gt;', "'>'"), ('&quot;', "chr(34)"), ('&#39;', "chr(39)"), ('&amp;', "'&'"),
    (r'[ \t]+', "' '"), (r' ?\n ?', NL), (r'\n{3,}', f"{NL} || {NL}")))} AS markdown FROM pages
""")
def html_to_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_markdown(F.col("html")).alias("markdown"))


@query(rf"""
WITH d AS (SELECT doc_id, {DERIVED} AS x FROM documents), l AS (SELECT doc_id, generate_subscripts(string_split(x, chr(10)), 1) - 1 AS line, {sql_strip("unnest(string_split(x, chr(10)))")} AS s FROM d),
k AS (SELECT *, CASE WHEN s = '' THEN 'blank' WHEN regexp_matches(s, '^###\s') THEN 'heading3' WHEN regexp_matches(s, '^##\s') THEN 'heading2' WHEN regexp_matches(s, '^#\s') THEN 'heading1' WHEN s = '---' THEN 'break'
  WHEN s LIKE '|%' THEN 'table' WHEN regexp_matches(s, '^[-*]\s') THEN 'bullet' WHEN regexp_matches(s, '^\d+\.\s') THEN 'number' ELSE 'paragraph' END AS kind FROM l),
n AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY doc_id ORDER BY line) AND kind IN ('table', 'paragraph') THEN 0 ELSE 1 END AS new FROM k),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line) AS island FROM n), b AS (SELECT doc_id, island, kind, count(*) AS lines, string_agg(s, chr(10) ORDER BY line) AS text FROM i WHERE kind <> 'blank' GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island)::INT AS block, kind, lines, text FROM b
""")
def markdown_blocks(spark, sf_dir):
    return documents.markdown_blocks(table(spark, sf_dir, "documents").select("doc_id", derived().alias("x")), "doc_id", "x")


@query(rf"""
WITH d AS (SELECT doc_id, text || CASE WHEN doc_id % 4 = 0 THEN repeat('Ab3', 16) || '+x' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN ' Evidencia  criptográfica del FIRMANTE' ELSE '' END || CASE WHEN doc_id % 6 = 0 THEN chr(10) || repeat('|', 13) ELSE '' END AS t FROM documents)
SELECT doc_id, len(list_filter(regexp_extract_all(regexp_replace(t, '\s+', '', 'g'), '[A-Za-z0-9+/]{{44,}}={{0,2}}'), lambda x: regexp_matches(x, '[+/=]'))) > 0 AS base64,
  regexp_matches(t[1:1200], '(?i)EVIDENCIA\s+CRIPTOGR') AND regexp_matches(t[1:1200], '(?i)(?:FIRMANTE|CADENA\s+DE\s+FIRMA|AUTORIDAD\s+CERTIFICADORA)') AS evidence,
  len(list_filter(string_split(t, chr(10)), lambda x: length(x) - length(replace(x, '|', '')) > 12)) > 0 AS grid FROM d
""")
def noise_tests(spark, sf_dir):
    k = F.col("doc_id")
    t = F.concat("text", F.when(k % 4 == 0, "Ab3" * 16 + "+x").otherwise(""), F.when(k % 5 == 0, " Evidencia  criptográfica del FIRMANTE").otherwise(""), F.when(k % 6 == 0, "\n" + "|" * 13).otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", P.has_long_base64(t).alias("base64"), P.is_crypto_evidence(t).alias("evidence"), P.has_pipe_grid(t).alias("grid"))
