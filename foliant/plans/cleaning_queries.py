"""Queries over the cleaning functions, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import chatter as K
from foliant.functions import cleaning as C
from foliant.functions import predicates as P
from foliant.functions import scores as S
from foliant.functions import text as T
from foliant.operators import documents, layout
from foliant.plans import cleaning_sql as Q
from foliant.plans.queries import NL, query, sql_count, sql_has, sql_normalize, sql_plain, sql_strip, sub, table

LINES = r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS raw FROM documents),
"""
TAIL = "CASE line % 4 WHEN 1 THEN ' Sello digital del SAT: abc' WHEN 2 THEN ' 12345678901234567890 ||| [m1] ' WHEN 3 THEN ' 0a1b2c3d-0a1b-0a1b-0a1b-0a1b2c3d4e5f;' ELSE '' END"
TAX = r"(?:objeto de (?:i|í|l|1)mpuesto:?\s*0?2\s*(?:s[iííl1]\s*objeto de impuesto\s*)+)+"
RUNS = r"[A-Za-z0-9+/=]{48,}|(?:[A-Za-z0-9+/]{5,}\s+){3,}[A-Za-z0-9+/=]{5,}"
TRIM = r"""'^[ |.,;:\-''"]+|[ |.,;:\-''"]+$'"""


def sql_noise(x: str) -> str:
    """The steps of strip_inline_noise, on a column."""
    tails = sub(x, *((f"(?i){p}.*", "''") for p in C.SEAL_TAILS))
    ids = sub(tails, (f"(?i){TAX}", "' '"), (C.UUID, r"'\1 \2'"), (C.SERIAL, r"'\1 \2'"))
    return ids


def sql_blobs(x: str) -> str:
    """Each run in its place: what stands between the runs, and the runs as blanks where they are long enough."""
    found = rf"list_transform(regexp_extract_all({x}, '{RUNS}'), lambda c: CASE WHEN length(regexp_replace(c, '\s+', '', 'g')) >= 36 THEN ' ' ELSE c END)"
    between = f"string_split(regexp_replace({x}, '{RUNS}', chr(1), 'g'), chr(1))"
    return f"array_to_string(list_transform(list_zip({between}, {found}), lambda p: p[1] || coalesce(p[2], '')), '')"


def sql_after(x: str) -> str:
    return sql_strip(f"regexp_replace({sub(x, ('[A-Za-z0-9+/=]{32,}', chr(39) + ' ' + chr(39)), ('(?i)\\[\\s*m\\d?\\s*\\]', chr(39) * 2), ('\\|{2,}', chr(39) + ' ' + chr(39)), ('\\s{2,}', chr(39) + ' ' + chr(39)))}, {TRIM}, '', 'g')")


@query(LINES + f"t AS (SELECT doc_id, line, raw || {TAIL} AS x FROM l), n AS (SELECT doc_id, line, {sql_noise('x')} AS y FROM t), b AS (SELECT doc_id, line, {sql_blobs('y')} AS z FROM n) SELECT doc_id, line, {sql_after('z')} AS cleaned FROM b")
def inline_noise(spark, sf_dir):
    lines = documents.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text")
    k = F.col("line") % 4
    tail = F.when(k == 1, " Sello digital del SAT: abc").when(k == 2, " 12345678901234567890 ||| [m1] ").when(k == 3, " 0a1b2c3d-0a1b-0a1b-0a1b-0a1b2c3d4e5f;").otherwise("")
    return lines.select("doc_id", "line", C.strip_inline_noise(F.concat("raw", tail)).alias("cleaned"))


RATIOS = rf"""
s AS (SELECT doc_id, line, {sql_strip('raw')} AS s FROM l),
t AS (SELECT *, list_filter(regexp_split_to_array(s, '\s+'), lambda t: t <> '') AS ts, regexp_extract_all(s, '[\p{{L}}\p{{N}}_]+') AS w, regexp_extract_all(s, '[a-záéíóúñA-ZÁÉÍÓÚÑ]{{3,}}') AS a FROM s),
r AS (SELECT *, len(ts) AS n, CASE WHEN len(ts) = 0 THEN 0 ELSE len(list_filter(ts, lambda x: length(x) <= 3)) / len(ts) END AS tiny,
  CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda x: regexp_matches(x, '[aeiouáéíóúüAEIOUÁÉÍÓÚÜ]') OR length(x) >= 5)) / len(w) END AS rw,
  CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_filter(a, lambda x: regexp_matches(x, '[aeiouáéíóúAEIOUÁÉÍÓÚ]'))) / len(a) END AS ra, {sql_count('s', r'\p{L}')} AS letters, {sql_count('s', '[0-9]')} AS digits FROM t)
"""


@query(LINES + RATIOS + f"SELECT doc_id, line, length(s) < 4 OR (s NOT LIKE '#%' AND NOT {sql_has('s', C.NOISE_KEEP)} AND ((n >= 5 AND tiny > 0.55 AND rw < 0.35) OR (n >= 6 AND rw < 0.2) OR (regexp_matches(s, '{C.SMALL_TOKENS}') AND rw < 0.32) OR (length(s) >= 14 AND rw < 0.12 AND letters >= 8))) AS noise FROM r")
def stamp_noise_lines(spark, sf_dir):
    lines = documents.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text")
    return lines.select("doc_id", "line", C.looks_like_stamp_noise(F.col("raw")).alias("noise"))


MEANINGFUL = r"""len(list_filter(list_transform(ts, lambda x: regexp_replace(x, '^[.,;:''"]+|[.,;:''"]+$', '', 'g')), lambda x: length(x) >= 4 AND regexp_matches(x, '^[a-záéíóúñA-ZÁÉÍÓÚÑ0-9]+$') AND regexp_matches(x, '[aeiouáéíóúAEIOUÁÉÍÓÚ]') AND (regexp_matches(x, '[a-záéíóúñ]') OR upper(x) = x)))"""


@query(LINES + RATIOS + rf"""
, f AS (SELECT *, {MEANINGFUL} AS words, regexp_matches(s, '(?i)RFC|IVA|CP|CURP|BBVA|\$|TOTAL|PAGADO') AS fields, len(list_filter(regexp_extract_all(s, '[a-záéíóúñA-ZÁÉÍÓÚÑ]{{5,}}'), lambda x: regexp_matches(x, '[aeiouáéíóúAEIOUÁÉÍÓÚ]'))) AS long_words FROM r)
SELECT doc_id, line, length(s) < 4 OR (s NOT LIKE '#%' AND NOT regexp_matches(s, '(?i){C.KNOWN_LINE}') AND ((n >= 4 AND tiny > 0.5 AND ra < 0.38) OR (n >= 6 AND ra < 0.22) OR (regexp_matches(s, '{C.SMALL_TOKENS}') AND ra < 0.35)
  OR (regexp_matches(s, '[A-Za-z]+[0-9]+|[0-9]+[A-Za-z]+') AND ra < 0.35 AND long_words = 0) OR (length(s) >= 12 AND ra < 0.15 AND letters >= 6 AND digits >= 1) OR (length(s) <= 45 AND n <= 5 AND words = 0 AND NOT fields)
  OR (length(s) < 60 AND words = 0 AND regexp_matches(s, '[A-Za-z0-9+/=]{{5,}}') AND NOT fields AND NOT regexp_matches(s, '[0-9]{{3,}}')) OR (length(s) <= 30 AND upper(replace(s, 'ß', 'SS')) = s AND ra < 0.25 AND words = 0 AND NOT regexp_matches(s, '[0-9]{{3,}}')))) AS gibberish FROM f
""")
def gibberish_lines(spark, sf_dir):
    lines = documents.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text")
    return lines.select("doc_id", "line", C.is_stamp_gibberish(F.col("raw")).alias("gibberish"))


def sql_denoised(table: str, column: str, result: str) -> str:
    """Tables that add strip_inline_noise of a column, step by step."""
    return f"""{result}1 AS (SELECT *, {sql_noise(column)} AS _n FROM {table}), {result}2 AS (SELECT * EXCLUDE (_n), {sql_blobs('_n')} AS _b FROM {result}1), {result}3 AS (SELECT * EXCLUDE (_b), {sql_after('_b')} AS {result} FROM {result}2)"""


STEPS = f"{sql_denoised('s', 's', 'c')}, {sql_denoised('c3', 'c', 'r')}"


@query(LINES + f"s AS (SELECT doc_id, line, {sql_strip('raw')} AS s FROM l), {STEPS} SELECT doc_id, line, {Q.cleaned_line()} AS cleaned FROM r3")
def cleaned_lines(spark, sf_dir):
    """The whole line cleaner."""
    lines = documents.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text")
    return C.clean_lines(lines, "raw").select("doc_id", "line", "cleaned")


@query(rf"""
WITH b AS (SELECT doc_id, {sql_blobs(sql_strip("regexp_replace(text, '(?is)" + chr(92) + "n##" + chr(92) + "s+Firmas," + chr(92) + "s+sellos" + chr(92) + "s+y" + chr(92) + "s+anotaciones.*', '')"))} AS t FROM documents),
l AS (SELECT doc_id, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS line, unnest(string_split(t, chr(10))) AS raw FROM b), s AS (SELECT doc_id, line, {sql_strip('raw')} AS s FROM l), {STEPS},
k AS (SELECT doc_id, line, {Q.cleaned_line()} AS cleaned FROM r3), f AS (SELECT *, line - coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY line), -1) - 1 AS skipped FROM k WHERE cleaned IS NOT NULL),
j AS (SELECT doc_id, string_agg(CASE WHEN skipped >= 10 THEN chr(10) || '> Sello o timbre omitido.' || chr(10) || chr(10) ELSE '' END || cleaned, chr(10) ORDER BY line) AS t FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce({sql_normalize('t')}, '') AS markdown FROM documents d LEFT JOIN j USING (doc_id)
""")
def sanitized_documents(spark, sf_dir):
    """Documents cleaned line by line and joined again, with notes where many lines went."""
    return C.sanitize_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


STAMPED = "CASE line % 5 WHEN 1 THEN ' NOTARIA PUBLICA FIRMA REGISTRADA SELLADA DOS MAS' WHEN 2 THEN ' 12/12/20 10:10:10 x' WHEN 3 THEN ' JUAN DE LA CRUZ, 12.34.56.78.90.12.34.56' ELSE '' END"


def _stamped(spark, sf_dir):
    """Texts with stamps at the ends of lines."""
    k = F.col("line") % 5
    tail = F.when(k == 1, " NOTARIA PUBLICA FIRMA REGISTRADA SELLADA DOS MAS").when(k == 2, " 12/12/20 10:10:10 x").when(k == 3, " JUAN DE LA CRUZ, 12.34.56.78.90.12.34.56").otherwise("")
    lines = documents.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "line", F.concat("raw", tail).alias("t"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n")
    return lines.groupBy("doc_id").agg(joined.alias("x"))


STAMPED_TEXTS = LINES + f"x AS (SELECT doc_id, string_agg(raw || {STAMPED}, chr(10) ORDER BY line) AS x FROM l GROUP BY doc_id)"


@query(STAMPED_TEXTS + f", {Q.watermark_free('x', 'doc_id', 'x')} SELECT doc_id, {Q.digital_text('t')} AS text FROM free")
def watermark_free(spark, sf_dir):
    """Texts without stamps."""
    return _stamped(spark, sf_dir).select("doc_id", C.normalize_digital_text(F.col("x")).alias("text"))


@query(rf"""
WITH l AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda y: {sql_strip(sub('y', (r'\s+', "' '")))}) AS ls FROM documents),
b AS (SELECT doc_id, text, array_to_string(list_transform(list_filter(ls, lambda s: s <> ''), lambda s: CASE WHEN (regexp_matches(s, '^[A-Z0-9][A-Z0-9\s\-./]{{2,}}$') AND length(s) <= 48) OR (NOT (length(s) <= 42 AND regexp_matches(s, '[a-záéíóúñ]')) AND regexp_matches(s, '\d{{2,}}') AND length(s) <= 32)
  THEN '- **Sello / código:** ' WHEN length(s) <= 42 AND regexp_matches(s, '[a-záéíóúñ]') THEN '- **Firma / manuscrito:** ' ELSE '- ' END || s), chr(10)) AS body FROM l)
SELECT doc_id, body, CASE WHEN {sql_strip('body')} = '' THEN text ELSE {sql_strip(f"{sql_normalize('text')} || {NL} || {NL} || '## Firmas, sellos y anotaciones' || {NL} || {NL} || {sql_strip('body')}")} END AS appended FROM b
""")
def annotations(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", C.format_annotations(F.split("text", "\n", -1)).alias("body"))
    return d.select("doc_id", "body", C.append_annotations(F.col("text"), F.col("body")).alias("appended"))


EVIDENCE = "CASE doc_id % 3 WHEN 0 THEN 'Evidencia criptográfica' || chr(10) || 'Archivo Firmado: a.pdf' || chr(10) || 'FIRMANTE Nombre:' || chr(10) || '  Ana Ruiz ' || chr(10) || 'Status: Bueno' || chr(10) || text WHEN 1 THEN 'Validez:  Vigente' || chr(10) || text ELSE text END"


@query(rf"""
WITH d AS (SELECT doc_id, {EVIDENCE} AS x FROM documents),
b AS (SELECT doc_id, list_filter([{', '.join(f"CASE WHEN {sql_strip(sub(f'''regexp_extract(x, '(?i){p}', 1)''', (r'[ \t]+', chr(39) + ' ' + chr(39))))} <> '' THEN '- **{label}:** ' || {sql_strip(sub(f'''regexp_extract(x, '(?i){p}', 1)''', (r'[ \t]+', chr(39) + ' ' + chr(39))))} END" for label, p in C.EVIDENCE_FIELDS)}], lambda v: v IS NOT NULL) AS f FROM d)
SELECT doc_id, CASE WHEN len(f) < 2 THEN '### Evidencia criptográfica' || {NL} || {NL} || '> Página de firma electrónica detectada.' ELSE '### Evidencia criptográfica (resumen)' || {NL} || array_to_string(f, {NL}) END
  || {NL} || {NL} || '> Cadena de firma, sellos de tiempo y tablas hex omitidos; solo metadatos legibles.' AS summary FROM b
""")
def evidence_summary(spark, sf_dir):
    k = F.col("doc_id") % 3
    x = F.concat(F.when(k == 0, "Evidencia criptográfica\nArchivo Firmado: a.pdf\nFIRMANTE Nombre:\n  Ana Ruiz \nStatus: Bueno\n").when(k == 1, "Validez:  Vigente\n").otherwise(""), "text")
    return table(spark, sf_dir, "documents").select("doc_id", C.summarize_evidence(x).alias("summary"))


PARAGRAPHED = r"regexp_replace(text, '\n', chr(10) || chr(10), 'g') || chr(10) || chr(10) || '1) uno' || chr(10) || '2. dos' || chr(10) || chr(10) || '• a' || chr(10) || chr(10) || '2) solo' || chr(10) || chr(10) || 'OBJETO:' || chr(10) || chr(10) || 'PRIMERO. Nada'"
NUMBER, BULLET = r"^\d+[.)]\s+", r"^[-•*]\s+"


def sql_block(ls: str) -> str:
    """A paragraph's lines to Markdown."""
    number, bullet = "regexp_replace({}, '^(\\d+)[.)]\\s+', '\\1. ')", "'- ' || regexp_replace({}, '^[-•*]\\s+', '')"
    every = lambda p: f"len(list_filter({ls}, lambda y: regexp_matches(y, '{p}'))) = len({ls})"
    one = f"CASE WHEN {Q.heading_line(f'{ls}[1]')} THEN '## ' || {sql_strip(f"regexp_replace({ls}[1], ':+$', '')")} WHEN regexp_matches({ls}[1], '{NUMBER}') THEN {number.format(f'{ls}[1]')} WHEN regexp_matches({ls}[1], '{BULLET}') THEN {bullet.format(f'{ls}[1]')} ELSE {ls}[1] END"
    many = f"CASE WHEN {every(NUMBER)} THEN array_to_string(list_transform({ls}, lambda y: {number.format('y')}), {NL} || {NL}) WHEN {every(BULLET)} THEN array_to_string(list_transform({ls}, lambda y: {bullet.format('y')}), {NL} || {NL}) ELSE array_to_string({ls}, {NL}) END"
    return f"CASE WHEN len({ls}) = 1 THEN {one} ELSE {many} END"


MARKDOWN = r"(?m)^#{1,6}\s|^\|.+\||^\s*[-*]\s+\S|^\d+\.\s+\S"


@query(f"""
WITH d AS (SELECT doc_id, {sql_strip(f"replace(replace({PARAGRAPHED}, chr(13) || chr(10), chr(10)), chr(13), chr(10))")} AS b FROM documents),
e AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {sub('b', (r'(?m)^' + chr(92) + 's*(#|' + chr(92) + '||[-*]|' + chr(92) + 'd+' + chr(92) + '.)', chr(39) + 'x' + chr(39)))} ELSE b END AS b FROM d),
f AS (SELECT doc_id, {sql_strip('b')} AS b FROM e)
SELECT doc_id, CASE WHEN regexp_matches(b, '{MARKDOWN}') THEN {sql_normalize('b')} ELSE {sql_normalize(f"array_to_string(list_transform({Q.paragraphs('b')}, lambda p: {sql_block('p')}), {NL} || {NL})")} END AS markdown FROM f
""")
def structured_text(spark, sf_dir):
    """Paragraphs to Markdown; every second text keeps lines that are Markdown already."""
    x = T.strip(T.rewrite(F.concat(F.regexp_replace("text", "\n", "\n\n"), F.lit("\n\n1) uno\n2. dos\n\n• a\n\n2) solo\n\nOBJETO:\n\nPRIMERO. Nada")), [("\r\n", "\n"), ("\r", "\n")]))
    x = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(x, r"(?md)^\s*(#|\||[-*]|\d+\.)", "x")).otherwise(x)
    return table(spark, sf_dir, "documents").select("doc_id", C.structure_markdown(x).alias("markdown"))


TALK = "CASE doc_id % 5 WHEN 0 THEN 'Aquí está el texto:' || chr(10) || '---' || chr(10) WHEN 1 THEN 'He analizado la imagen' || chr(13) || chr(10) || chr(10) ELSE '' END"
AFTER = "CASE doc_id % 3 WHEN 0 THEN chr(10) || ' ¿En qué más puedo ayudarte?' || chr(10) || 'x' WHEN 1 THEN chr(10) || 'Transcripción del documento' ELSE '' END"
META_SQL, REFUSAL_SQL = (x.replace("(?iu)", "(?i)").replace("'", "''") for x in (K.META, K.REFUSALS))
NOTHING = "''"


@query(rf"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'No puedo transcribir.' ELSE {TALK} || text || {AFTER} END AS x FROM documents),
b AS (SELECT doc_id, x, {sql_strip(sub("regexp_replace(x, chr(13) || chr(10), chr(10), 'g')", *((rf'(?is)\n\s*{c}.*', NOTHING) for c in K.CLOSINGS)))} AS b FROM d),
l AS (SELECT doc_id, x, b, string_split(b, chr(10)) AS ls, list_transform(string_split(b, chr(10)), lambda y: {sql_strip('y')}) AS ss FROM b),
p AS (SELECT *, list_filter(list_transform(ss, lambda s, i: CASE WHEN s <> '' AND NOT regexp_matches(s, '{META_SQL}') AND NOT regexp_matches(s, '{REFUSAL_SQL}') AND NOT regexp_matches(s, '{K.FENCE}') THEN i END), lambda i: i IS NOT NULL) AS f,
  list_filter(list_transform(ss, lambda s, i: CASE WHEN s <> '' AND NOT regexp_matches(s, '{META_SQL}') THEN i END), lambda i: i IS NOT NULL) AS t,
  len(list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '{META_SQL}'))) AS talk, len(list_filter(ls, lambda s: regexp_matches(s, '{META_SQL}'))) AS talk_b FROM l)
SELECT doc_id, CASE WHEN (regexp_matches(b, '{REFUSAL_SQL}') OR (talk_b > 0 AND talk_b >= greatest(1, len(ls) // 2)) OR len(list_filter({list(K.MARKERS)}, lambda m: contains(lower(b), m))) > 0) AND length({sql_plain('b')}) < 80 THEN '' ELSE coalesce({sql_strip("array_to_string(ls[list_min(f):list_max(t)], chr(10))")}, '') END AS inner_text,
  talk::INT AS talk, regexp_matches(x, '{REFUSAL_SQL}') AS refuses FROM p
""")
def chatter_free(spark, sf_dir):
    k, t = F.col("doc_id"), F.col("x")
    head = F.when(k % 5 == 0, "Aquí está el texto:\n---\n").when(k % 5 == 1, "He analizado la imagen\r\n\n").otherwise("")
    tail = F.when(k % 3 == 0, "\n ¿En qué más puedo ayudarte?\nx").when(k % 3 == 1, "\nTranscripción del documento").otherwise("")
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(k % 7 == 0, "No puedo transcribir.").otherwise(F.concat(head, "text", tail)).alias("x"))
    return d.select("doc_id", K.strip_chatter(t).alias("inner_text"), K.meta_lines(t).alias("talk"), K.refuses(t).alias("refuses"))


PIPED = "text || chr(10) || '| x | ~ | . | , | ; | : | a |' || chr(10) || '|---|' || chr(10) || 'fin' || chr(10) || '| fecha | total |' || chr(10) || '| --- | --- |' || chr(10) || '| 01/02/2020 | $ 5 |'"
PIPES = r"regexp_replace({}, '^\|+|\|+$', '', 'g')"


@query(rf"""
WITH d AS (SELECT doc_id, {PIPED} AS x FROM documents), l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS raw FROM (SELECT doc_id, string_split(regexp_replace(x, '\n\z', ''), chr(10)) AS ls FROM d)),
p AS (SELECT *, {sql_strip('raw')} LIKE '|%' AS p FROM l), o AS (SELECT *, sum(CASE WHEN p AND before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM (SELECT *, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY i), false) AS before FROM p)),
b AS (SELECT doc_id, island, p, list(raw ORDER BY i) AS rows, string_agg(raw, chr(10) ORDER BY i) AS t FROM o GROUP BY ALL),
q AS (SELECT *, list_filter(rows, lambda y: NOT contains(y, '---')) AS body, length(rows[1]) - length(replace(rows[1], '|', '')) - 1 AS cols, {sql_has('t', S.HEADER_HINTS)} AS hint, regexp_matches(t, '{S.DATE_CELL}') AS dates, regexp_matches(t, '{S.MONEY_CELL}') AS money, upper(t) AS up FROM b WHERE p),
c AS (SELECT *, list_transform(body, lambda y: list_transform(string_split({PIPES.format(sql_strip('y'))}, '|'), lambda z: {sql_strip('z')})) AS cells, length(body[1]) - length(replace(body[1], '|', '')) - 1 AS first FROM q),
f AS (SELECT *, len(flatten(cells)) AS n, list_filter(flatten(cells), lambda z: z <> '') AS fullc,
  contains(up, 'FECHA') AND contains(up, 'NOMBRE') AND contains(up, 'CONCEPTO') AND (dates OR money OR contains(up, 'IMPORTE') OR contains(up, 'PAGO')) AND coalesce(first, 0) BETWEEN 3 AND 10 AS payroll FROM c),
g AS (SELECT *, len(list_filter(fullc, lambda z: length(z) >= 2 AND NOT ((length(z) <= 2 AND NOT regexp_matches(z, '^[0-9]+$')) OR {sql_count('z', r'[\p{L}\p{N}$.,/-]')} / length(z) < 0.45 OR regexp_matches(z, '^(?:[^\p{{L}}\p{{N}}_]|_){{1,4}}$')))) AS good FROM f),
h AS (SELECT *, CASE WHEN len(rows) < 3 OR len(fullc) = 0 OR (cols > 8 AND 1 - len(fullc) / greatest(n, 1) > 0.35) THEN 0.0 ELSE least(1.0, good / len(fullc) + 0.15 * dates::INT + 0.15 * money::INT + 0.1 * hint::INT) END AS quality FROM g),
s AS (SELECT *, CASE WHEN len(rows) < 3 OR (cols > 10 AND NOT payroll) OR quality < 0.28 THEN 0.0 ELSE least(CASE WHEN cols > 8 AND NOT payroll THEN 12.0 ELSE 1e9 END, least(len(rows), 80) * 0.8 * quality + 24 * quality * hint::INT + 18 * dates::INT + 22 * money::INT + CASE WHEN cols BETWEEN 4 AND 9 THEN 12 WHEN cols > 10 THEN -18 ELSE 0 END) END AS score,
  list_filter(list_transform(cells, lambda r: array_to_string(list_filter(r, lambda z: z <> ''), ' ')), lambda r: r <> '') AS flat FROM h),
k AS (SELECT doc_id, island, CASE WHEN (payroll AND cols <= 10) OR (cols <= 5 AND quality >= 0.48) OR (cols <= 4 AND score >= 35) THEN t || chr(10) WHEN len(flat) = 0 THEN '' ELSE array_to_string(flat, chr(10)) || chr(10) END AS x FROM s UNION ALL SELECT doc_id, island, t FROM b WHERE NOT p)
SELECT doc_id, {sql_strip(sub("string_agg(x, chr(10) ORDER BY island)", (r'\n{3,}', f"{NL} || {NL}")))} AS markdown FROM k GROUP BY doc_id
""")
def flattened_tables(spark, sf_dir):
    """Pipe blocks that are no good tables, as text."""
    t = F.concat("text", F.lit("\n| x | ~ | . | , | ; | : | a |\n|---|\nfin\n| fecha | total |\n| --- | --- |\n| 01/02/2020 | $ 5 |"))
    return layout.flatten_tables(table(spark, sf_dir, "documents").select("doc_id", t.alias("x")), "doc_id", "x")


@query(STAMPED_TEXTS + rf""", y AS (SELECT doc_id, replace(x, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) || 'OBJETO:' || chr(10) || chr(10) || 'PRIMERO. Nada' || chr(10) || 'dos' AS z FROM x), {Q.watermark_free('y', 'doc_id', 'z')},
p AS (SELECT doc_id, list_transform({Q.paragraphs('t')}, lambda ls: CASE WHEN len(ls) > 1 THEN array_to_string(ls, ' ') WHEN regexp_matches(ls[1], '(?i){P.ORDINAL}') OR regexp_matches(ls[1], '(?i){P.CLAUSE}') OR (regexp_matches(ls[1], '\p{{Lu}}') AND NOT regexp_matches(ls[1], '\p{{Ll}}') AND length(ls[1]) <= 42
  AND length(regexp_replace(ls[1], ':+$', '')) - length(replace(regexp_replace(ls[1], ':+$', ''), ' ', '')) <= 4 AND NOT {sql_has('ls[1]', P.SENTENCE)}) THEN '## ' || {sql_strip("regexp_replace(ls[1], ':+$', '')")} ELSE ls[1] END) AS ps FROM free)
SELECT doc_id, {sql_normalize(f"array_to_string(ps, {NL} || {NL})")} AS markdown FROM p
""")
def polished_paragraphs(spark, sf_dir):
    """Paragraphs on a line each."""
    x = F.concat(F.regexp_replace("x", "\n", "\n\n"), F.lit("\n\nOBJETO:\n\nPRIMERO. Nada\ndos"))
    return _stamped(spark, sf_dir).select("doc_id", C.polish_paragraphs(x).alias("markdown"))
