"""DuckDB forms of the cleaner's tests, written out on their own: text expressions in, text expressions out."""

from __future__ import annotations

from foliant.functions import cleaning as C
from foliant.functions import predicates as P
from foliant.plans.queries import EDGE, sql_count, sql_has, sql_normalize, sql_strip, sub

VOWEL, LETTER = "[aeiouáéíóúAEIOUÁÉÍÓÚ]", "[a-záéíóúñA-ZÁÉÍÓÚÑ]"
DOTTED = rf"(^|{EDGE})(?:\d{{2}}\.){{6,}}\d{{2,}}(?:\.\d{{2,}})*($|{EDGE})"


def bound(value: str, body: str, name: str = "s") -> str:
    """body over one column that holds value; not for use inside lambdas."""
    return f"(SELECT {body} FROM (SELECT _v AS {name} FROM (SELECT {value} AS _v)))"


def tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda t: t <> '')"


def vowel_ratio(x: str) -> str:
    return bound(f"regexp_extract_all({x}, '{LETTER}{{3,}}')", f"CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_filter(a, lambda t: regexp_matches(t, '{VOWEL}'))) / len(a) END", "a")


def alphabet_ratio(x: str) -> str:
    return f"CASE WHEN length({x}) = 0 THEN 0.0 ELSE {sql_count(x, '[A-Za-z0-9+/=]')} / length({x}) END"


def capitals(x: str) -> str:
    letters = f"regexp_replace({x}, '[^A-Za-zÁÉÍÓÚáéíóúÑñ]', '', 'g')"
    return f"({letters} <> '' AND NOT regexp_matches({letters}, '[a-záéíóúñ]'))"


def stamp_line(s: str) -> str:
    """Of a stripped line."""
    connected = " OR ".join(f"contains({s}, ' {w} ')" for w in ("DE", "DEL", "LA", "EL", "Y"))
    caps = f"({capitals(s)} AND len({tokens(s)}) BETWEEN 2 AND 5 AND length({s}) < 56 AND NOT regexp_matches({s}, '[a-záéíóúñ]') AND NOT ({connected}))"
    stamped = f"(regexp_matches({s}, '{P.STAMP_DATETIME}') AND length({s}) < 40) OR (regexp_matches({s}, '{P.DOTTED_SERIAL}') AND length({s}) < 100) OR regexp_matches({s}, '{P.HEX_CHAIN}')"
    return f"({s} <> '' AND NOT regexp_matches({s}, '(?i){P.LEGAL_LINE}') AND ({stamped} OR {caps}))"


def heading_line(s: str) -> str:
    """Of a stripped line."""
    letters = f"regexp_replace({s}, '[^A-Za-zÁÉÍÓÚáéíóúÑñ]', '', 'g')"
    name = f"(len({tokens(s)}) BETWEEN 2 AND 5 AND regexp_matches({s}, '^[A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ\\s.]{{3,}}$'))"
    short = f"({capitals(s)} AND length({letters}) >= 4 AND length({s}) <= 48 AND NOT {name} AND len({tokens(s)}) <= 6)"
    label = f"({s} LIKE '%:' AND length({s}) <= 72 AND {capitals(s)})"
    return f"({s} <> '' AND length({s}) <= 100 AND NOT regexp_matches({s}, '[a-záéíóúñ]') AND NOT {sql_has(s, P.SENTENCE)} AND ({label} OR regexp_matches({s}, '(?i){P.ORDINAL}') OR regexp_matches({s}, '(?i){P.CLAUSE}') OR {short}))"


WORDS = r"[A-ZÁÉÍÓÚÑ]{2,}"
#: Runs of capitals in a text in which a mark stands before and after each character that belongs to no word.
RUN = rf"(?:^|\x01){WORDS}(?:(?:\x01\s\x01)+{WORDS}){{1,4}}(?:$|\x01)"


def watermark_free(source: str, key: str, x: str) -> str:
    """Tables that end with `free` (key, t): texts x of a source without stamps. Edges of runs are marked, as the patterns
    have no look-behind."""
    row = sub("s", (rf"(^|{EDGE})\d{{2}}/\d{{2}}/\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}}($|{EDGE})", r"'\1 \2'"), (DOTTED, r"'\1 \2'"))
    run = "replace(c, chr(1), '')"
    found = f"list_transform(regexp_extract_all(m, '{RUN}'), lambda c: CASE WHEN {stamp_line(run)} THEN '' ELSE c END)"
    between = f"string_split(regexp_replace(m, '{RUN}', chr(2), 'g'), chr(2))"
    return f"""wl AS (SELECT {key}, generate_subscripts(ls, 1) AS i, {sql_strip('unnest(ls)')} AS s FROM (SELECT {key}, string_split(replace({x}, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM {source})),
wm AS (SELECT *, regexp_replace({row}, '({EDGE})', chr(1) || '\\1' || chr(1), 'g') AS m FROM wl),
ws AS (SELECT *, replace(array_to_string(list_transform(list_zip({between}, {found}), lambda p: p[1] || coalesce(p[2], '')), ''), chr(1), '') AS w FROM wm),
wr AS (SELECT *, {sql_strip(sub('w', (r'\s{2,}', chr(39) + ' ' + chr(39))))} AS row FROM ws),
free AS (SELECT {key}, {sql_strip(sub("coalesce(string_agg(CASE WHEN s = '' THEN '' WHEN " + stamp_line('s') + " OR row = '' THEN NULL ELSE row END, chr(10) ORDER BY i), '')", (r"\n{3,}", "chr(10) || chr(10)")))} AS t FROM wr GROUP BY {key})"""


def digital_text(x: str) -> str:
    return sql_normalize(f"array_to_string(list_transform(string_split({x}, chr(10)), lambda y: regexp_replace(y, '\\s+$', '')), chr(10))")


def gibberish(x: str) -> str:
    meaning = rf"""len(list_filter(list_transform(ts, lambda x: regexp_replace(x, '^[.,;:''"]+|[.,;:''"]+$', '', 'g')), lambda x: length(x) >= 4 AND regexp_matches(x, '^[a-záéíóúñA-ZÁÉÍÓÚÑ0-9]+$') AND regexp_matches(x, '{VOWEL}') AND (regexp_matches(x, '[a-záéíóúñ]') OR upper(x) = x)))"""
    body = rf"""length(s) < 4 OR (s NOT LIKE '#%' AND NOT regexp_matches(s, '(?i){C.KNOWN_LINE}') AND ((n >= 4 AND tiny > 0.5 AND ra < 0.38) OR (n >= 6 AND ra < 0.22) OR (regexp_matches(s, '{C.SMALL_TOKENS}') AND ra < 0.35)
      OR (regexp_matches(s, '[A-Za-z]+[0-9]+|[0-9]+[A-Za-z]+') AND ra < 0.35 AND long_words = 0) OR (length(s) >= 12 AND ra < 0.15 AND {sql_count('s', r'\p{L}')} >= 6 AND {sql_count('s', '[0-9]')} >= 1) OR (length(s) <= 45 AND n <= 5 AND words = 0 AND NOT fields)
      OR (length(s) < 60 AND words = 0 AND regexp_matches(s, '[A-Za-z0-9+/=]{{5,}}') AND NOT fields AND NOT regexp_matches(s, '[0-9]{{3,}}')) OR (length(s) <= 30 AND upper(replace(s, 'ß', 'SS')) = s AND ra < 0.25 AND words = 0 AND NOT regexp_matches(s, '[0-9]{{3,}}'))))"""
    inner = rf"""SELECT *, len(ts) AS n, CASE WHEN len(ts) = 0 THEN 0 ELSE len(list_filter(ts, lambda x: length(x) <= 3)) / len(ts) END AS tiny, {vowel_ratio('s')} AS ra, {meaning} AS words, regexp_matches(s, '(?i)RFC|IVA|CP|CURP|BBVA|\$|TOTAL|PAGADO') AS fields,
      len(list_filter(regexp_extract_all(s, '{LETTER}{{5,}}'), lambda x: regexp_matches(x, '{VOWEL}'))) AS long_words FROM (SELECT s, {tokens('s')} AS ts FROM (SELECT _v AS s FROM (SELECT {sql_strip(x)} AS _v)))"""
    return f"(SELECT {body} FROM ({inner}))"


def seal_tokens(x: str) -> str:
    letters, vowels = sql_count("t", r"\p{L}"), sql_count("t", VOWEL)
    sealish = rf"""length(t) >= 6 AND (({letters} >= 4 AND regexp_matches(t, '[0-9]') AND {vowels} / greatest({letters}, 1) < 0.22) OR (upper(replace(t, 'ß', 'SS')) = t AND {vowels} / length(t) < 0.12)
      OR (regexp_matches(t, '^[A-Z0-9+/=|<>)($''".:\-\[\]]{{8,}}$') AND {vowels} < 2))"""
    plain = rf"""list_transform({tokens('s')}, lambda t: regexp_replace(t, '^[''".,;]+|[''".,;]+$', '', 'g'))"""
    arrow = rf"len({tokens('s')}) > 0 AND contains(s, '>') AND length(s) < 55 AND r < 0.55 AND NOT regexp_matches(s, '(?i)RFC|TOTAL|IMPORTE|\$|[0-9]{{3,}}|@')"
    return f"(SELECT (len(list_filter({plain}, lambda t: {sealish})) > 0 AND r < 0.42) OR ({arrow}) FROM (SELECT s, {vowel_ratio('s')} AS r FROM (SELECT _v AS s FROM (SELECT {x} AS _v))))"


def long_base64(x: str) -> str:
    return rf"len(list_filter(regexp_extract_all(regexp_replace({x}, '\s+', '', 'g'), '[A-Za-z0-9+/]{{44,}}={{0,2}}'), lambda x: regexp_matches(x, '[+/=]'))) > 0"


def seal_line(s: str, rest: str) -> str:
    body = f"""s <> '' AND ((phrase AND (length(e) < 28 OR {alphabet_ratio('e')} > 0.45)) OR CASE WHEN length(s) > 350 AND {alphabet_ratio('s')} > 0.38 THEN length(e) < greatest(40.0, length(s) * 0.07) OR {vowel_ratio('e')} < 0.2
      ELSE (regexp_matches(s, '{C.SERIAL}') AND length(s) < 120 AND phrase) OR {long_base64('s')} END)"""
    return f"(SELECT {body} FROM (SELECT s, e, regexp_matches(s, '(?i){C.SEAL_LINE}') AS phrase FROM (SELECT _v AS s, _w AS e FROM (SELECT {sql_strip(s)} AS _v, {rest} AS _w))))"


def garbage_line(s: str, rest: str) -> str:
    known = ", ".join(f"'{w}'" for w in C.FUNCTION_WORDS)
    short = f"len(list_filter(ts, lambda t: length(t) <= 2 AND regexp_replace(lower(t), '^[.,;:]+|[.,;:]+$', '', 'g') NOT IN ({known})))"
    words = f"len(list_filter(ts, lambda t: length(t) >= 3 AND regexp_matches(t, '{LETTER}')))"
    letters, vowels = sql_count("s", r"\p{L}"), sql_count("s", VOWEL)
    body = f"""s = '' OR {seal_line('s', 'e')} OR {seal_tokens('s')} OR {gibberish('s')} OR (regexp_matches(s, '(?i){C.BOILERPLATE}') AND length(s) < 160)
      OR CASE WHEN len(ts) >= 8 THEN {short} / len(ts) > 0.48 OR {words} / len(ts) < 0.28 ELSE false END OR (length(s) >= 20 AND ({letters} < 6 OR CASE WHEN {letters} >= 10 THEN {vowels} / {letters} < 0.12 ELSE false END))
      OR (length(s) >= 80 AND ({sql_count('s', '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}$.,]')} / length(s) < 0.52 OR ({alphabet_ratio('s')} > 0.42 AND {vowel_ratio('s')} < 0.25)))"""
    return f"(SELECT {body} FROM (SELECT s, e, {tokens('s')} AS ts FROM (SELECT _v AS s, _w AS e FROM (SELECT {sql_strip(s)} AS _v, {rest} AS _w))))"


def cleaned_line(hard: bool = True) -> str:
    """Over columns s (a stripped line), c and r (its noise taken off once and twice)."""
    title = bound(sql_strip("regexp_replace(s, '^#+\\s*', '')"), f"t <> '' AND length(t) <= 72 AND NOT regexp_matches(t, '(?i){C.HONEST_HEADINGS}') AND (({capitals('t')} AND len({tokens('t')}) BETWEEN 2 AND 5) OR {seal_tokens('t')} OR {gibberish('t')})", "t").replace("lambda t: t <> ''", "lambda z: z <> ''")
    harsh = rf"""(length(s) > 90 AND length(c) < greatest(22.0, length(s) * 0.14)) OR (length(c) >= 120 AND {vowel_ratio('c')} < 0.18) OR (length(c) <= 14 AND {vowel_ratio('c')} < 0.45 AND NOT regexp_matches(c, '(?i)[$€]|^\d+[.,]\d{{2}}$|RFC|IVA|CP(?:$|{EDGE})'))"""
    return f"""CASE WHEN s = '' THEN '' WHEN s LIKE '|%|' AND length(s) - length(replace(s, '|', '')) >= 3 THEN s WHEN s LIKE '#%' THEN CASE WHEN NOT {title} THEN s END
      WHEN regexp_matches(s, '(?i){C.STAMP_LINES}') OR (length(s) <= 3 AND NOT regexp_matches(s, '^[0-9]+$')) OR c = '' THEN NULL WHEN length(s) > 180 AND length(c) >= 35 AND {vowel_ratio('c')} >= 0.32 AND NOT {seal_tokens('c')} THEN c
      WHEN {garbage_line('c', 'r')} OR {garbage_line('s', 'c')} OR ({str(hard).lower()} AND ({harsh})) THEN NULL ELSE c END"""


def paragraphs(x: str) -> str:
    """Stripped, full lines of each paragraph that has any."""
    return f"list_filter(list_transform(string_split(regexp_replace({x}, '\\n\\s*\\n', chr(1), 'g'), chr(1)), lambda b: list_filter(list_transform(string_split(b, chr(10)), lambda y: {sql_strip('y')}), lambda y: y <> '')), lambda ls: len(ls) > 0)"
