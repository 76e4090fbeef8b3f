"""Queries over readings by mode, the log of states, files that Spark writes and reads again, and smaller rules, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import chatter
from foliant.functions.predicates import runs_async
from foliant.operators import candidates, documents, jobs
from foliant.plans.queries import QUALITY_SQL, STATES, STATUS, events_of, query, sql_normalize, sql_plain, sql_strip, table
from foliant.sources import readers, state_log, writers
from foliant.sources.folders import session_folder


def _folder(spark, name):
    return f"{session_folder(spark, name)}/{name}"


# the readings of a page, by mode

#: variant, config, whether its text lacks vowels, a multiple of the confidence
OFFERED = (("quick", 0, True, 7), ("quick", 1, False, 1), ("base", 0, False, 3), ("base", 1, True, 11), ("soft", 1, False, 5), ("plain", 0, False, 2), ("binary", 2, False, 6), ("fine", 4, False, 4))
MODE_SQL = "CASE doc_id % 4 WHEN 0 THEN 'fast' WHEN 1 THEN 'quality' ELSE 'balanced' END"


@query(f"""
WITH d AS (SELECT doc_id, text, regexp_replace(text, '[aeiou]', '', 'g') AS thin, {MODE_SQL} AS mode, doc_id % 5 = 0 AS bulk, doc_id % 7 = 0 AS rng FROM documents),
p AS (SELECT *, CASE WHEN mode = 'fast' THEN 'fast' WHEN mode = 'quality' AND NOT bulk THEN 'quality' WHEN bulk THEN 'bulk' WHEN rng THEN 'range' ELSE 'balanced' END AS plan FROM d),
q AS (SELECT doc_id, plan, text, thin, (SELECT {QUALITY_SQL} FROM (SELECT {sql_plain('text')} AS p)) AS st, (SELECT {QUALITY_SQL} FROM (SELECT {sql_plain('thin')} AS p)) AS sh, length({sql_plain('thin')}) AS size FROM p),
o AS (SELECT * FROM (VALUES {', '.join(f"('{v}', {c}, {str(thin).lower()}, {k}, {n})" for n, (v, c, thin, k) in enumerate(OFFERED))}) t(variant, config, bare, k, n)),
c AS (SELECT doc_id, plan, size, variant, config, n, CASE WHEN bare THEN thin ELSE text END AS t, CASE WHEN (CASE WHEN bare THEN thin ELSE text END) = '' THEN 0.0 ELSE (CASE WHEN bare THEN sh ELSE st END) + 1.35 * (doc_id * k % 41)::DOUBLE END AS score FROM q, o WHERE
  CASE plan WHEN 'fast' THEN variant = 'quick' WHEN 'quality' THEN variant NOT IN ('quick', 'plain') WHEN 'balanced' THEN (variant = 'quick' AND config = 0) OR variant IN ('base', 'soft', 'binary')
    WHEN 'range' THEN (variant = 'quick' AND config = 0) OR variant IN ('plain', 'soft') ELSE (variant = 'quick' AND config = 0) OR variant IN ('base', 'soft') END),
k AS (SELECT doc_id, score AS s, t FROM c WHERE variant = 'quick' AND plan NOT IN ('fast', 'quality')),
f AS (SELECT doc_id, arg_max(variant, row(score, -rank)) AS variant, arg_max(config, row(score, -rank)) AS config, max(score) AS score, arg_max(t, row(score, -rank)) AS t
  FROM (SELECT *, CASE WHEN plan = 'range' AND variant = 'plain' THEN -1 WHEN variant = 'binary' THEN 90 ELSE n END AS rank FROM c WHERE variant <> 'quick' OR plan = 'fast') WHERE score > 0 GROUP BY doc_id),
e AS (SELECT q.doc_id, k.s, k.t, f.variant, f.config, f.score, f.t AS ft, coalesce((k.s >= 36 AND size >= CASE WHEN plan = 'range' THEN 24 ELSE 48 END) OR (plan = 'bulk' AND k.t <> ''), false) AS early FROM q LEFT JOIN k USING (doc_id) LEFT JOIN f USING (doc_id)),
z AS (SELECT *, NOT early AND coalesce(score, 0) >= coalesce(s, 0) AS better FROM e)
SELECT doc_id, CASE WHEN better THEN variant WHEN t <> '' THEN 'quick' END AS variant, CASE WHEN better THEN config WHEN t <> '' THEN 0 END::INT AS config, round(coalesce(CASE WHEN better THEN score ELSE s END, 0), 6)::DOUBLE AS score,
  length(coalesce(CASE WHEN better THEN ft ELSE t END, ''))::INT AS chars, early FROM z
""")
def readings_by_mode(spark, sf_dir):
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    pages = docs.select("doc_id", F.when(d % 4 == 0, "fast").when(d % 4 == 1, "quality").otherwise("balanced").alias("mode"), (d % 5 == 0).alias("bulk"), (d % 7 == 0).alias("is_range"))
    thin = F.regexp_replace("text", "[aeiou]", "")
    offered = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(c).alias("config"), (thin if bare else F.col("text")).alias("text"), (d * k % 41).cast("double").alias("confidence")) for v, c, bare, k in OFFERED])
    readings = docs.select("doc_id", F.explode(offered).alias("o")).select("doc_id", "o.*")
    out = candidates.read_by_mode(readings, pages, "doc_id")
    return out.select("doc_id", "variant", "config", F.round("score", 6).alias("score"), F.length("text").alias("chars"), "early")


# states


@query(STATES + "SELECT job_id, status, updated_at FROM s")
def state_snapshots(spark, sf_dir):
    """The events of four quarters as four writes, compacted in between."""
    folder = _folder(spark, "states")
    status = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.col("event_type"))
    e = events_of(spark, sf_dir).select(F.col("user_id").alias("job_id"), status.alias("status"), "event_id", "ts")
    edges = e.agg(F.percentile_approx("ts", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q")).first()["q"]
    for k, (lo, hi) in enumerate(zip([None, *edges], [*edges, None])):
        part = e if lo is None else e.where(F.col("ts") > F.lit(lo))
        part = part if hi is None else part.where(F.col("ts") <= F.lit(hi))
        state_log.write_states(part.drop("event_id"), folder, stamp=F.col("ts"))
        if k in (1, 2):
            state_log.compact(spark, folder)
    return state_log.read_states(spark, folder).select("job_id", "status", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query("""
WITH t AS (SELECT user_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'yesterday' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 5 WHEN 3 THEN 'Z' ELSE '+00:00' END END AS u, strftime(ts - INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS c, ts, event_id FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts - INTERVAL 1 HOUR) WHEN 1 THEN date_trunc('second', ts - INTERVAL 1 HOUR) WHEN 2 THEN NULL ELSE date_trunc('second', ts) END AS at FROM t
""")
def state_times(spark, sf_dir):
    n = F.col("event_id") % 5
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    updated = F.when(n == 1, "").when(n == 2, "yesterday").when(n > 2, F.concat(iso("ts"), F.when(n == 3, "Z").otherwise("+00:00")))
    created = F.concat(iso(F.col("ts") - F.expr("INTERVAL 1 HOUR")), F.lit("Z"))
    return events_of(spark, sf_dir).select("event_id", jobs.state_time(updated, created).cast("timestamp_ntz").alias("at"))


@query("""
WITH e AS (SELECT event_id, event_type, event_id % 6 AS k FROM events)
SELECT CASE k WHEN 0 THEN 'malformed' WHEN 1 THEN 'no job_id' WHEN 2 THEN 'no object' END AS reason, CASE WHEN k > 2 THEN event_type END AS status, count(*) AS lines, sum(CASE WHEN k > 2 THEN event_id % 90 END)::BIGINT AS pages, sum(CASE k WHEN 0 THEN length('{"job_id": "' || event_id || '"') WHEN 1 THEN length('{"status": "' || event_type || '"}') WHEN 2 THEN length('[' || event_id || ']') END)::BIGINT AS rescued
FROM e GROUP BY ALL
""")
def rescued_lines(spark, sf_dir):
    folder = _folder(spark, "lines")
    k, i = F.col("event_id") % 6, F.col("event_id").cast("string")
    state = F.to_json(F.struct(i.alias("job_id"), F.col("event_type").alias("status"), (F.col("event_id") % 90).alias("pages_total")))
    line = F.when(k == 0, F.concat(F.lit('{"job_id": "'), i, F.lit('"'))).when(k == 1, F.concat(F.lit('{"status": "'), "event_type", F.lit('"}'))).when(k == 2, F.concat(F.lit("["), i, F.lit("]"))).otherwise(state)
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(folder)
    read = readers.rescued_states(spark, folder)
    return read.groupBy("reason", "status").agg(F.count("*").alias("lines"), F.sum("pages_total").alias("pages"), F.sum(F.length("raw")).cast("long").alias("rescued"))


# files

LIMIT = 2000


@query(f"""
WITH f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN 'jpg' ELSE 'zip' END AS suffix, ((octet_length(encode(html)) + 2) // 3 * 4 + 1)::BIGINT AS n FROM pages)
SELECT suffix, count(*) AS files, sum(n)::BIGINT AS bytes, count(*) FILTER (n >= 1000) AS background FROM f WHERE suffix <> 'zip' AND n <= {LIMIT} GROUP BY suffix
""")
def ingested_files(spark, sf_dir):
    """Pages as files of four suffixes, of which the known ones are taken up to a size; the larger ones are for later."""
    folder = _folder(spark, "files")
    suffixes = ("pdf", "png", "jpg", "zip")
    suffix = F.get(F.array(*map(F.lit, suffixes)), (F.col("page_id") % 4).cast("int"))
    pages = table(spark, sf_dir, "pages").select(suffix.alias("suffix"), F.regexp_replace(F.base64(F.encode("html", "UTF-8")), r"\s", "").alias("x"))
    writers.write_files(pages, folder, "suffix", "x", suffixes)
    files = readers.documents(spark, f"{folder}/*", max_bytes=LIMIT)
    later = runs_async(F.col("length"), F.lit(1), F.col("suffix") == "pdf", heavy_mb=1000 / (1 << 20))
    return files.groupBy("suffix").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.count_if(later).alias("background"))


RESULT = f"CASE WHEN item_id % 5 = 0 OR {sql_normalize('text')} = '' THEN '# Resultado OCR' ELSE {sql_normalize('text')} END"


@query(f"SELECT item_id AS job_id, CASE WHEN item_id % 3 < 2 THEN {RESULT} || chr(10) END AS markdown FROM (SELECT item_id, text || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || 'fin ' AS text FROM benchmark)")
def written_results(spark, sf_dir):
    """Results of two thirds of the jobs, written as Markdown and plain text; those asked for are read again."""
    folder = _folder(spark, "results")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("job_id"), F.when(F.col("item_id") % 5 == 0, " \n ").otherwise(F.concat("text", F.lit("\r\n\n\n\nfin "))).alias("markdown"))
    writers.write_results(b.where("job_id % 3 < 2"), folder)
    return readers.written_results(spark, folder, b)


JOINED = "'a' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || text"


@query(f"""
WITH d AS (SELECT doc_id, text, {JOINED} AS j, (doc_id % 3 + 1)::INT AS n, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'a' WHEN 2 THEN {JOINED} WHEN 3 THEN repeat('x', length(text) + 40) ELSE {JOINED} || ' más' END AS s FROM documents),
b AS (SELECT *, (length(s) - length(replace(s, chr(10) || chr(10) || '---' || chr(10) || chr(10), ''))) / 7 AS breaks FROM d)
SELECT doc_id, CASE WHEN n > 1 AND (s IS NULL OR length(s) + 32 < length(j) OR breaks < n - 1) THEN j ELSE s END AS markdown FROM b
""")
def full_results(spark, sf_dir):
    d = F.col("doc_id")
    joined = F.concat(F.lit("a\n\n---\n\n"), "text")
    saved = F.when(d % 5 == 1, "a").when(d % 5 == 2, joined).when(d % 5 == 3, F.repeat(F.lit("x"), F.length("text") + 40)).when(d % 5 == 4, F.concat(joined, F.lit(" más")))
    return table(spark, sf_dir, "documents").select("doc_id", writers.full_markdown(saved, joined, (d % 3 + 1).cast("int")).alias("markdown"))


# smaller rules


@query(f"""
WITH d AS (SELECT doc_id, text, {sql_strip('text')} AS t FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN t WHEN 1 THEN {sql_strip("t || chr(10) || lang")} WHEN 2 THEN {sql_strip("text || chr(10) || 'fin'")} ELSE '' END AS answer FROM d JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)
""")
def model_answers(spark, sf_dir):
    """The texts of responses of the three shapes, and of such as have none."""
    d, t = F.col("doc_id"), F.col("text")
    block = lambda kind, x: F.struct(F.lit(kind).alias("type"), x.alias("text"))
    whole = F.to_json(F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("message"))).alias("choices")))
    listed = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(block("text", F.regexp_replace(t, r"^\s+|\s+$", "")), block("image", F.lit("no")), block("text", F.col("lang"))).alias("content")).alias("message"))).alias("choices")))
    plain = F.to_json(F.struct(F.array(block("text", t), block("tool_use", F.lit("no")), block("text", F.lit("fin"))).alias("content")))
    payload = F.when(d % 5 == 0, whole).when(d % 5 == 1, listed).when(d % 5 == 2, plain).when(d % 5 == 3, "{}")
    return table(spark, sf_dir, "documents").select("doc_id", chatter.response_text(payload).alias("answer"))


TALK = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || 'He transcrito todo' || chr(10) || 'This document is long' WHEN 2 THEN text || chr(10) || 'I cannot transcribe more' ELSE 'Aquí está el texto' || chr(10) || text || chr(10) || 'No tengo forma de verificar' END"


@query(f"""
WITH d AS (SELECT doc_id, {TALK} AS x FROM documents), p AS (SELECT doc_id, {sql_plain('x')} AS p FROM d)
SELECT doc_id, round({QUALITY_SQL} - CASE doc_id % 4 WHEN 1 THEN 60 WHEN 2 THEN 200 WHEN 3 THEN 260 ELSE 0 END, 6) AS score FROM p
""")
def reading_scores(spark, sf_dir):
    """Readings with lines of talk, a refusal, or both."""
    d, t = F.col("doc_id"), F.col("text")
    talk = F.when(d % 4 == 1, F.concat(t, F.lit("\nHe transcrito todo\nThis document is long"))).when(d % 4 == 2, F.concat(t, F.lit("\nI cannot transcribe more"))).when(d % 4 == 3, F.concat(F.lit("Aquí está el texto\n"), t, F.lit("\nNo tengo forma de verificar"))).otherwise(t)
    return table(spark, sf_dir, "documents").select("doc_id", F.round(chatter.reading_score(talk), 6).alias("score"))


@query(f"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE replace(text, chr(10), chr(10) || chr(10) || '---' || chr(10) || chr(10)) END AS x FROM documents), s AS (SELECT doc_id, string_split(x, chr(10) || chr(10) || '---' || chr(10) || chr(10)) AS p FROM d)
SELECT doc_id, (generate_subscripts(p, 1) - 1)::INT AS index, {sql_strip('unnest(p)')} AS markdown FROM s WHERE len(p) > 1
""")
def page_splits(spark, sf_dir):
    x = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.replace("text", F.lit("\n"), F.lit("\n\n---\n\n")))
    return documents.split_pages(table(spark, sf_dir, "documents").select("doc_id", x.alias("x")), "doc_id", "x")
