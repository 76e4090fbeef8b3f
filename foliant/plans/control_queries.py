"""Queries over the control of jobs and the assembly of documents, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import tables as T
from foliant.functions.predicates import runs_async
from foliant.functions.scores import HEADER_KEYS, header_hits
from foliant.functions.text import normalize_wide_cell
from foliant.operators import assembly, candidates, control, jobs, tables
from foliant.plans import cleaning_sql as Q
from foliant.plans.cleaning_queries import STEPS, sql_blobs
from foliant.plans.queries import COMPRESSED, NL, QUALITY_SQL, SECTIONED, SECTIONS, STATES, _sectioned, _states, _stream, events_of, query, sql_normalize, sql_plain, sql_strip, sub, table
from foliant.sources import writers
from foliant.streaming import jobs as streams

SPACE = "' '"
COMMAND = {"signup": "enqueue", "view": "start", "purchase": "complete"}


def _commands(events):
    even = F.col("event_id") % 2 == 0
    fixed = F.element_at(F.create_map(*[F.lit(x) for kv in COMMAND.items() for x in kv]), F.col("event_type"))
    command = F.when(F.col("event_type") == "click", F.when(even, "pause").otherwise("resume")).when(F.col("event_type") == "error", F.when(even, "fail").otherwise("cancel")).otherwise(fixed)
    return events.select("user_id", "event_id", "ts", command.alias("command"))


LIFE = """
WITH RECURSIVE c AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'pause' ELSE 'resume' END
    ELSE CASE WHEN event_id % 2 = 0 THEN 'fail' ELSE 'cancel' END END AS command, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::VARCHAR AS state, NULL::VARCHAR AS step FROM (SELECT DISTINCT user_id FROM c)
  UNION ALL SELECT user_id, k, event_id, coalesce(step, state), step FROM (SELECT c.user_id, c.k, c.event_id, r.state, CASE
    WHEN command = 'enqueue' AND (state IS NULL OR state IN ('completed', 'failed', 'cancelled')) THEN 'queued' WHEN command = 'start' AND state = 'queued' THEN 'processing' WHEN command = 'pause' AND state IN ('queued', 'processing') THEN 'paused'
    WHEN command = 'resume' AND state = 'paused' THEN 'queued' WHEN command = 'complete' AND state = 'processing' THEN 'completed' WHEN command = 'fail' AND state = 'processing' THEN 'failed'
    WHEN command = 'cancel' AND state IN ('queued', 'processing', 'paused') THEN 'cancelled' END AS step FROM r JOIN c ON c.user_id = r.user_id AND c.k = r.k + 1))
SELECT user_id, event_id, step AS state FROM r WHERE step IS NOT NULL
"""


@query(LIFE)
def job_lifecycle(spark, sf_dir):
    return control.lifecycle(_commands(events_of(spark, sf_dir)), "user_id", "ts", "event_id", "command")


@query(LIFE)
def stream_job_lifecycle(spark, sf_dir):
    return _stream(spark, sf_dir, lambda e: streams.lifecycle(_commands(e), "user_id", "ts", "event_id", "command"), "append")


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'signup'")
def stream_enqueued(spark, sf_dir):
    return _stream(spark, sf_dir, lambda e: streams.enqueued(e.where("event_type = 'signup'"), "user_id", "ts", "3650 days"), "append").select("user_id")


KEPT = """
, n AS (SELECT max(ts) AS now FROM events), x AS (SELECT job_id, status, epoch_us(now - updated_at) / 1000000 AS sec, job_id % 5 = 0 AS mem, job_id % 7 <> 0 AS up FROM s, n),
b AS (SELECT count(*) FILTER (status = 'processing') > 0 AS busy FROM s WHERE job_id % 3 = 0 OR status <> 'processing'),
k AS (SELECT job_id, status, CASE WHEN status IN ('queued', 'processing', 'paused') AND NOT up THEN 'cancelled' WHEN status = 'processing' AND NOT mem AND sec > 480 THEN 'failed' WHEN status IN ('queued', 'paused') AND NOT mem AND sec > 10800 THEN 'cancelled'
  WHEN status IN ('queued', 'paused') AND NOT mem THEN 'requeued' ELSE status END AS outcome, sec > 172800 AS expired, status IN ('queued', 'paused') AND mem AND sec > 20 AND NOT (SELECT busy FROM b) AS stuck FROM x)
"""


def _kept(spark, sf_dir):
    s = _states(spark, sf_dir).withColumns({"in_memory": F.col("job_id") % 5 == 0, "has_upload": F.col("job_id") % 7 != 0})
    now = events_of(spark, sf_dir).agg(F.max("ts").alias("now"))
    return control.housekeeping(s.crossJoin(F.broadcast(now)), F.col("now"))  # one row


@query(STATES + KEPT.replace("WHERE job_id % 3 = 0 OR status <> 'processing'", "") + "SELECT job_id, outcome, expired, stuck FROM k")
def queue_housekeeping(spark, sf_dir):
    return _kept(spark, sf_dir).select("job_id", "outcome", "expired", "stuck")


@query(STATES + KEPT.replace("WHERE job_id % 3 = 0 OR status <> 'processing'", "") + "SELECT count(*) FILTER (outcome = 'requeued') AS requeued, count(*) FILTER (outcome <> status AND outcome = 'cancelled') AS cancelled, count(*) FILTER (outcome <> status AND outcome = 'failed') AS stale_running_cleared, count(*) FILTER (stuck) AS unstuck FROM k")
def housekeeping_counts(spark, sf_dir):
    return control.outcome_counts(_kept(spark, sf_dir))


@query(STATES + "SELECT job_id, coalesce(status, '') AS status, CASE WHEN job_id % 4 = 0 THEN '' ELSE 'Página ' || job_id END AS detail, 0 AS progress, CASE WHEN job_id % 3 = 0 THEN 0 ELSE job_id END AS pages_done, 0 AS pages_total, CASE WHEN job_id % 2 = 0 THEN job_id WHEN status IN ('processing', 'paused') THEN 0 ELSE 1 END AS queue_position, CASE WHEN status = 'completed' AND job_id % 3 > 0 THEN 'f' || job_id || '.pdf (' || job_id % 3 || '-9)' ELSE 'f' || job_id || '.pdf' END AS label FROM s")
def job_summaries(spark, sf_dir):
    k, none = F.col("job_id"), F.lit(None).cast("long")
    s = _states(spark, sf_dir).withColumns({
        "detail": F.when(k % 4 != 0, F.concat(F.lit("Página "), k.cast("string"))), "progress": none, "pages_done": F.when(k % 3 != 0, k), "pages_total": none, "queue_position": F.when(k % 2 == 0, k),
    })
    label = control.history_label(F.concat(F.lit("f"), k.cast("string"), F.lit(".pdf")), k.cast("string"), F.col("status"), F.when(k % 3 > 0, k % 3), F.lit(9))
    return control.public_summary(s).join(s.select("job_id", label.alias("label")), "job_id")


@query("""
WITH h AS (SELECT c_custkey AS job_id, c_custkey // 2 AS t, c_custkey AS p FROM customer), e AS (SELECT o_custkey AS job_id, 1000 + o_orderkey AS t, o_orderkey AS p FROM orders WHERE o_orderkey % 500 = 0),
b AS (SELECT *, 0 AS old FROM e UNION ALL SELECT *, 1 FROM h), d AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY old, p) AS n FROM b)
SELECT job_id, t AS completed_at, (row_number() OVER (ORDER BY old, p) - 1)::INT AS position FROM d WHERE n = 1 ORDER BY old, p LIMIT 30
""")
def history_appended(spark, sf_dir):
    """The newest 30 entries of all customers' jobs, after every 500th order came in as an entry: a top-k report."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    saved = table(spark, sf_dir, "customer").select(k.alias("job_id"), (k / 2).cast("long").alias("completed_at"), k.alias("position"))
    entry = table(spark, sf_dir, "orders").where(o % 500 == 0).select(F.col("o_custkey").alias("job_id"), (o + 1000).alias("completed_at"), o.alias("position"))
    return control.append_history(saved, entry)


UPLOADS = "u AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN ' ' ELSE '/sources/' || o_custkey || '.pdf' END AS p, CASE o_orderkey % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'paused' ELSE 'completed' END AS status FROM orders)"


def _uploads(spark, sf_dir):
    k = F.col("o_orderkey")
    path = F.when(k % 5 == 0, None).when(k % 5 == 1, " ").otherwise(F.concat(F.lit("/sources/"), F.col("o_custkey").cast("string"), F.lit(".pdf")))
    return table(spark, sf_dir, "orders").select(k.alias("job_id"), path.alias("upload_path"), F.when(k % 3 == 0, "queued").when(k % 3 == 1, "paused").otherwise("completed").alias("status"))


@query(f"WITH {UPLOADS} SELECT job_id FROM u WHERE p IS NULL OR p = ' ' OR p NOT IN (SELECT '/sources/' || c_custkey || '.pdf' FROM customer WHERE c_custkey % 2 = 0)")
def dangling_uploads(spark, sf_dir):
    files = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("/sources/"), F.col("c_custkey").cast("string"), F.lit(".pdf")).alias("path"))
    return control.missing_uploads(_uploads(spark, sf_dir), files).select("job_id")


@query(f"WITH {UPLOADS} SELECT regexp_extract(p, '(\\d+)[.]pdf', 1) AS source_id, job_id FROM u WHERE status <> 'completed' AND p LIKE '/s%'")
def source_jobs(spark, sf_dir):
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("source_id"))
    return control.jobs_of_sources(_uploads(spark, sf_dir), sources)


@query(STATES + """
, f AS (SELECT c_custkey AS job_id, CASE WHEN c_custkey % 9 = 0 THEN 'batch_' WHEN c_custkey % 9 = 1 THEN 'merge_' ELSE '' END || c_custkey AS name, c_custkey * 700 AS b FROM customer),
h AS (SELECT job_id::VARCHAR AS name, updated_at AS t FROM s WHERE status = 'completed' AND job_id % 6 = 0),
d AS (SELECT f.name, 'job ' || f.name AS label, round_even(b / 1024, 1) AS kb, 0 AS g, t FROM h JOIN f USING (name)),
r AS (SELECT name, name AS label, round_even(b / 1024, 1) AS kb, 1 AS g, TIMESTAMP '2020-01-01' + INTERVAL 1 SECOND * job_id AS t FROM f WHERE job_id % 9 > 1 AND name NOT IN (SELECT job_id::VARCHAR FROM s WHERE status = 'completed') AND name NOT IN (SELECT name FROM d))
SELECT name AS job_id, label, kb AS size_kb FROM (SELECT * FROM d UNION ALL SELECT * FROM r) ORDER BY g, t DESC, name LIMIT 30
""")
def completed_outputs(spark, sf_dir):
    """The first 30 outputs: a top-k report."""
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 9 == 0, "batch_").when(k % 9 == 1, "merge_").otherwise(""), k.cast("string"))
    start = F.timestamp_seconds(F.lit(1_577_836_800) + k)
    files = table(spark, sf_dir, "customer").select(name.alias("job_id"), (k * 700).alias("size_bytes"), start.alias("modified"))
    states, text = _states(spark, sf_dir), F.col("job_id").cast("string")
    done = states.where("status = 'completed' AND job_id % 6 = 0").select(text.alias("job_id"), F.concat(F.lit("job "), text).alias("label"), "status", F.col("updated_at").alias("completed_at"))
    return control.completed_outputs(done, files, states.withColumn("job_id", text))


@query("""
WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['anthropic', 'gemini'] WHEN 2 THEN ['openai'] ELSE ['anthropic', 'openai', 'gemini'] END AS av, CASE doc_id % 3 WHEN 0 THEN [] WHEN 1 THEN ['gemini', 'openai'] ELSE ['anthropic'] END AS ac,
  CASE doc_id % 5 WHEN 0 THEN ' Gemini ' WHEN 1 THEN NULL WHEN 2 THEN '' ELSE 'auto' END AS rq FROM documents),
q AS (SELECT *, list_filter(av, lambda x: list_contains(ac, x)) AS sc FROM p), o AS (SELECT *, CASE WHEN len(ac) > 0 AND len(sc) > 0 THEN sc ELSE av END AS pool FROM q)
SELECT doc_id, array_to_string(CASE WHEN doc_id % 5 = 0 AND list_contains(pool, 'gemini') THEN ['gemini'] ELSE list_concat(list_filter(['openai', 'gemini'], lambda x: list_contains(pool, x)), list_filter(pool, lambda x: x = 'anthropic')) END, ',') AS chain FROM o
""")
def provider_chains(spark, sf_dir):
    d = F.col("doc_id")
    names = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    available = F.when(d % 4 == 0, names()).when(d % 4 == 1, names("anthropic", "gemini")).when(d % 4 == 2, names("openai")).otherwise(names("anthropic", "openai", "gemini"))
    active = F.when(d % 3 == 0, names()).when(d % 3 == 1, names("gemini", "openai")).otherwise(names("anthropic"))
    requested = F.when(d % 5 == 0, " Gemini ").when(d % 5 == 1, None).when(d % 5 == 2, "").otherwise("auto")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(control.provider_chain(available, active, names("openai", "gemini"), requested), ",").alias("chain"))


@query("""
WITH b AS (SELECT o_custkey AS source_id, o_orderkey AS batch_id, 'f' || o_orderkey || '.pdf' AS source_filename, (o_orderkey % 20)::INT AS total_pages, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
f AS (SELECT * FROM b WHERE n = 1)
SELECT source_id, batch_id, source_filename, p::INT AS page, CASE WHEN p <= 12 THEN '/ocr/source/' || source_id || '/preview?page=' || p END AS preview FROM (SELECT *, unnest(range(1, total_pages + 1)) AS p FROM f)
""")
def source_pages(spark, sf_dir):
    k = F.col("o_orderkey")
    batches = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), k.alias("batch_id"), F.concat(F.lit("f"), k.cast("string"), F.lit(".pdf")).alias("source_filename"), (k % 20).cast("int").alias("total_pages"), "o_orderdate")
    first = control.source_batch(batches, "o_orderdate")
    return control.page_listing(first.select("source_id", "total_pages")).join(first.select("source_id", "batch_id", "source_filename"), "source_id")


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS batch_id, (o_orderkey % 6)::INT * 10 + 1 AS page_from, (o_orderkey % 6)::INT * 10 + 10 AS page_to FROM orders), p AS (SELECT o_custkey AS batch_id, (o_orderkey % 4)::INT * 10 + 1 AS page_from FROM orders WHERE o_orderkey % 3 < 2)
SELECT a.* FROM a ANTI JOIN p USING (batch_id, page_from)
""")
def planned_parts(spark, sf_dir):
    k = F.col("o_orderkey")
    part = lambda n: [F.col("o_custkey").alias("batch_id"), ((k % n).cast("int") * 10 + 1).alias("page_from"), ((k % n).cast("int") * 10 + 10).alias("page_to")]
    o = table(spark, sf_dir, "orders")
    return control.plan_parts(o.select(*part(6)), o.select(*part(4), F.when(k % 3 == 0, "completed").when(k % 3 == 1, "queued").otherwise("failed").alias("status")))


@query("""
WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'quality' ELSE 'balanced' END AS mode, (doc_id % 90)::INT AS n, doc_id % 2 = 0 AS r FROM documents)
SELECT doc_id, mode, NOT r AND n >= 50 AS bulk, r AND mode = 'balanced' AND n > 35 AS balanced_fast, CASE mode WHEN 'fast' THEN 200 WHEN 'balanced' THEN 220 ELSE 320 END AS dpi,
  CASE WHEN mode = 'quality' THEN 1800 WHEN NOT r AND n >= 50 THEN 1400 ELSE 1200 END AS min_edge FROM d
""")
def engine_profiles(spark, sf_dir):
    d = F.col("doc_id")
    p = control.engine_profile(F.when(d % 3 == 0, "rapido").when(d % 3 == 1, "Best").otherwise(None), (d % 90).cast("int"), d % 2 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", p.alias("p")).select("doc_id", "p.*")


@query("""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN [[1.0, 2.0]] ELSE [[doc_id % 7, doc_id % 3], [doc_id % 5, doc_id % 11], [3, 4]] END AS p FROM documents)
SELECT doc_id, CASE WHEN len(p) >= 2 THEN list_min(list_transform(p, lambda x: x[1]))::DOUBLE ELSE 0.0 END AS x0, CASE WHEN len(p) >= 2 THEN list_min(list_transform(p, lambda x: x[2]))::DOUBLE ELSE 0.0 END AS y0,
  CASE WHEN len(p) >= 2 THEN list_max(list_transform(p, lambda x: x[1]))::DOUBLE ELSE 0.0 END AS x1, CASE WHEN len(p) >= 2 THEN list_max(list_transform(p, lambda x: x[2]))::DOUBLE ELSE 0.0 END AS y1 FROM d
""")
def polygon_boxes(spark, sf_dir):
    d = F.col("doc_id")
    pair = lambda a, b: F.array(a.cast("double"), b.cast("double"))
    p = F.when(d % 5 == 0, None).when(d % 5 == 1, F.array(pair(F.lit(1), F.lit(2)))).otherwise(F.array(pair(d % 7, d % 3), pair(d % 5, d % 11), pair(F.lit(3), F.lit(4))))
    return table(spark, sf_dir, "documents").select("doc_id", T.box_to_xyxy(p).alias("b")).select("doc_id", "b.*")


@query("""
WITH w AS (SELECT l_orderkey AS page_id, l_linenumber AS pos, (l_partkey % 100)::DOUBLE AS "left", (l_suppkey * 7 % 60)::DOUBLE AS top, l_discount * 10 AS conf, ' w' || l_partkey || ' ' AS text FROM lineitem WHERE l_discount * 10 >= 0.28),
o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY top, "left", pos) AS k FROM w),
r AS (WITH RECURSIVE z AS (SELECT page_id, k, top AS start FROM o WHERE k = 1 UNION ALL SELECT o.page_id, o.k, CASE WHEN o.top - z.start <= 18 THEN z.start ELSE o.top END FROM z JOIN o ON o.page_id = z.page_id AND o.k = z.k + 1) SELECT * FROM z),
l AS (SELECT page_id, start, string_agg(trim(text), ' ' ORDER BY "left", top, pos, text) AS t, sum(conf) AS c, count(*) AS n FROM o JOIN r USING (page_id, k) GROUP BY page_id, start)
SELECT page_id, string_agg(t, chr(10) ORDER BY start) AS text, round(sum(c) / sum(n) * 100, 6) AS confidence FROM l GROUP BY page_id
""")
def first_fit_lines(spark, sf_dir):
    words = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 100).cast("double").alias("left"), (F.col("l_suppkey") * 7 % 60).cast("double").alias("top"),
        (F.col("l_discount") * 10).alias("conf"), F.concat(F.lit(" w"), "l_partkey", F.lit(" ")).alias("text"),
    )
    return tables.first_fit_lines(words).withColumn("confidence", F.round("confidence", 6))


# documents


@query("""
WITH q AS (SELECT doc_id AS request, CASE WHEN doc_id % 4 = 0 THEN [doc_id, doc_id + 7] WHEN doc_id % 4 = 1 THEN [doc_id, -5] ELSE [doc_id + 1, doc_id, doc_id // 3] END AS ids FROM documents),
u AS (SELECT request, unnest(ids) AS id, generate_subscripts(ids, 1) AS j FROM q), h AS (SELECT request, j, doc_id IS NOT NULL AS hit, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS m FROM u LEFT JOIN documents ON doc_id = id)
SELECT request, CASE WHEN bool_and(hit) THEN nullif(array_to_string(list_filter(list(m ORDER BY j), lambda x: x <> ''), chr(10) || chr(10) || '---' || chr(10) || chr(10)), '') || chr(10) END AS markdown, count(*) AS parts FROM h GROUP BY request
""")
def requested_outputs(spark, sf_dir):
    """A request for every document, together with one or two others."""
    k = F.col("doc_id")
    ids = lambda *x: F.concat_ws(", ", *[(v if hasattr(v, "cast") else F.lit(v)).cast("string") for v in x])
    asked = table(spark, sf_dir, "documents").select(k.alias("request"), F.when(k % 4 == 0, ids(k, k + 7)).when(k % 4 == 1, ids(k, -5)).otherwise(ids(k + 1, k, (k / 3).cast("long"))).alias("job_ids"))
    return assembly.merge_requested(asked, table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("job_id"), F.col("text").alias("markdown")))


@query("""
WITH d AS (SELECT o_custkey AS request, o_orderkey AS position, (o_orderkey % 9)::BIGINT AS source, (o_orderkey % 4)::INT AS pages, o_orderkey % 9 = 3 AS base FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY request, CASE WHEN base THEN source END ORDER BY position) AS n FROM d), k AS (SELECT * FROM n WHERE NOT base OR n = 1),
p AS (SELECT *, coalesce(sum(pages) OVER (PARTITION BY request ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, count(*) OVER (PARTITION BY request) AS c FROM k)
SELECT request, (before + s)::BIGINT AS page, source, s::INT AS source_page FROM (SELECT *, unnest(range(1, pages + 1)) AS s FROM p WHERE c >= 2)
""")
def stacked_pages(spark, sf_dir):
    k = F.col("o_orderkey")
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request"), k.alias("position"), (k % 9).alias("source"), (k % 4).cast("int").alias("pages"), (k % 9 == 3).alias("is_base"))
    return assembly.stack_pages(d)


@query(f"""
WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN regexp_replace(text, '\\S', '', 'g') WHEN 1 THEN regexp_replace(text, '[\\s\\S]*?(\\S)\\s*$', '\\1') ELSE text END AS t, doc_id % 10 AS doc, CASE WHEN doc_id % 4 = 0 THEN ['| a |', ' '] ELSE [] END AS tb FROM documents),
l AS (SELECT doc, length({sql_plain('t')}) >= 24 AS h, len(tb) AS k, {sql_strip("array_to_string(list_filter(list_concat(CASE WHEN length(" + sql_plain('t') + ") >= 24 THEN [t] ELSE [] END, CASE WHEN length(" + sql_plain('t') + ") >= 24 AND len(tb) > 0 THEN ['## Tablas detectadas'] ELSE [] END, tb), lambda x: trim(x) <> ''), chr(10) || chr(10))")} AS page FROM d),
s AS (SELECT doc, sum(length({sql_plain('page')}))::BIGINT AS chars, count(*) FILTER (h) AS text_pages, sum(k)::BIGINT AS tables, count(*) AS n FROM l GROUP BY doc)
SELECT doc, chars, text_pages, tables, chars >= least(100, greatest(36, n * 18)) AND text_pages > 0 AS accepted FROM s
""")
def digital_acceptance(spark, sf_dir):
    d = F.col("doc_id")
    t = F.when(d % 3 == 0, F.regexp_replace("text", r"[^\s]", "")).when(d % 3 == 1, F.regexp_replace("text", r"[\s\S]*?(\S)\s*$", "$1")).otherwise(F.col("text"))
    tables_ = F.when(d % 4 == 0, F.array(F.lit("| a |"), F.lit(" "))).otherwise(F.array().cast("array<string>"))
    pages = table(spark, sf_dir, "documents").select((d % 10).alias("doc"), t.alias("text"), tables_.alias("tables"))
    return assembly.digital_acceptance(pages, "doc")


ENGINES = f"""
WITH d AS (SELECT doc_id, text AS a, CASE WHEN doc_id % 3 = 0 THEN '' ELSE regexp_replace(text, '[aeiou]', '', 'g') END AS b, (doc_id % 12)::DOUBLE AS conf FROM documents),
s AS (SELECT doc_id, a, b, conf, (SELECT {QUALITY_SQL} FROM (SELECT {sql_plain('a')} AS p)) AS sa, (SELECT {QUALITY_SQL} FROM (SELECT {sql_plain('b')} AS p)) AS sb FROM d)
"""


def _engines(spark, sf_dir):
    d = F.col("doc_id")
    thin = F.when(d % 3 == 0, "").otherwise(F.regexp_replace("text", "[aeiou]", ""))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("a"), thin.alias("b"), (d % 12).cast("double").alias("conf"))


@query(ENGINES + "SELECT doc_id, CASE WHEN b <> '' AND sb + conf * 1.35 > sa THEN 'paddle' ELSE 'tesseract' END AS engine, round(CASE WHEN b <> '' AND sb + conf * 1.35 > sa THEN sb + conf * 1.35 ELSE sa END, 6) AS score FROM s")
def best_engine(spark, sf_dir):
    one = lambda e, m, c: F.struct(F.lit(e).alias("engine"), F.col(m).alias("markdown"), c.alias("confidence"))
    rows = _engines(spark, sf_dir).select("doc_id", F.explode(F.array(one("tesseract", "a", F.lit(0.0)), one("paddle", "b", F.col("conf")))).alias("u")).select("doc_id", "u.*")
    return assembly.best_engine(rows, "doc_id").select("doc_id", "engine", F.round("score", 6).alias("score"))


@query(ENGINES + f"SELECT doc_id, CASE WHEN sb >= 60 AND length({sql_plain('b')}) >= 24 THEN 'thin' WHEN sa >= 18 AND length({sql_plain('a')}) >= 12 THEN 'whole' END AS engine FROM s WHERE (sb >= 60 AND length({sql_plain('b')}) >= 24) OR (sa >= 18 AND length({sql_plain('a')}) >= 12)")
def engine_cascade(spark, sf_dir):
    one = lambda p, e, m, s, c: F.struct(F.lit(p).alias("priority"), F.lit(e).alias("engine"), F.col(m).alias("markdown"), F.lit(s).alias("min_score"), F.lit(c).alias("min_chars"))
    rows = _engines(spark, sf_dir).select("doc_id", F.explode(F.array(one(1, "thin", "b", 60, 24), one(2, "whole", "a", 18, 12))).alias("u")).select("doc_id", "u.*")
    return assembly.accepted_reading(rows, "doc_id").select("doc_id", "engine")


@query(ENGINES + f"""
, w AS (SELECT doc_id, a, sa, b, sb, CASE doc_id % 4 WHEN 0 THEN ['gemini'] WHEN 1 THEN ['openai', 'gemini'] WHEN 2 THEN [] ELSE ['anthropic'] END AS ps, sb < 28 OR length({sql_plain('b')}) < 24 AS weak FROM s),
f AS (SELECT doc_id % 20 AS doc, doc_id AS i, weak AND sa > sb + 8 AS back, CASE WHEN weak THEN [] ELSE ps END AS ps, CASE WHEN weak AND sa > sb + 8 THEN a ELSE b END AS final FROM w),
k AS (SELECT * FROM f WHERE final <> ''), t AS (SELECT doc, count(*) AS pages, count(*) FILTER (back) AS fallbacks FROM k GROUP BY doc),
u AS (SELECT doc, i, unnest(ps) AS p, generate_subscripts(ps, 1) AS j FROM k), c AS (SELECT doc, p, count(*) AS n, min(row(i, j)) AS first FROM u GROUP BY doc, p),
m AS (SELECT doc, p, row_number() OVER (PARTITION BY doc ORDER BY n DESC, first) AS r FROM c)
SELECT t.doc, pages, fallbacks, coalesce(p, 'vision') AS method FROM t LEFT JOIN m ON m.doc = t.doc AND r = 1
""")
def provider_usage(spark, sf_dir):
    d = F.col("doc_id")
    source = F.when(d % 4 == 0, "gemini-x").when(d % 4 == 1, "parallel:openai+gemini").when(d % 4 == 2, "tesseract").otherwise("anthropic")
    pages = _engines(spark, sf_dir).select((d % 20).alias("doc"), d.alias("index"), F.col("b").alias("markdown"), source.alias("source"), F.col("a").alias("local"))
    return assembly.provider_usage(pages, "doc")


@query(SECTIONS + f", x AS (SELECT doc_id, {SECTIONED} AS x FROM documents), y AS (SELECT doc_id, length(x) AS chars, length({COMPRESSED}) AS cc FROM x) SELECT y.doc_id, chars::INT AS chars, cc::INT AS chars_compressed, (SELECT count(*) FROM t WHERE t.doc_id = y.doc_id)::INT AS sections, (SELECT sum(length(content)) FROM t WHERE t.doc_id = y.doc_id)::BIGINT AS section_chars FROM y")
def analyzed_markdown(spark, sf_dir):
    out = assembly.analyze(table(spark, sf_dir, "documents").select("doc_id", _sectioned().alias("x")), "doc_id", "x")
    chars = F.aggregate("sections", F.lit(0).cast("long"), lambda a, s: a + s["chars"])
    return out.select("doc_id", "chars", "chars_compressed", F.size("sections").alias("sections"), chars.alias("section_chars"))


@query(SECTIONS + f"""
, k AS (SELECT doc_id, array_to_string(list(content ORDER BY i), chr(10) || chr(10) || '---' || chr(10) || chr(10)) || chr(10) AS m FROM t WHERE id IN ('0', '2') GROUP BY doc_id),
e AS (SELECT d.doc_id, length(d.x) AS before_chars, CASE WHEN d.doc_id % 2 = 0 THEN m ELSE d.x END AS x FROM (SELECT doc_id, {SECTIONED} AS x FROM documents) d LEFT JOIN k USING (doc_id) WHERE d.doc_id % 2 = 1 OR m IS NOT NULL),
y AS (SELECT doc_id, before_chars, CASE WHEN doc_id % 5 < 2 THEN {COMPRESSED} ELSE x END AS markdown FROM e)
SELECT doc_id, markdown, before_chars::INT AS before_chars, length(markdown)::INT AS after_chars, round_even((1 - length(markdown) / before_chars) * 100, 1) AS saved_pct FROM y
""")
def edited_markdown(spark, sf_dir):
    d, none = F.col("doc_id"), F.array().cast("array<string>")
    keep = F.when(d % 2 == 0, F.array(F.lit("0"), F.lit("2"))).otherwise(none)
    return assembly.edit(table(spark, sf_dir, "documents").select("doc_id", _sectioned().alias("x")), "doc_id", "x", keep, d % 5 < 2)


# smaller operators


@query("""
WITH b AS (SELECT c_custkey % 40 AS batch_id, c_custkey AS job_id, (c_custkey // 40)::INT * 10 AS a, c_custkey % 3 = 0 AS done FROM customer)
SELECT batch_id, job_id, 'libro' || batch_id || '_p' || (a + 1) || '-' || (a + 10) || ext AS arcname FROM b, (VALUES ('.md'), ('.txt')) t(ext) WHERE done
""")
def batch_archives(spark, sf_dir):
    k = F.col("c_custkey")
    first = (k / 40).cast("int") * 10
    parts = table(spark, sf_dir, "customer").select((k % 40).alias("batch_id"), k.alias("job_id"), (first + 1).alias("page_from"), (first + 10).alias("page_to"), F.when(k % 3 == 0, "completed").otherwise("queued").alias("status"))
    return jobs.zip_manifest(parts.select("batch_id").distinct().withColumn("source_filename", F.concat(F.lit("libro"), "batch_id", F.lit(".pdf"))), parts)


@query("""
WITH p AS (SELECT o_custkey AS batch_id, (o_orderkey % 4)::INT AS page_from, (o_orderkey % 4)::INT + 9 AS page_to, o_orderkey AS job_id FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY batch_id, page_from, page_to ORDER BY job_id DESC) AS n FROM p)
SELECT batch_id, page_from, page_to, job_id, (row_number() OVER (PARTITION BY batch_id ORDER BY page_from, page_to))::INT AS position FROM k WHERE n = 1
""")
def replaced_parts(spark, sf_dir):
    k = F.col("o_orderkey")
    parts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch_id"), (k % 4).cast("int").alias("page_from"), ((k % 4).cast("int") + 9).alias("page_to"), k.alias("job_id"))
    return jobs.replace_parts(parts, "job_id")


@query("""
SELECT l_orderkey AS page_id, l_returnflag AS variant, coalesce(avg(CASE WHEN l_quantity - 2 <> -1 THEN l_quantity - 2 END), 55.0) AS confidence, max(l_linenumber)::DOUBLE + 1.35 * coalesce(avg(CASE WHEN l_quantity - 2 <> -1 THEN l_quantity - 2 END), 55.0) AS score
FROM lineitem GROUP BY ALL
""")
def candidate_scores(spark, sf_dir):
    words = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_returnflag").alias("variant"), (F.col("l_quantity") - 2).alias("conf"), F.col("l_linenumber").cast("double").alias("quality"))
    return candidates.candidate_scores(words, ["page_id", "variant"], "conf", "quality").drop("quality")


@query("SELECT l_orderkey AS page_id, arg_min(l_linestatus, l_linenumber) AS mode, min(l_linenumber) AS priority FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM (SELECT l_orderkey, l_linenumber, min(l_linestatus) AS l_linestatus, bool_or(l_quantity > 20) AS ok FROM lineitem GROUP BY ALL)) WHERE ok GROUP BY l_orderkey")
def first_accepted(spark, sf_dir):
    readings = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("priority")).agg(F.min("l_linestatus").alias("mode"), F.bool_or(F.col("l_quantity") > 20).alias("ok"))
    return candidates.first_accepted(readings, "page_id", "priority", "ok", "mode")


@query("""
WITH p AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'digital' WHEN 1 THEN 'both' ELSE 'ocr' END AS route, 'm' || doc_id AS m, CASE WHEN doc_id % 4 > 0 THEN upper(lang) END AS t, CASE WHEN doc_id % 5 = 0 THEN '| a |' END AS tb FROM documents)
SELECT doc_id, route, concat_ws(chr(10) || chr(10), CASE route WHEN 'digital' THEN m WHEN 'both' THEN concat_ws(chr(10) || chr(10), m, t) ELSE coalesce(t, m) END, tb) AS markdown FROM p
""")
def page_plans(spark, sf_dir):
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    pages = docs.select("doc_id", F.when(d % 3 == 0, "digital").when(d % 3 == 1, "both").otherwise("ocr").alias("route"), F.concat(F.lit("m"), d.cast("string")).alias("markdown"))
    readings = docs.where(d % 4 > 0).select("doc_id", F.upper("lang").alias("text"))
    return jobs.page_plan(pages, readings, docs.where(d % 5 == 0).select("doc_id", F.lit("| a |").alias("table")), ["doc_id"])


@query(rf"""
SELECT doc_id, ({' + '.join(f"contains(upper(replace(text, 'ß', 'ss') || ' Fecha ' || lang), '{k}')::INT" for k in HEADER_KEYS)})::INT AS hits, n_chars >= 15 * 1024 * 1024 OR (doc_id % 2 = 0 AND doc_id % 90 >= 35) AS async,
  {sql_strip(f"replace(regexp_replace({sql_strip(sub('replace(text, chr(160), chr(32))', ('[ ' + chr(92) + 't]+', SPACE), (chr(92) + 'n{3,}', NL + ' || ' + NL)))}, chr(10), ' ', 'g'), '|', '/')")} AS cell FROM documents
""")
def small_rules(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", header_hits(F.concat(F.replace("text", F.lit("ß"), F.lit("ss")), F.lit(" Fecha "), "lang")).alias("hits"), runs_async(F.col("n_chars"), d % 90, d % 2 == 0).alias("async"), normalize_wide_cell(F.col("text")).alias("cell"),
    )


def _assembled(spark, sf_dir):
    """Documents of four pages each; of every seventh only the joined Markdown is known."""
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = (k / 4).cast("long")
    pages = docs.where(n % 7 != 0).select(n.alias("doc"), (k % 4).cast("int").alias("index"), F.when(k % 2 == 0, F.col("text")).alias("markdown"), F.when(k % 2 == 1, F.col("text")).alias("text"), (k % 3 == 0).alias("digital"), F.when(k % 5 == 0, True).alias("ocr_sourced"))
    joined = docs.where(n % 7 == 0).groupBy(n.alias("doc")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n\n---\n\n").alias("markdown"))
    d = F.col("doc")
    heads = docs.select(n.alias("doc")).distinct().join(joined, "doc", "left").select(
        "doc", F.when(d % 3 == 0, "digital_pdf").when(d % 3 == 1, "tesseract").otherwise("vision").alias("method"), "markdown",
        F.array(F.lit("a"), F.lit(""), F.concat(F.lit("w"), (d % 2).cast("string")), F.lit("a")).alias("warnings"), (d * 1024 * 1024).alias("size_bytes"), (d % 2 == 0).alias("is_pdf"), (d % 60).cast("int").alias("file_pages"),
    )
    return heads, pages


ASSEMBLED = f"""
WITH n AS (SELECT doc_id, doc_id // 4 AS doc, text FROM documents),
pg AS (SELECT doc_id AS pid, doc, (doc_id % 4)::INT AS i, text AS own, text AS raw, doc % 3 <> 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS hard FROM n WHERE doc % 7 <> 0
  UNION ALL SELECT -1 - doc, doc, -1, NULL, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id), doc % 3 <> 0 FROM n WHERE doc % 7 = 0 GROUP BY doc),
nm AS (SELECT pid, hard, {sql_normalize('raw')} AS t FROM pg), gentle AS (SELECT pid, t FROM nm WHERE NOT hard), {Q.watermark_free('gentle', 'pid', 't')},
ready AS (SELECT pid, true AS hard, {sql_blobs(sql_strip('t'))} AS t FROM nm WHERE hard UNION ALL SELECT pid, false, t FROM free),
ln AS (SELECT pid, hard, generate_subscripts(ls, 1) - 1 AS line, unnest(ls) AS raw FROM (SELECT pid, hard, string_split(t, chr(10)) AS ls FROM ready)), s AS (SELECT pid, hard, line, raw, {sql_strip('raw')} AS s FROM ln), {STEPS},
kk AS (SELECT pid, hard, line, raw, CASE WHEN hard THEN {Q.cleaned_line(True)} ELSE {Q.cleaned_line(False)} END AS cleaned FROM r3), kf AS (SELECT *, line - coalesce(lag(line) OVER (PARTITION BY pid ORDER BY line), -1) - 1 AS skipped FROM kk WHERE cleaned IS NOT NULL),
kj AS (SELECT pid, string_agg(CASE WHEN skipped >= 10 AND (hard OR raw LIKE '#%') THEN chr(10) || '> Sello o timbre omitido.' || chr(10) || chr(10) ELSE '' END || cleaned, chr(10) ORDER BY line) AS t FROM kf GROUP BY pid),
md AS (SELECT pid, doc, i, own, {sql_normalize('t')} AS m FROM pg JOIN kj USING (pid)),
parts AS (SELECT doc, i, own, m, true AS paged FROM md WHERE i >= 0 AND m <> '' UNION ALL
  SELECT doc, generate_subscripts(ps, 1) - 1, NULL, unnest(ps), len(ps) > 1 FROM (SELECT doc, list_filter(list_transform(string_split(regexp_replace(m, '\\n\\s*---\\s*\\n', chr(1), 'g'), chr(1)), lambda y: {sql_strip('y')}), lambda y: y <> '') AS ps FROM md WHERE i < 0)),
txt AS (SELECT doc, i, m, paged, CASE WHEN i >= 0 AND own IS NOT NULL AND (doc * 4 + i) % 2 = 1 THEN {sql_plain('own')} ELSE {sql_plain('m')} END AS t FROM parts),
dd AS (SELECT doc, bool_or(paged) AS paged, count(*) AS n, array_to_string(list(m ORDER BY i), chr(10) || chr(10) || '---' || chr(10) || chr(10)) AS markdown, list(t ORDER BY i) AS ts FROM txt GROUP BY doc),
hd AS (SELECT DISTINCT doc FROM n)
SELECT hd.doc, CASE hd.doc % 3 WHEN 0 THEN 'digital_pdf' WHEN 1 THEN 'tesseract' ELSE 'vision' END AS method, coalesce(markdown, '') AS markdown,
  coalesce(CASE WHEN len(ts) = 1 THEN ts[1] ELSE array_to_string(list_filter(list_transform(ts, lambda t, i: CASE WHEN t <> '' THEN '--- Página ' || i || '/' || len(ts) || ' ---' || chr(10) || t END), lambda x: x IS NOT NULL), chr(10) || chr(10)) END, '') AS text,
  CASE WHEN paged THEN n WHEN hd.doc % 2 = 0 THEN greatest(1, hd.doc % 60) WHEN n > 0 THEN 1 ELSE 0 END::INT AS total_pages, coalesce(n, 0)::INT AS n_pages,
  concat_ws('|', 'a', 'w' || hd.doc % 2, CASE WHEN hd.doc >= 20 THEN 'Archivo pesado (' || hd.doc || '.0 MB). Si el resultado sale incompleto, intenta dividir el documento.' END,
    CASE WHEN hd.doc % 2 = 0 AND NOT coalesce(paged, false) AND hd.doc % 60 > 30 THEN 'PDF largo (' || hd.doc % 60 || ' páginas). Revisa el resultado por secciones para validar tablas y texto.' END) AS warnings
FROM hd LEFT JOIN dd USING (doc)
"""


@query(ASSEMBLED)
def assembled_documents(spark, sf_dir):
    heads, pages = _assembled(spark, sf_dir)
    out = assembly.assemble(heads, pages, "doc")
    return out.select("doc", "method", "markdown", "text", "total_pages", F.size("pages").alias("n_pages"), F.array_join("warnings", "|").alias("warnings"))


@query(f"""
WITH z AS (SELECT doc_id, text, {sql_normalize('text')} AS t FROM documents), b AS (SELECT doc_id, text, {sql_blobs(sql_strip('t'))} AS t FROM z),
ln AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line, unnest(ls) AS raw FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM b)), s AS (SELECT doc_id, line, {sql_strip('raw')} AS s FROM ln), {STEPS},
k AS (SELECT doc_id, line, {Q.cleaned_line()} AS cleaned FROM r3), f AS (SELECT *, line - coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY line), -1) - 1 AS skipped FROM k WHERE cleaned IS NOT NULL),
j AS (SELECT doc_id, string_agg(CASE WHEN skipped >= 10 THEN chr(10) || '> Sello o timbre omitido.' || chr(10) || chr(10) ELSE '' END || cleaned, chr(10) ORDER BY line) AS t FROM f GROUP BY doc_id),
m AS (SELECT d.doc_id, text, coalesce({sql_normalize('t')}, '') AS markdown FROM documents d LEFT JOIN j USING (doc_id))
SELECT doc_id, markdown, length(text)::INT AS before_chars, length(markdown)::INT AS after_chars, (CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\\n\\z', ''), chr(10))) END - CASE WHEN markdown = '' THEN 0 ELSE len(string_split(markdown, chr(10))) END)::INT AS lines_removed FROM m
""")
def cleaned_markdown(spark, sf_dir):
    return assembly.clean(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""
WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN 'EVIDENCIA CRIPTOGRÁFICA' || chr(10) || 'FIRMANTE Nombre:' || chr(10) || ' Ana' || chr(10) || 'Status: Bueno' || chr(10) || regexp_replace(text, '[^a-z\\s]', '', 'g') ELSE ' ' END AS fl, text FROM documents),
bl AS (SELECT doc_id, u.y, u.x, {sql_strip(sub("replace(u.t, chr(160), ' ')", ('[ ' + chr(92) + 't]+', SPACE), (chr(92) + 'n{3,}', NL + ' || ' + NL)))} AS t FROM (SELECT doc_id, unnest([{{'y': (doc_id % 50)::DOUBLE, 'x': 5.0, 't': '  bloque   uno ' || text}}, {{'y': (doc_id % 7) + 1.5, 'x': 2.0, 't': 'segundo bloque ' || doc_id}}, {{'y': 1.0, 'x': 1.0, 't': 'NOTARIA PUBLICA'}}]) AS u FROM d)),
bj AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY round_even(y / 4, 0), x, y) AS b FROM bl WHERE t <> '' AND t <> 'NOTARIA PUBLICA' GROUP BY doc_id),
x AS (SELECT doc_id, fl, CASE WHEN length({sql_strip('fl')}) >= 24 THEN {sql_strip(sub("replace(fl, chr(160), ' ')", ('[ ' + chr(92) + 't]+', SPACE), (chr(92) + 'n{3,}', NL + ' || ' + NL)))} ELSE b END AS t FROM d JOIN bj USING (doc_id)), {Q.watermark_free('x', 'doc_id', 't')}
SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN '### Evidencia criptográfica (resumen)' || chr(10) || '- **Firmante:** Ana' || chr(10) || '- **Estatus:** Bueno' || chr(10) || chr(10) || '> Cadena de firma, sellos de tiempo y tablas hex omitidos; solo metadatos legibles.' ELSE {Q.digital_text('t')} END AS markdown FROM free
""")
def digital_text_layers(spark, sf_dir):
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    flowing = F.when(d % 3 == 0, F.col("text")).when(d % 3 == 1, F.concat(F.lit("EVIDENCIA CRIPTOGRÁFICA\nFIRMANTE Nombre:\n Ana\nStatus: Bueno\n"), F.regexp_replace("text", r"[^a-z\s]", ""))).otherwise(" ")
    block = lambda y, x, t: F.struct(y.cast("double").alias("y"), F.lit(x).alias("x"), t.alias("text"))
    blocks = docs.select("doc_id", F.explode(F.array(
        block(d % 50, 5.0, F.concat(F.lit("  bloque   uno "), "text")), block(d % 7 + 1.5, 2.0, F.concat(F.lit("segundo bloque "), d.cast("string"))), block(F.lit(1), 1.0, F.lit("NOTARIA PUBLICA")))).alias("b")).select("doc_id", "b.*")
    return assembly.digital_pages(docs.select("doc_id", flowing.alias("flowing")), blocks, ["doc_id"])


CELL_TABLES = """
WITH c AS (SELECT l_orderkey AS page_id, l_linenumber AS ordinal, max(l_partkey) AS p FROM lineitem GROUP BY ALL),
m AS (SELECT *, '| ' || CASE WHEN p % 2 = 0 THEN 'fecha' ELSE 'cosa' END || ' | total |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || CASE WHEN p % 3 = 0 THEN '01/02/2020' ELSE 'valor' END || ' | ' || CASE WHEN p % 5 = 0 THEN '$ 5' ELSE 'cinco' END || ' |' AS markdown,
  3 * 0.8 + 24 + CASE WHEN p % 3 = 0 THEN 18 ELSE 0 END + CASE WHEN p % 5 = 0 THEN 22 ELSE 0 END AS score FROM c)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY ordinal) - 1)::INT AS position, markdown, round(score, 6)::DOUBLE AS score FROM (SELECT *, rank() OVER (PARTITION BY page_id ORDER BY score DESC) AS r FROM m) WHERE r = 1
"""


@query(CELL_TABLES)
def best_page_tables(spark, sf_dir):
    return tables.best_tables(_cell_tables(spark, sf_dir)).withColumn("score", F.round("score", 6))


def _cell_tables(spark, sf_dir):
    p = F.col("p")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("ordinal")).agg(F.max("l_partkey").alias("p"))
    md = F.concat(F.lit("| "), F.when(p % 2 == 0, "fecha").otherwise("cosa"), F.lit(" | total |\n| --- | --- |\n| "), F.when(p % 3 == 0, "01/02/2020").otherwise("valor"), F.lit(" | "), F.when(p % 5 == 0, "$ 5").otherwise("cinco"), F.lit(" |"))
    return rows.select("page_id", "ordinal", md.alias("markdown"))


@query(CELL_TABLES[: CELL_TABLES.index("SELECT page_id, (row")] + "SELECT page_id, arg_max(markdown, row(score, -ordinal)) AS markdown, arg_max(ordinal, row(score, -ordinal)) AS ordinal, round(max(score), 6)::DOUBLE AS score FROM m GROUP BY page_id HAVING max(score) >= 28")
def accepted_page_table(spark, sf_dir):
    return tables.best_table(_cell_tables(spark, sf_dir)).withColumn("score", F.round("score", 6)).select("page_id", "markdown", "ordinal", "score")


def sql_annotated(lines: str) -> str:
    """A list of lines as bullets, joined."""
    flat = f"list_filter(list_transform({lines}, lambda y: {sql_strip(sub('y', (chr(92) + 's+', SPACE)))}), lambda s: s <> '')"
    kind = r"""CASE WHEN (regexp_matches(s, '^[A-Z0-9][A-Z0-9\s\-./]{2,}$') AND length(s) <= 48) OR (NOT (length(s) <= 42 AND regexp_matches(s, '[a-záéíóúñ]')) AND regexp_matches(s, '\d{2,}') AND length(s) <= 32)
  THEN '- **Sello / código:** ' WHEN length(s) <= 42 AND regexp_matches(s, '[a-záéíóúñ]') THEN '- **Firma / manuscrito:** ' ELSE '- ' END || s"""
    return f"array_to_string(list_transform({flat}, lambda s: {kind}), chr(10))"


@query(f"""
WITH l AS (SELECT doc_id + 1 - 2 * (doc_id % 2) AS page, {sql_strip('unnest(string_split(text, chr(10)))')} AS line FROM documents), b AS (SELECT page, lower(line) AS k, arg_max(line, row(length(line), line)) AS line, max(length(line)) AS score FROM l WHERE length(line) >= 2 GROUP BY page, k),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, k) AS rank FROM b), e AS (SELECT page, list(line ORDER BY rank) AS ls FROM r WHERE rank <= 24 GROUP BY page),
p AS (SELECT doc_id, text, lower({sql_plain('text')}) AS main, string_split({sql_annotated("coalesce(ls, [])")}, chr(10)) AS fs FROM documents LEFT JOIN e ON page = doc_id),
f AS (SELECT *, list_filter(list_transform(fs, lambda y: {sql_strip('y')}), lambda x: length(x) >= 2 AND NOT (contains(main, lower(x)) OR (length(x) BETWEEN 12 AND 80 AND len(list_filter(range(1, length(x) - 10, 4), lambda i: contains(main, lower(x)[i:i + 11]))) > 0))) AS fresh FROM p),
g AS (SELECT doc_id, text, {sql_annotated('fresh')} AS body FROM f)
SELECT doc_id, CASE WHEN body = '' THEN text WHEN contains(lower({sql_normalize('text')}), '## firmas, sellos y anotaciones') THEN {sql_normalize('text')} ELSE {sql_strip(f"{sql_normalize('text')} || {NL} || {NL} || '## Firmas, sellos y anotaciones' || {NL} || {NL} || body")} END AS markdown FROM g
""")
def enriched_pages(spark, sf_dir):
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    lines = docs.select((d + 1 - 2 * (d % 2)).alias("doc_id"), F.explode(F.split("text", "\n", -1)).alias("line")).withColumn("score", F.length(F.regexp_replace("line", r"^\s+|\s+$", "")))
    return candidates.enrich_pages(docs, lines, "doc_id", "text")


@query("""
SELECT doc_id, '/download/' || doc_id || '/txt' AS txt, '/download/' || doc_id || '/md' AS md, CASE WHEN doc_id % 3 = 0 THEN '/download/' || doc_id || '/pdf' END AS pdf, CASE WHEN doc_id % 5 = 0 THEN '/download/' || doc_id || '/docx' END AS docx, 'f' || doc_id || '_x.md' AS name FROM documents
""")
def result_links(spark, sf_dir):
    d = F.col("doc_id")
    none = F.array().cast("array<string>")
    written = F.concat(F.array(F.lit("txt"), F.lit("md")), F.when(d % 3 == 0, F.array(F.lit("pdf"))).otherwise(none), F.when(d % 5 == 0, F.array(F.lit("docx"))).otherwise(none))
    links = writers.download_links(d.cast("string"), F.concat(F.lit("in/f"), d.cast("string"), F.lit(":x.pdf")), written)
    return table(spark, sf_dir, "documents").select("doc_id", links.alias("l")).select("doc_id", "l.*")
