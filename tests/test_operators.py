"""Branch tables and properties of the operators, with nulls and odd values."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliant.functions import chatter as K
from foliant.functions import cleaning as C
from foliant.functions import predicates as P
from foliant.functions import scores as S
from foliant.functions import tables as T2
from foliant.functions import text as T
from foliant.operators import assembly, candidates, control, documents, grams, jobs, layout, ranges, tables
from foliant.operators.cleaned import sanitized
from foliant.plans import reading_queries
from foliant.sources import folders, readers, state_log, writers


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def one(spark, texts, f):
    return [v for (v,) in values(spark, [(t,) for t in texts], "t string", f(F.col("t")).alias("v"))]


def test_text(spark):
    assert one(spark, ["a\r\nb\fc", "a\n\n\n\nb ", None], T.normalize_markdown) == ["a\nb\n\n---\n\nc", "a\n\nb", ""]
    assert one(spark, ["a  b  \n\n\n\nc", "", None, " \n "], T.compress_markdown) == ["a b\n\nc\n", "", "", ""]
    assert one(spark, ["ab", "", None], S.saved_pct) == [-50.0, 0.0, 0.0]
    assert one(spark, ["# T\n\n- x\n\n---\n\n| a | b |\n| --- | --- |\n**f** [l](u) a_b"], T.strip_markdown_syntax) == ["T\nx\n\n a b \n\nf l ab"]
    assert one(spark, ["\n\nbien\n\n\n\n~~^^~~\nçok", None], T.clean_text) == ["bien\n\nok", ""]
    assert one(spark, ["a/b/x:y.tar.gz", "", None, ".pdf", "a"], T.safe_stem) == ["x_y.tar", "documento", "documento", ".pdf", "a"]
    assert one(spark, [" a\n b | c "], T.normalize_cell) == ["a b / c"]
    assert one(spark, ["<p>a&amp;b</p><script>x</script><ul><li>c</ul>"], T.html_to_markdown) == ["a&b\n\n- c"]


def test_normalizing_twice_changes_nothing(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(50).collect()] + ["\f\f a \r\n\n\n b", "a \n \n b"]
    for f in (T.normalize_markdown, T.compress_markdown):
        once = one(spark, texts, f)
        assert one(spark, once, f) == once


def test_scores(spark):
    assert one(spark, ["", None], S.text_quality_score) == [0.0, 0.0]
    scores = one(spark, ["palabra " * 5000 + "\n" * 3 + "línea\n" * 200], S.text_quality_score)
    assert 0 < scores[0] <= 165
    assert one(spark, ["| a |\n| b |", None, ""], S.score_table_markdown) == [0.0, 0.0, 0.0]
    assert one(spark, ["bcd fgh", "hola bcd", "", None], S.token_vowel_ratio) == [0.0, 0.5, 0.0, 0.0]
    assert [v for (v,) in values(spark, [(1,), (3,), (10,), (None,)], "n int", S.minimum_pdf_text_chars(F.col("n")).alias("v"))] == [36, 54, 100, 36]


def test_predicates(spark):
    assert one(spark, ["RAPIDO ", "best", "x", None], P.normalize_mode) == ["fast", "quality", "balanced", "balanced"]
    rows = [(0.52, 9, "x" * 900), (0.40, 3, "x" * 200), (0.40, 4, "x" * 200), (0.25, 9, "x" * 30), (0.1, 0, "")]
    assert [v for (v,) in values(spark, rows, "c double, b int, r string", P.is_scan_dominant(F.col("c"), F.col("b"), F.col("r")).alias("v"))] == [True, True, False, True, False]
    kinds = ["Checklist y recibo de luz", "palabra " * 50, "CLAVE DE ELECTOR", "las partes firman este contrato de obra y convenio", None, "un cinema libre"]
    assert one(spark, kinds, P.page_kind) == ["checklist", "generic", "credential", "contract", "generic", "generic"]
    assert one(spark, ["JUAN PEREZ LOPEZ", "PRIMERO", "12/12/20 10:10:10", "hola", "", None, "RECURSO DE REVISION"], P.is_stamp_line) == [True, False, True, False, False, False, False]
    assert one(spark, ["CLÁUSULA PRIMERA", "OBJETO:", "JUAN PEREZ LOPEZ", "hola", None], P.is_heading_line) == [True, True, False, False, False]
    assert one(spark, ["| a | b |", "| a", None], P.is_table_line) == [True, False, False]


def test_cleaning(spark):
    noisy = ["Total 5 Sello digital del SAT: abcd", "uuid 0a1b2c3d-0a1b-0a1b-0a1b-0a1b2c3d4e5f fin", "x" * 60, None, "a || [m1] b"]
    assert one(spark, noisy, C.strip_inline_noise) == ["Total 5", "uuid fin", "", "", "a b"]
    prose = "palabras comunes bastante largas seguidas siempre ahora"
    assert one(spark, [prose], C.remove_base64) == [" "]
    assert one(spark, [prose], lambda t: C.remove_base64(t, strict_reference=False)) == [prose]
    lines = ["", None, "| a | b |", "# Informe anual de obra", "# JUAN PEREZ", "ab", "12", "Este contrato se firma hoy en la ciudad", "Xk9 q2 zz 7b w1 p0 rt 4v", "OJNJIDNDIY", "CamScanner", "# Recibo AB"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    got = [r["cleaned"] for r in C.clean_lines(df, "t").orderBy("i").collect()]
    assert got == ["", "", "| a | b |", "# Informe anual de obra", None, None, None, "Este contrato se firma hoy en la ciudad", None, "OJNJIDNDIY", None, "# Recibo AB"]
    docs = spark.createDataFrame([(1, "Primera frase de prueba larga\n" + "zz\n" * 10 + "Segunda frase de prueba larga"), (2, None), (3, "zz")], "k int, t string")
    got = dict(map(tuple, C.sanitize_documents(docs, "k", "t").collect()))
    assert got == {1: "Primera frase de prueba larga\n\n> Sello o timbre omitido.\n\nSegunda frase de prueba larga", 2: "", 3: ""}
    assert one(spark, ["1) a\n2) b\n\n• c\n\nOBJETO:\n\nuna\nlinea", "1) a\n2. b", "# x", None], C.structure_markdown) == ["1. a\n\n2. b\n\n- c\n\n## OBJETO\n\nuna\nlinea", "1) a\n2. b", "# x", ""]
    assert one(spark, ["JUAN PEREZ LOPEZ\nhola 12/12/20 10:10:10 y una frase bastante larga\n\n\n\n12/12/20 10:10:10 x\nx", None], C.normalize_digital_text) == ["hola y una frase bastante larga\n\nx", ""]


def test_chatter(spark):
    texts = [
        "Aquí está el texto:\n---\n\nCláusula uno\n\nfin\n¿En qué más puedo ayudarte?\nmás", "No puedo transcribir esto", "", None, "solo texto",
        "Este documento es largo\r\n" + "uno " * 40 + "\r\nHe transcrito todo", "I cannot transcribe\n" + "palabra " * 30, "***\nThis is a page",
    ]
    assert one(spark, texts, K.strip_chatter) == ["Cláusula uno\n\nfin", "", "", "", "solo texto", ("uno " * 40).strip(), ("palabra " * 30).strip(), ""]
    assert one(spark, texts, K.is_refusal) == [True, True, False, False, False, False, True, True]
    penalty = [v for (v,) in values(spark, [(t,) for t in texts], "t string", F.round(S.text_quality_score(F.col("t")) - K.reading_score(F.col("t")), 6).alias("v"))]
    assert penalty == [260.0, 200.0, 0.0, 0.0, 0.0, 60.0, 200.0, 30.0]
    answers = ['{"choices": [{"message": {"content": " a "}}]}', '{"choices": [{"message": {"content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}}]}',
               '{"content": [{"type": "text", "text": "x"}, {"type": "tool", "text": "y"}]}', "{}", "no json", None]
    assert one(spark, answers, K.response_text) == ["a", "a\nb", "x", "", "", ""]


def test_polished_paragraphs_and_flattened_tables(spark):
    assert one(spark, ["PRIMERO. Nada\n\nOBJETO:\n\nuna\nlinea\n\notra", None, ""], C.polish_paragraphs) == ["## PRIMERO. Nada\n\n## OBJETO\n\nuna linea\n\notra", "", ""]
    good = "| fecha | total |\n| --- | --- |\n| 01/02/2020 | $ 5 |"
    bad = "| x | ~ | . | , | ; | : | a |\n|---|\n| | |"
    docs = spark.createDataFrame([(1, f"antes\n{good}\ndespués"), (2, f"antes\n{bad}\ndespués\n"), (3, "sin tabla \n\n\n\nx"), (4, None)], "k int, t string")
    got = dict(map(tuple, layout.flatten_tables(docs, "k", "t").collect()))
    assert got == {1: f"antes\n{good}\n\ndespués", 2: "antes\nx ~ . , ; : a\n\ndespués", 3: "sin tabla \n\n\n\nx", 4: ""}


def test_ranges(spark):
    rows = [("1,3,5-10", 12), ("2,2,1", 3), ("9-4", 12), ("13", 12), ("", 5), (None, 5), ("1-", 5), ("x", 5)]
    got = [v for (v,) in values(spark, rows, "s string, n int", ranges.parse_pages(F.col("s"), F.col("n")).alias("v"))]
    assert got == [[1, 3, 5, 6, 7, 8, 9, 10], [1, 2], None, None, None, None, None, None]
    rows = [("1", "", 3), ("", "2", 3), ("1", "2", 3), ("", "", 3), ("", "1-3", 3), (None, "2", 3)]
    got = [v for (v,) in values(spark, rows, "k string, r string, n int", ranges.pages_to_keep(F.col("n"), F.col("k"), F.col("r")).alias("v"))]
    assert got == [[1], [1, 3], None, None, None, [1, 3]]
    rows = [(0, None, 5), (7, 3, 10), (2, 99, 10), (10, 12, 5)]
    got = [v and tuple(v) for (v,) in values(spark, rows, "a int, b int, n int", ranges.normalize_range(F.col("a"), F.col("b"), F.col("n")).alias("v"))]
    assert got == [(1, 5), (7, 7), (2, 10), None]
    df = spark.createDataFrame([(1, 120), (2, 50), (3, 51), (4, 0)], "k int, n int")
    got = {(r["k"], r["page_from"], r["page_to"]) for r in ranges.suggest_ranges(df, "k", "n").collect()}
    assert got == {(1, 1, 50), (1, 51, 100), (1, 101, 120), (2, 1, 50), (3, 1, 50), (3, 51, 51)}


def test_documents(spark):
    df = spark.createDataFrame([(1, 0, "x"), (1, 1, None), (1, 2, " z "), (2, 0, "x"), (3, 0, " ")], "k int, o int, t string")
    assert dict(map(tuple, documents.banner_pages(df, "k", "o", "t").collect())) == {1: "--- Página 1/3 ---\nx\n\n--- Página 3/3 ---\nz", 2: "x", 3: ""}
    assert dict(map(tuple, documents.merge_chunks(df, "k", "o", "t").collect())) == {1: "x\n\n---\n\nz\n", 2: "x\n", 3: None}
    texts = spark.createDataFrame([(1, "a\n\n---\n\nb"), (2, "t\n## h\nc"), (3, "solo"), (4, None), (5, "a\n---\n \n---\nb")], "k int, t string")
    got = {(r["k"], r["id"], r["content"]) for r in documents.split_sections(texts, "k", "t").collect()}
    assert got == {(1, "0", "a"), (1, "1", "b"), (2, "0", "t"), (2, "1", "## h\nc"), (3, "0", "solo"), (5, "0", "a"), (5, "1", "---\nb")}
    kept = dict(map(tuple, documents.keep_sections(texts, "k", "t", F.array(F.lit("1"))).collect()))
    assert kept == {1: "b\n", 2: "## h\nc\n", 3: None, 4: "", 5: "---\nb\n"}
    pages = {(r["k"], r["index"], r["markdown"]) for r in documents.split_pages(texts, "k", "t").collect()}
    assert pages == {(1, 0, "a"), (1, 1, "b")}


def test_layout(spark):
    points = spark.createDataFrame([(1, x) for x in (1, 2, 3, 10, 11, 30)], "k int, x int")
    assert [r["centre"] for r in layout.cluster_positions(points, ["k"], "x", 4).orderBy("cluster").collect()] == [2, 10, 30]
    flags = spark.createDataFrame([(1, i, bool(f)) for i, f in enumerate((1, 1, 0, 1, 1, 1))], "k int, i int, f boolean")
    assert [layout.longest_run(flags, ["k"], "i", F.col("f"), n).first()["run"] for n in (3, 4)] == [3, 0]
    words = spark.createDataFrame([(c,) for c in (50.0, 100.0, 250.0, -5.0)], "left double").withColumn("width", F.lit(0.0))
    assert [r["col"] for r in layout.assign_columns(words, [0, 100, 200]).collect()] == [0, 1, 1, 1]
    cells = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "1"), (2, 0, 0, "a"), (3, 0, 0, ""), (3, 1, 0, "1"), (3, 1, 1, "2"), (3, 2, 0, "3"), (3, 2, 1, None)], "t int, r int, c int, v string")
    got = dict(map(tuple, layout.cells_to_markdown(cells, "t", "r", "c", "v").collect()))
    assert got == {1: "| a | b |\n| --- | --- |\n| 1 |  |", 2: "", 3: "| 1 | 2 |\n| --- | --- |\n| 3 |  |"}
    rows = [(1, 0, 0, 0, i, float(i), c, t) for i, (c, t) in enumerate([(-1.0, "a"), (10.0, "b"), (28.0, "c"), (50.0, " ")])]
    lines = layout.layout_lines(spark.createDataFrame(rows, "page_id int, block int, par int, line int, pos int, left double, conf double, text string"))
    assert [r["text"] for r in lines.collect()] == ["a c"]


def test_candidates(spark):
    df = spark.createDataFrame([(1, 0, 5.0, "a"), (1, 1, 5.0, "b"), (1, 2, 4.0, "c")], "p int, o int, s double, v string")
    assert candidates.best_candidate(df, "p", "s", "o", "v").first()["v"] == "a"
    votes = spark.createDataFrame([(1, "texto largo uno dos", "b"), (1, "texto largo uno dos", "a"), (1, "corto", "c"), (2, "x", "a")], "p int, t string, who string")
    assert [tuple(r) for r in candidates.vote(votes, "p", "t", "who").collect()] == [(1, "texto largo uno dos", "parallel:a+b")]


def test_jobs(spark):
    rows = [("processing", 9.0), ("processing", 7.0), ("queued", 181.0), ("queued", 10.0), ("completed", 999.0), ("paused", None)]
    got = [v for (v,) in values(spark, rows, "s string, m double", jobs.reconcile(F.col("s"), F.col("m"), F.lit(False), F.lit(True)).alias("v"))]
    assert got == ["failed", "processing", "cancelled", "requeued", "completed", "cancelled"]
    states = spark.createDataFrame([(f"j{i:02}", "completed", f"2024-01-{i % 28 + 1:02}") for i in range(31)] + [("q", "queued", "2025")], "job_id string, status string, updated_at string")
    saved = states.limit(0).select("job_id", F.col("updated_at").alias("completed_at"))
    assert jobs.history(saved, states).count() == 30
    times = [("2024-01-02T00:00:00Z", None), ("", "2024-01-01T00:00:00+00:00"), ("nonsense", None), (None, None)]
    got = [v for (v,) in values(spark, times, "u string, c string", jobs.state_time(F.col("u"), F.col("c")).isNotNull().alias("v"))]
    assert got == [True, True, False, False]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.pdf", b"%PDF"), ("b.txt", b"no"), ("C.PNG", b"png"), ("big.jpg", b"x" * 50)):
        (tmp_path / "in" / name).write_bytes(data)
    files = readers.documents(spark, str(tmp_path / "in"), max_bytes=20)
    assert sorted(r["suffix"] for r in files.collect()) == ["pdf", "png"]
    (tmp_path / "jobs").mkdir()
    (tmp_path / "jobs" / "a.json").write_text('{"job_id": "a", "status": "queued"}')
    (tmp_path / "jobs" / "b.json").write_text("{nonsense")
    (tmp_path / "jobs" / "c.json").write_text("[]")
    assert [r["job_id"] for r in readers.job_states(spark, str(tmp_path / "jobs")).collect()] == ["a"]
    writers.write_results(spark.createDataFrame([("j1", "# T"), ("j2", "")], "job_id string, markdown string"), str(tmp_path / "out"))
    got = {r["job_id"]: r["value"] for r in spark.read.text(str(tmp_path / "out" / "md"), wholetext=True).collect()}
    assert got["j1"].strip() == "# T" and got["j2"].strip() == "# Resultado OCR"
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "j7.md").write_text("# uno\n\ndos")
    assert [tuple(r) for r in readers.markdown_files(spark, str(tmp_path / "texts")).collect()] == [("j7", "# uno\n\ndos")]
    for status in ("queued", "completed"):
        row = [("a", status, 1, 2, f"2024-01-0{len(status)}", "2024-01-01")]
        writers.append_states(spark.createDataFrame(row, "job_id string, status string, progress int, pages_total int, updated_at string, created_at string"), str(tmp_path / "log"))
    log = spark.read.schema(readers.JOB_SCHEMA).json(str(tmp_path / "log"))
    assert [r["status"] for r in jobs.latest_states(log, "job_id", "updated_at", "status").collect()] == ["completed"]
    pages = readers.page_batches(spark.createDataFrame([("d", 10), ("e", None)], "k string, n int"), "k", "n")
    assert pages.count() == 11 and pages.agg(F.max("batch")).first()[0] == 1
    out = readers.with_engine(pages, lambda pdf: pdf.assign(text="fake")[["k", "page", "text"]], "k string, page int, text string")
    assert {r["text"] for r in out.collect()} == {"fake"}
    full = values(spark, [("a", "a\n\n---\n\nb", 2), (None, "b", 2), ("a", "b", 1)], "s string, j string, n int", writers.full_markdown(F.col("s"), F.col("j"), F.col("n")).alias("v"))
    assert [v for (v,) in full] == ["a\n\n---\n\nb", "b", "a"]


@pytest.mark.parametrize("text", ["", "x", "a\n\n---\n\nb\n\n---\n\nc"])
def test_split_then_join_gives_the_text(spark, text):
    df = spark.createDataFrame([(1, text)], "k int, t string")
    pages = documents.split_pages(df, "k", "t")
    joined = documents.join_pages(pages, "k", "index", "markdown").collect()
    assert not joined or joined[0]["markdown"] == text


def job_events():
    rng = random.Random(11)
    start = datetime(2024, 1, 1)
    rows = [(rng.choice("aaaab"), start + timedelta(seconds=rng.randrange(40_000)), i) for i in range(1500)]
    return rows + [(None, start + timedelta(seconds=rng.randrange(900)), 2000 + i) for i in range(20)] + [("a", None, 3000), ("c", None, 3001)]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_open_circuits_spread_a_provider(spark, kind):
    rows = job_events()
    table = spark.createDataFrame(rows, "p string, t timestamp, i long").withColumn("t", F.col("t").cast(kind))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = jobs.open_circuits(table.where("i % 20 = 0").select("p", "t"), table.where("i % 20 <> 0"), "p", "t", 300).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {i: any(i2 % 20 == 0 and p2 == p and t and t2 and timedelta(0) <= t - t2 < timedelta(seconds=300) for p2, t2, i2 in rows) for p, t, i in rows if i % 20}
    assert {r["i"]: r["disabled"] for r in out} == want and len(out) == len(want) and 0 < sum(want.values()) < len(want)
    assert len({r["task"] for r in out if r["p"] == "a"}) > 1


def test_throttled_streams_a_key(spark):
    rows = job_events()
    out = jobs.throttled(spark.createDataFrame(rows, "p string, t timestamp, i long").repartition(5), "p", "t", "i", 60)
    want, last = set(), {}
    for p, t, i in sorted((r for r in rows if r[1]), key=lambda r: r[1:]):
        if p not in last or t - last[p] >= timedelta(seconds=60):
            last[p] = t
            want.add((p, i))
    found = [tuple(r) for r in out.collect()]
    assert set(found) == want and len(found) == len(want)
    assert "collect_list" not in out._jdf.queryExecution().toString()  # no row holds a whole key


def test_runs_of_code_and_long_chains(spark):
    words = ("abcdefgh " * 20_000).strip()  # a level of recursion for each word would end the stack
    assert one(spark, [words, "abcde fghij klmno", "x " + "A1b2" * 12 + " y", None, "ab cdefg hijkl mnopq rstuv wxyzabcdef 1"], C.remove_base64) == [" ", "abcde fghij klmno", "x   y", "", "ab cdefg hijkl mnopq rstuv wxyzabcdef 1"]
    chain = "ab " * 20_000 + "cd"
    assert one(spark, [chain, "12." * 9000 + "34", "ab " * 11 + "cd"], P.is_stamp_line) == [True, False, False]
    assert one(spark, ["FIRMA SELLO NOTARIAL de FIRMA SELLO NOTARIAL DE MEXICO"], C.strip_watermarks) == ["de FIRMA SELLO NOTARIAL DE MEXICO"]


def test_tables_of_rows(spark):
    cast = lambda c: F.col(c).cast("array<array<string>>")
    tables_ = [[["", ""], ["a", " "], ["", ""], ["b", ""], [""]], [], [["x"]], [["", ""]]]
    got = [v for (v,) in values(spark, [(t,) for t in tables_], "t array<array<string>>", T2.trim_edges(cast("t")).alias("v"))]
    assert got == [[["a"], [""], ["b"]], [], [["x"]], []]
    head = [["Fecha", ""], ["Nombre", "Total"], ["", "x"], ["1", "2", "3", "4", "5"], ["6", "7", "8"]]
    plain = [["a", "b"], ["c", "d"]]
    got = [v for (v,) in values(spark, [(head,), (plain,)], "t array<array<string>>", T2.merge_header(cast("t")).alias("v"))]
    assert got == [[["Fecha", "Nombre", "Total", "x"], ["1", "2", "3", "4 5"], ["6", "7", "8", ""]], plain]
    got = [v for (v,) in values(spark, [([["a", "b|c"], ["", ""], ["1"]],), ([["a"]],)], "t array<array<string>>", T2.rows_to_markdown(cast("t")).alias("v"))]
    assert got == ["| a | b/c |\n| --- | --- |\n| 1 |  |", ""]
    got = [tuple(v) for (v,) in values(spark, [([[1.0, 5.0], [3.0, 2.0]],), (None,), ([[1.0]],)], "p array<array<double>>", T2.box_to_xyxy(F.col("p")).alias("v"))]
    assert got == [(1.0, 2.0, 3.0, 5.0), (0.0,) * 4, (0.0,) * 4]
    assert [v for (v,) in values(spark, [([0, 10, 100, 120, 300],)], "b array<int>", T2.merge_narrow(F.col("b"), F.lit(300)).alias("v"))] == [[0, 100, 300]]
    assert [v for (v,) in values(spark, [([5, 8, 20, 21, 40],)], "b array<int>", T2.spaced(F.col("b"), F.lit(12)).alias("v"))] == [[5, 20, 40]]
    assert [v for (v,) in values(spark, [(5.0,), (99.0,), (-1.0,)], "x double", T2.column_of(F.col("x"), F.array(F.lit(0), F.lit(10), F.lit(20))).alias("v"))] == [0, 1, 1]


def test_control(spark):
    events = spark.createDataFrame([("a", 1, "start", 1), ("a", 2, "enqueue", 2), ("a", 3, "start", 3), ("a", 4, "enqueue", 4), ("a", 5, "cancel", 5), ("b", 1, "enqueue", 6), (None, 1, "enqueue", 7), ("c", None, "enqueue", 8)], "k string, t int, c string, i int")
    got = [(r["i"], r["state"]) for r in control.lifecycle(events, "k", "t", "i", "c").orderBy("i").collect()]
    assert got == [(2, "queued"), (3, "processing"), (5, "cancelled"), (6, "queued")]
    files = spark.createDataFrame([("/a.pdf",)], "path string")
    states = spark.createDataFrame([(1, " /a.pdf"), (2, "/b.pdf"), (3, None), (4, "")], "job_id int, upload_path string")
    assert {r["job_id"] for r in control.missing_uploads(states, files).collect()} == {2, 3, 4}
    warnings = [v for (v,) in values(spark, [(["a", "", "b", "a", None],)], "w array<string>", assembly.distinct_warnings(F.col("w")).alias("v"))]
    assert warnings == [["a", "b"]]


def test_shared_folder(spark):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": "x"})

    with pytest.raises(ValueError):
        folders.shared_dir(Cluster)
    assert folders.shared_dir(spark).startswith("file:")


def test_rows_that_tie(spark):
    rows = spark.createDataFrame([(1, 1, True), (1, 2, True), (1, 2, True), (1, 3, True), (2, 1, True), (2, 1, False), (2, 2, True)], "k int, o int, f boolean")
    assert dict(map(tuple, layout.longest_run(rows, ["k"], "o", F.col("f"), 2).collect())) == {1: 4, 2: 2}
    twice = spark.createDataFrame([(1, "a\n| x |\n| y |\n# b"), (1, "a\n| x |\n| y |\n# b")], "k int, t string")
    kinds = [(r["kind"], r["lines"]) for r in documents.markdown_blocks(twice, "k", "t").orderBy("block").collect()]
    assert kinds == [("paragraph", 2), ("table", 4), ("heading1", 1), ("heading1", 1)]  # lines of one number stand together
    cells = [("Fecha", 0.0), ("Fecha", 0.0), ("Concepto", 200.0), ("Importe", 400.0)]
    words = [(1, 0, 0, left, 50.0, t) for t, left in cells] + [(1, r, k, 200.0 * k, 50.0, f"v{r}{k}") for r in range(1, 9) for k in range(3)]
    table = tables.header_tables(spark.createDataFrame(words, "page_id int, row int, pos int, left double, width double, text string"), spark.createDataFrame([(1, 600)], "page_id int, width int"))
    head = table.first()["markdown"].split("\n")[0]
    assert head == "| Fecha | Fecha | Concepto | Importe |"


def test_readings_by_mode(spark):
    score = lambda t: F.length(t).cast("double")
    offered = {
        1: [("quick", 0, "x" * 50, 0.0), ("base", 0, "y" * 90, 0.0)],  # good at once
        2: [("quick", 0, "x" * 40, 0.0), ("base", 0, "y" * 40, 0.0), ("soft", 0, "z" * 40, 0.0)],  # too short: the first of equal ones
        3: [("quick", 0, "x" * 40, 0.0), ("plain", 0, "y" * 90, 0.0)],  # enough in a range
        4: [("quick", 0, "x", 0.0), ("soft", 1, "y" * 90, 0.0)],  # enough in bulk
        5: [("quick", 0, "", 90.0), ("soft", 1, "y", 0.0), ("strong", 0, "z" * 9, 0.0)],  # bulk takes what it can, two variants
        6: [("quick", 0, "x" * 60, 0.0), ("quick", 1, "y" * 60, 0.0), ("base", 0, "z" * 90, 0.0)],  # fast: quick readings alone
        7: [("quick", 0, "x" * 90, 0.0), ("fine", 4, "y", 9.0), ("base", 0, "z" * 9, 0.0)],  # quality: all but quick
        8: [("quick", 0, "x" * 30, 0.0), ("base", 1, "y" * 3, 0.0)], 9: [("base", 4, "y", 0.0)], 10: [],
    }
    modes = {3: ("balanced", False, True), 4: ("balanced", True, False), 5: ("quality", True, False), 6: ("fast", False, False), 7: ("quality", False, False)}
    pages = spark.createDataFrame([(k, *modes.get(k, ("balanced", False, False))) for k in offered], "page_id int, mode string, bulk boolean, is_range boolean")
    rows = spark.createDataFrame([(k, *o) for k, v in offered.items() for o in v], "page_id int, variant string, config int, text string, confidence double")
    out = {r["page_id"]: (r["variant"], r["config"], r["early"]) for r in candidates.read_by_mode(rows, pages, "page_id", score).collect()}
    assert out == {
        1: ("quick", 0, True), 2: ("base", 0, False), 3: ("quick", 0, True), 4: ("quick", 0, True), 5: ("soft", 1, False), 6: ("quick", 0, False),
        7: ("fine", 4, False), 8: ("quick", 0, False), 9: (None, None, False), 10: (None, None, False),
    }


def test_readers_of_any_generation_see_whole_states(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/states"
    assert state_log.read_states(spark, folder) is None and state_log.compact(spark, folder) == 0
    add = lambda *rows: state_log.write_states(spark.createDataFrame(rows, "job_id string, status string"), folder)
    now = lambda: {r["job_id"]: r["status"] for r in state_log.read_states(spark, folder).collect()}
    assert [add(("a", "queued"), ("b", "queued"), (None, "lost")), add(("a", "processing"))] == [1, 2]
    assert now() == {"a": "processing", "b": "queued"}
    assert state_log.compact(spark, folder) == 1 and state_log.compact(spark, folder) == 1 and now() == {"a": "processing", "b": "queued"}
    add(("b", "failed"), ("c", "queued"))
    # a compaction that ends before its generation, and a write that does not end, change nothing
    monkeypatch.setattr(state_log._Files, "write", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        state_log.compact(spark, folder)
    monkeypatch.undo()
    (tmp_path / "states" / "log" / "9").mkdir()
    (tmp_path / "states" / "log" / "9" / "part-0.parquet").write_bytes(b"half")
    assert now() == {"a": "processing", "b": "failed", "c": "queued"}
    reader = state_log.read_states(spark, folder)  # of the first generation
    assert state_log.compact(spark, folder) == 2
    assert {r["job_id"]: r["status"] for r in reader.collect()} == now()
    assert add(("c", "completed")) == 10 and state_log.compact(spark, folder) == 3 and now() == {"a": "processing", "b": "failed", "c": "completed"}
    assert sorted(p.name for p in (tmp_path / "states" / "generations").glob("[0-9]*")) == ["2", "3"] and add(("d", "queued")) == 11
    stamps = {r["job_id"]: r["updated_at"] for r in state_log.read_states(spark, folder).collect()}
    assert stamps["a"] < stamps["c"]
    # another's compaction came first: its snapshot holds
    monkeypatch.setattr(state_log._Files, "write", lambda *_: False)
    assert state_log.compact(spark, folder) == 3 and now()["d"] == "queued"
    monkeypatch.undo()
    files = state_log._Files(spark, folder)
    assert files.claim("claims/77") and not files.claim("claims/77")


def test_lines_that_are_no_states_are_kept(spark, tmp_path):
    lines = ['{"job_id": "a", "status": "queued", "pages_total": 3}', '{"job_id": ', "[1]", "7", '{"status": "x"}', "", '{"job_id": "b", "pages_total": "many"}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{tmp_path}/lines")
    got = {(r["job_id"], r["raw"], r["reason"]) for r in readers.rescued_states(spark, f"{tmp_path}/lines").collect()}
    assert got == {("a", None, None), (None, lines[1], "malformed"), (None, lines[2], "no object"), (None, lines[3], "no object"), (None, lines[4], "no job_id"), (None, lines[6], "wrong type")}


def test_lines_that_texts_hold(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abcé ", k=n))
    texts = [word(rng.randrange(5, 600)) for _ in range(12)] + ["", None, "zz" * 700]
    lines = [word(rng.choice([1, 2, 3, 5, 11, 12, 13, 40, 90])) for _ in range(150)] + [None, "z" * 300, "ZZ", "z" * 1500]
    for _ in range(60):
        t = rng.choice(texts[:12])
        n = rng.choice([2, 8, 12, 30, 81, 100, 200])
        k = rng.randrange(max(1, len(t) - n))
        lines += [t[k : k + n].upper(), t[k : k + n] + "x", "x" + t[k : k + n]]
    keys = {x for x in ((line or "").strip().lower() for line in lines) if len(x) >= 2}
    whole = [(t or "").lower() for t in texts]

    def held(k):
        grams = [k[i : i + 12] for i in range(0, len(k) - 11, 4)] if 12 <= len(k) <= 80 else []
        return any(g in t for g in [k, *grams] for t in whole)

    main = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = documents.lines_not_in(spark.createDataFrame([(x,) for x in lines], "line string").repartition(4), main, "line", "i", "t")
    assert {r["key"] for r in out.collect()} == {k for k in keys if not held(k)}
    assert documents.lines_not_in(spark.createDataFrame([("ab",)], "line string"), main.limit(0), "line", "i", "t").count() == 1
    assert documents.lines_not_in(spark.createDataFrame([], "line string"), main, "line", "i", "t").count() == 0


def test_counts_without_arrays_and_one_stripping_in_a_branch(spark):
    texts = ["", "x", "xx xöx_1\n\n x", "🙂a🙂", "ünï² ١ x", " \n", "a\n \t\nb\x0bc", "**_x_** [l](u)"]
    t = spark.createDataFrame([(x,) for x in texts], "t string").select("t", T.strip(F.col("t")).alias("p"))
    kind = S.QUALITY_CHARS
    same = t.select(
        T.count_chars(F.col("t"), kind) == F.regexp_count("t", F.lit(kind)), T.count_words(F.col("t")) == F.regexp_count("t", F.lit(T.WORD)),
        (F.col("p") != "").cast("int") + F.regexp_count("p", F.lit(r"\n\s*+")) == F.regexp_count("p", F.lit(r"[^\n]*\S[^\n]*")),
    )
    assert all(all(r) for r in same.collect())
    plan = t.select(F.when(F.col("t") == "", 0.0).otherwise(S.text_quality_score(F.col("t"))).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("{2,}") == 1


def test_watermarks_work_a_line_out_once(spark):
    t = spark.createDataFrame([("a",)], "t string")
    plan = t.select(C.strip_watermarks(F.col("t")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\s{2,}") == 1
    texts = ["Texto largo que sigue y sigue sin final 01/02/20 10:11:12 JUAN PEREZ fin", "palabra " * 13 + "  x  20.30.40.50.60.70.80.90 y", "JUAN PEREZ\n\n\n\nab  c", "de de de de de de de de de de de de de", "TRIBUNAL DE LO CIVIL", None]
    assert one(spark, texts, C.strip_watermarks) == ["Texto largo que sigue y sigue sin final fin", "palabra " * 13 + "x y", "ab c", "", "TRIBUNAL DE LO CIVIL", ""]


def test_the_cleaner_strips_a_line_once(spark):
    t = spark.createDataFrame([("a",)], "t string")
    plan = lambda f: t.select(f(F.col("t")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(C.is_stamp_gibberish).count(r"^\s+|\s+$") == 1
    assert plan(P.is_stamp_line).count(r"^\s+|\s+$") == 1


def times_in_plan(df, part):
    return df._jdf.queryExecution().optimizedPlan().toString().count(part)


def test_tables_are_taken_apart_once(spark):
    """A table's lines are split once for its quality and score, its rows too; the marks of the whole text count for its lines."""
    rows = [(1, 0, "| fecha | total |\n| --- | --- |\n| 01/02/2020 | $ 5 |"), (1, 1, "fecha 01/02/2020 $ 5\n| cosa | otra |\n| --- | --- |\n| valor | cinco |"), (2, 0, "nada"), (3, 0, None)]
    candidates = spark.createDataFrame(rows, "page_id long, ordinal int, markdown string")
    best = tables.best_tables(candidates)
    assert times_in_plan(best, "split(") <= 3
    assert times_in_plan(tables.best_table(candidates), "split(") <= 6
    got = {(r["page_id"], r["position"]): r["score"] for r in best.collect()}
    assert list(got) == [(1, 0)] and got[1, 0] == pytest.approx(3 * 0.8 + 24 + 18 + 22)
    other = candidates.where("ordinal = 1").select(S.score_table_markdown(F.col("markdown")).alias("s")).first()["s"]
    assert other == pytest.approx(3 * 0.8)  # what stands outside the table's lines raises its quality only


def test_texts_are_rewritten_once(spark):
    """Annotations and paragraphs: a line or text is worked out once for all that is asked of it; steps that cannot match are left out."""
    d = spark.createDataFrame([("a  b\n\nX-12 34\n",), ("",), (None,)], "t string")
    notes = d.select("t", C.format_annotations(F.split("t", "\n", -1)).alias("b"))
    assert times_in_plan(notes, "regexp_replace(") <= 1
    assert times_in_plan(notes.select(C.append_annotations(F.col("t"), F.col("b")).alias("v")), "regexp_replace(") <= 3
    assert times_in_plan(d.select(C.structure_markdown(F.col("t")).alias("v")), "split(") <= 5
    assert times_in_plan(d.select(T.strip_markdown_syntax(F.col("t")).alias("v")), "regexp_replace(") <= 9
    assert one(spark, ["| a |\n|:-:|\n*b* _c_ [x](y)\n\n\n---\n\n# d\r\re\ff"], T.strip_markdown_syntax) == ["a \n\nb c x\n\nd\n\ne\n\nf"]


def test_words_of_talk_are_part_of_what_the_patterns_find(spark):
    meta = [
        "ESTE PDF contiene", "el documento que compartes", "Información personal sensible", "riesgo de privacidad", "no tengo forma de verificar", "digitalización autorizada", "independientemente del contexto",
        "personas físicas identificables", "AQUÍ está", "a continuación te presento", "he detectado", "he analizado", "he identificado", "puedo explicar", "si deseas un resumen", "¿quieres revisión", "analisis de cláusulas",
        "revisar las clausulas", "estructura general de un contrato", "requisitos legales de este tipo", "I'm happy to help", "i am able to review", "thıs iſ a", "here's ocr", "Here is the contract", "como ia", "nota: que ia", "transcripcion del documento",
    ]
    no = ["not able to transcribe", "privacy and security", "IDENTITY THEFT", "facilitate fraud", "no estoy en capacidad", "recomiendo usar los canales oficiales", "puedo orientarte", "análisis legal", "redactar o revisar cláusulas", "contrato de estructura"]
    found = lambda pattern: lambda t: t.rlike(pattern)
    assert one(spark, meta, K.is_meta_line) == one(spark, meta, found(K.META)) and all(one(spark, meta, K.is_meta_line))
    assert one(spark, no, K.refuses) == one(spark, no, found(K.REFUSALS)) == [True] * 9 + [False]
    d = spark.createDataFrame([("x\n puedo ayudarte a redactar",)], "t string")
    assert times_in_plan(d.select(K.strip_chatter(F.col("t")).alias("v")), "split(") <= 3
    assert one(spark, ["\n puedo explicar la estructura y todo lo demás de este contrato" + " x" * 60, "a\n\n¿En qué más puedo ayudarte\nb"], K.strip_chatter) != ["", ""]


def test_files_are_written_without_a_process_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "FOLDER_FILES", 3)
    rows = [("pdf", f"á{i % 5}") for i in range(10)] + [("png", ""), ("png", "a\nb"), ("png", None), ("doc", "x"), (None, "x")]
    df = spark.createDataFrame(rows, "suffix string, x string").repartition(2)
    for folder in (tmp_path / "a", f"file://{tmp_path}/b"):
        writers.write_files(df, str(folder), "suffix", "x", ("pdf", "png"))
    for folder in (tmp_path / "a", tmp_path / "b"):
        files = [f for f in folder.rglob("*") if f.is_file()]
        assert sorted((f.suffix[1:], f.read_text()) for f in files) == sorted((s, x + "\n") for s, x in rows[:12])
        assert not [f for f in files if f.name.startswith(".")] and all(len(list(d.iterdir())) <= 3 for d in folder.iterdir())
        assert readers.documents(spark, f"file://{folder}/*").count() == 12
    writers.write_files(df.limit(0), f"{tmp_path}/c", "suffix", "x", ("pdf", "png"))
    assert readers.documents(spark, f"{tmp_path}/c/*").count() == 0


def test_queries_write_files_with_no_checksums_beside_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reading_queries, "_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    assert reading_queries.ingested_files(spark, "/root/testdata/sf0.001").count() > 0
    assert list((tmp_path / "files").rglob("*.pdf")) and not list((tmp_path / "files").rglob("*.crc"))


def test_only_lines_that_a_text_may_hold_are_looked_for(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    texts = [word(300) for _ in range(5)]
    lines = [word(rng.choice([9, 40, 80, 81, 400])).strip() for _ in range(400)] + [texts[0][10:30], texts[1][:200], texts[2][5:14], texts[3][40:120], texts[4][7:88] + "x"]
    main = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    asked = []
    monkeypatch.setattr(documents, "held_strings", lambda *a: asked.append(a[3].count()) or grams.held_strings(*a))
    ask = lambda: {r["key"] for r in documents.lines_not_in(spark.createDataFrame([(x,) for x in lines], "line string"), main, "line", "i", "t").collect()}
    got = ask()
    assert asked[0] < 100 and {x.strip() for x in lines[400:404]} & got == set() and lines[404].strip() in got
    monkeypatch.setattr(documents, "window_filter", lambda *a: None)
    assert ask() == got and asked[1] > 2000
    monkeypatch.setattr(documents, "window_filter", grams.window_filter)
    monkeypatch.setattr(grams, "SEGMENT", 50)
    assert ask() == got


def test_tables_of_words_take_one_shuffle_of_the_words(spark):
    rng = random.Random(9)
    rows = [(p, r, k, float(rng.randrange(0, 900, 7)), float(rng.choice([0, 10, 25, 60])), rng.choice(["a", "b|c", " ", "", None])) for p in range(40) for r in range(rng.randrange(1, 12)) for k in range(rng.randrange(1, 9))]
    rows += [(90, r, 0, 5.0, 2.0, t) for r in range(3) for t in "ba"] + [(91, 1, 0, 5.0, 2.0, "a"), (None, 2, 0, 1.0, 1.0, "x"), (92, 4, 1, None, 3.0, "y"), (92, None, 1, 4.0, 3.0, "z")]
    words = spark.createDataFrame(rows, "page_id int, row int, pos int, left double, width double, text string").repartition(3)
    pages = words.select("page_id").distinct().withColumn("width", F.when(F.col("page_id") % 3 == 0, 300.0).otherwise(1000.0))
    out = tables.cluster_tables(words, pages)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3
    bounds = tables.infer_bounds(words, pages)
    assert {r["page_id"]: len(r["bounds"]) for r in bounds.collect()}[90] == 2
    many = words.join(words.groupBy("page_id").agg(F.max("row").alias("m")).where("m >= 2").select("page_id"), "page_id", "left_semi")
    same = tables.rows_of_cells(many, bounds).select("page_id", T2.rows_to_markdown(T2.trim_edges(F.col("rows"))).alias("markdown"))
    got = {tuple(r) for r in out.collect()}
    assert got == {tuple(r) for r in same.collect()} and len(got) > 30


def test_words_and_good_words_come_from_one_pass(spark):
    rng = random.Random(2)
    texts = ["", None, "x", " x ", "xx xöx_1\n\n x", "🙂a🙂", "ñ", "aé", "_", "a_b", "__ab__ *cd*", "١٢٣٤ x", "𝒳𝒳𝒳𝒳 𝒳", "...", "a.", ".a", " " * 5000 + "a" * 5000, "a " * 4000, "# |" * 3000 + "fin", "xxxx " * 900]
    texts += ["".join(rng.choices("axé_ñÑ.1 \n*#🙂ü", k=rng.choice([3, 20, 200]))) for _ in range(300)]
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    good, word = rf"{S.WORD_CHAR}{{4,}}|{S.WORD_CHAR}*{S.ACCENT}{S.WORD_CHAR}*", T.WORD
    plain = T.strip(F.regexp_replace(T.whole(F.col("t")), r"[#*|_>`\[\]()\s]++", " "))
    p = t.select("t", plain.alias("p"), S.accent_words(F.col("t")).alias("w"))
    before = F.least(F.length("p"), F.lit(3000)) / 60 + F.least(F.regexp_count("p", F.lit(word)), F.lit(400)) / 10 + S.share(F.col("p"), good, word) * 20
    same = p.select(
        F.col("w.words") == F.regexp_count(T.whole(F.col("t")), F.lit(word)), F.col("w.good") == F.regexp_count(T.whole(F.col("t")), F.lit(good)),
        S.default_quality_score(F.col("t")) == before, S.default_quality_score(F.col("t"), F.col("w")) == before, S.word_accent_ratio(F.col("t")) == S.share(F.col("t"), good, word),
    )
    assert all(all(r) for r in same.collect())
    vote = candidates.vote(t.select(F.lit(1).alias("page"), "t", F.lit("a").alias("who")), "page", "t", "who")
    assert vote._jdf.queryExecution().optimizedPlan().toString().count("{3}") == 2


def test_runs_of_code_by_one_pattern(spark):
    """The pattern for long runs blanks what a look at each run would, also where runs touch or are too short."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abZ9+/ñ" if rng.random() < 0.1 else "abcdeZ9+/") for _ in range(rng.choice([1, 3, 4, 5, 5, 6, 7, 9, 12, 31, 33, 47, 48, 50])))
    gap = lambda: rng.choice([" ", " ", " ", "  ", "\n", ". ", ", ", "|", "-", " = " if rng.random() < 0.1 else " "])
    texts = ["".join(word() + gap() for _ in range(rng.randrange(1, 14))) for _ in range(1500)] + ["abcde fghij klmno pqrst", "abcde fghij klmno pqrst" + "u" * 16, "x=abcdefghi abcdefghi abcdefghi abcdefghi"]

    def each(m):
        return " " if len(re.sub(r"\s", "", m[0])) >= 36 else m[0]

    code = r"[A-Za-z0-9+/=]{48,}|(?:[A-Za-z0-9+/]{5,}+\s++(?=[A-Za-z0-9+/=]{5})){3,}+[A-Za-z0-9+/=]{5,}"
    assert one(spark, texts, C.remove_base64) == [re.sub(code, each, t) for t in texts]


def test_tests_of_lines_tried_only_where_they_may_hold(spark):
    """Plain counts and parts of phrases stand before tests that take longer; they rule out no line that these would take."""
    phrases = ["SELLO DIGITAL DEL CFDI", "ſello del sat", "Cadena Original del Complemento x", "NÚMERO de serie del certificado", "certificado de sello digital", "cadena original del TİMBRE", "complemento de certificacıón digital"]
    assert one(spark, [f"{p} A1" for p in phrases], C.is_seal_line) == [True] * 7
    boiler = ["Representación impresa de un CFDI entregada al cliente de la casa", "Persona moral grandes contribuyentes de la zona centro y norte", "HOJA  3 / 4"]
    assert one(spark, [*boiler, "una frase llana de prueba que se queda"], C.is_garbage_line) == [True, True, True, False]
    tails = ["Total 5 ſELLO DEL SAT: x", "Total 5 Hoja 3 / 4 x", "Total 5 NUMERO DE SERIE DEL CERTİFİCADO x", "Total 5 este documento es una representación impresa de un cfdi", "Total 5 persona moral grandes contribuyentes"]
    assert one(spark, tails, C.strip_inline_noise) == ["Total 5"] * 5
    few = ["a 1 b 2 c 3 d 4 e", "de la y el a los con un", "12 345 678 901 234 567 890 123 casa", "De, la. y: el; a no si lo perro gato"]
    assert one(spark, few, C.is_garbage_line) == [True, True, True, False]
    ratios = ["", "12 ab", "casa xyz", "bcd fgh", "xyzñ áb ábc ÑÑÑ", "bcdüfgh", None]
    assert one(spark, ratios, S.token_vowel_ratio) == [0.0, 0.0, 0.5, 0.0, 1 / 3, 0.0, 0.0]
    words = ["'casa',", "x9a1", "bcdf", "cása-b", "A1B2", "..", "ÁRBOL", "ñañ"]
    assert [len(v) for v in one(spark, words, C.meaningful_words)] == [int(v) for v in one(spark, words, lambda c: c.rlike(C.MEANINGFUL))]


def test_documents_are_cleaned_in_their_rows(spark):
    """Neither cleaning nor flattening shuffles, and a text is cleaned once, whether hard or gently."""
    docs = spark.createDataFrame([(1, "Primera frase de prueba larga\n" + "zz\n" * 10 + "Segunda frase de prueba larga", True), (2, None, None), (3, "zz\n# A\n" + "a\n" * 12 + "# Recibo de pago", False)], "k long, t string, h boolean")
    hard, gentle = "Primera frase de prueba larga\n\n> Sello o timbre omitido.\n\nSegunda frase de prueba larga", "> Sello o timbre omitido.\n\n# Recibo de pago"
    for df in (C.sanitize_documents(docs, "k", "t"), sanitized(docs, "k", "t", "h"), assembly.clean(docs, "k", "t"), layout.flatten_tables(docs, "k", "t")):
        plan = df._jdf.queryExecution().toString()
        assert "Exchange" not in plan and "Window" not in plan
    assert dict(map(tuple, sanitized(docs, "k", "t", "h").collect())) == {1: hard, 2: "", 3: gentle}
    pages = docs.select("k", F.lit(0).alias("index"), F.col("t").alias("markdown"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("digital"), F.lit(False).alias("ocr_sourced"))
    heads = docs.select("k", F.when(F.col("h"), "vision").otherwise("markitdown").alias("method"), F.lit(None).cast("string").alias("markdown"), F.array(F.lit("w")).alias("warnings"), F.lit(1).alias("size_bytes"), F.lit(False).alias("is_pdf"), F.lit(1).alias("file_pages"))
    out = assembly.assemble(heads, pages, "k")
    assert times_in_plan(out, "sellos\\s+y\\s+anotaciones") == 1
    assert {r["k"]: (r["markdown"], len(r["pages"]), r["total_pages"]) for r in out.collect()} == {1: (hard, 1, 1), 2: ("", 0, 0), 3: (gentle, 1, 1)}
