"""The pipeline against its parts worked out in plain Python."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from test_llm_operators import SlowKneserNey, brute_spans, duck

from foliant.llm import language_id, packing, quality, simhash, suffix_dedup
from foliant.llm.common import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = (docs, docs := stored(stage(spark, docs, SF), name))
    return out


def test_filters_keep_columns_and_clean_documents(stages, spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name in ("language_id", "quality_rules", "near_dedup", "suffix_dedup"):
        assert stages[name][1].columns == corpus_pipeline.COLUMNS
    before, after = ({r["doc_id"] for r in df.select("doc_id").collect()} for df in stages["quality_rules"])
    assert before == {r["doc_id"] for r in stages["language_id"][0].select("doc_id").collect()}
    assert not [i for i in after if labels.get(i) == 0]


def test_languages_are_accepted_as_by_dictionaries(stages):
    docs, out = stages["language_id"]
    part = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 40)) / (1 << 40)
    share = language_id.FIT_DOCS / (language_id.FIT_DOCS + language_id.CALIBRATION_DOCS)
    rows = docs.select("doc_id", "text", "lang", language_id.held_out(F.col("doc_id")).alias("out"), (part < share).alias("fits")).collect()
    known = [r for r in rows if r["lang"] and r["text"] is not None and not r["out"]]
    langs = sorted({r["lang"] for r in known if r["fits"]})
    words = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()
    slow = {x: SlowKneserNey(Counter(w for r in known if r["lang"] == x and r["fits"] for w in words(r["text"])), language_id.ORDER) for x in langs}
    limit = {x: np.quantile([h for r in known if r["lang"] == x and not r["fits"] if (h := slow[x].entropy(r["text"])) is not None], 1 - language_id.TAIL) * (1 + language_id.MARGIN) for x in langs}
    want, edge = set(), set()
    for r in rows:
        h = {x: slow[x].entropy(r["text"]) for x in langs}
        if h[langs[0]] is not None:
            best = min(langs, key=h.get)
            if h[best] <= limit[best]:
                want.add(r["doc_id"])
            if abs(h[best] - limit[best]) < 1e-4:
                edge.add(r["doc_id"])
    assert {r["doc_id"] for r in out.collect()} - edge == want - edge and len(want) > 150


def test_rules_reject_what_sql_does(stages):
    docs, out = stages["quality_rules"]
    want = Counter(r[0] for r in duck(f"SELECT doc_id FROM ({quality.OP1_SQL}) WHERE kept", documents=docs.toPandas()))
    assert Counter(r["doc_id"] for r in out.collect()) == want and 0 < len(want) < docs.count()


def test_repeated_strings_go_as_by_brute_force(stages):
    docs, out = stages["suffix_dedup"]
    rows = docs.collect()
    coded, gone = brute_spans([r["text"] for r in rows])
    want = Counter()
    for r, text, g in zip(rows, coded, gone):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(int), [0]])))
        spans = suffix_dedup.merged([suffix_dedup.whole_characters(text, a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())])
        at, kept = 0, b""
        for a, b in spans:
            kept, at = kept + text[at:a], b
        want[r["doc_id"], (kept + text[at:]).decode()] += 1
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == want


def test_stages_take_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, columns of other names and an empty table."""
    good = " ".join(r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' AND n_chars > 500").orderBy("doc_id").limit(3).collect())
    rows = [(None, None, None, None, None), (1, None, "en", "s", 1), (2, "", None, None, None), (3, good, None, None, None), (3, good, None, None, None), (None, good + " more", "en", None, 5), (4, good * 40, "en", "s", 2), (5, "🙂" * 300, "en", "s", 1)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    extra = [*(F.lit(7).alias(c) for c in ("row", "key", "score", "_rk", "_row", "spans", "piece", "length", "node"))]
    docs = spark.createDataFrame(rows, names).select("*", *extra)
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, SF)
            found = out.collect()
            if name != "packing":
                assert out.columns == corpus_pipeline.COLUMNS
                assert len(found) <= table.count()
            if name == "near_dedup" and found:  # one of those without words, one of the equal texts, and what is like neither
                assert sum(r["text"] == good for r in found) <= 1 and len(found) == len({simhash.shingle_set(r["text"] or "", 5).tobytes() for r in found})
            if name == "packing" and found:
                assert Counter(r["doc_id"] for r in found if r["piece"] == 0) == Counter(r[0] for r in rows)


def test_near_copies_go_and_others_stay(stages):
    def shingles(text):
        w = text.encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    before, after = ({r["doc_id"]: shingles(r["text"]) for r in df.collect()} for df in stages["near_dedup"])
    sim = lambda a, b: len(a & b) / len(a | b)
    for i in before.keys() - after.keys():
        assert max(sim(before[i], s) for j, s in before.items() if j != i) > 0.5
    ids = sorted(after)
    assert not [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sim(after[a], after[b]) >= 0.9]


@pytest.mark.parametrize("task_shingles", [4_000_000, 2000])  # a class in one task, and cut into a grid
def test_near_copies_are_those_of_similar_shingle_sets(spark, monkeypatch, task_shingles):
    monkeypatch.setattr(simhash, "TASK_SHINGLES", task_shingles)
    rng = np.random.default_rng(8)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    texts = []
    for k in range(120):
        base = words(int(rng.integers(60, 300)))
        texts.append(base)
        for part in (0.015, 0.02, 0.022, 0.025, 0.03, 0.04, 0.06):  # similarities on both sides of 0.8
            copy = list(base)
            for at in rng.choice(len(copy), max(1, int(part * len(copy))), replace=False):
                copy[at] = f"other{rng.integers(1 << 40)}"
            texts.append(copy)
        line = words(9) * 60  # repeats count once
        texts += [base + words(9) * 60, base + line] if k % 4 == 0 else []
    hub = words(200)
    texts += [[*hub[: 200 - n], *words(n)] for n in range(1, 60)] + [words(3), words(3), [], []]
    texts = [" ".join(t) for t in texts]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, SF).select("doc_id").collect()}
    own = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    forest, at_limit = simhash.Forest(len(own)), 0
    for a in range(len(own)):
        for b in range(a):
            sim = len(own[a] & own[b]) / len(own[a] | own[b])
            at_limit += 0.75 <= sim < 0.85
            if sim >= 0.8:
                forest.link(np.array([a]), np.array([b]))
    assert at_limit > 300
    assert found == set(forest.label.tolist())


def test_replacement_characters_of_the_input_stay(spark):
    passage = " ".join(f"shared{i}" for i in range(40))
    # é and è share their first byte, é and ĩ their second: these characters are cut in two and go as a whole
    texts = ["a � xé" + passage + "é 日 tail �", "otherĩ" + passage + "è end 💩"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.suffix_dedup(spark, df, SF).collect()}
    want = ["a � x 日 tail �", "other end 💩"]
    assert found == {i: (t, len(t)) for i, t in enumerate(want)}


def test_packed_pieces_hold_the_last_texts(stages):
    docs, pieces = stages["packing"]
    tok = packing.tokenizer(*packing.public_paths()).whole
    want = Counter()
    for r in docs.collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        for k, (s, n) in enumerate(packing.cut(len(ids))):
            want[r["doc_id"], k, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in pieces.collect()) == want


def test_no_class_of_the_tables_is_lost(spark):
    """The stage's classes against a prefix filter: sets of similarity 0.8 share one of their rarest fifth of shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = simhash.similar_classes(docs, corpus_pipeline.SHINGLE, corpus_pipeline.SIMILARITY, corpus_pipeline.LIMIT, corpus_pipeline.REACH)
    got = {r["doc_id"]: r["component_id"] for r in found.collect()}
    sets = {r["doc_id"]: simhash.shingle_set(r["text"] or "", corpus_pipeline.SHINGLE) for r in docs.collect()}
    times = Counter(x for s in sets.values() for x in s.tolist())
    posted, order = {}, sorted(sets)
    forest, place = simhash.Forest(len(order)), {i: k for k, i in enumerate(order)}
    for i in order:
        n = len(sets[i])
        prefix = sorted(sets[i].tolist(), key=lambda x: (times[x], x))[: n - int(np.ceil(0.8 * n)) + 1] if n else ["none"]
        for j in sorted({j for x in prefix for j in posted.get(x, ())}):
            a, b = sets[i], sets[j]
            if len(a) == len(b) == 0 or len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
                forest.link(np.array([place[i]]), np.array([place[j]]))
        for x in prefix:
            posted.setdefault(x, []).append(i)
    assert got == {i: order[forest.label[place[i]]] for i in order}
