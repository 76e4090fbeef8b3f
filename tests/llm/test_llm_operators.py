"""The training-data operators against brute force, round trips and their SQL, on small tables with awkward rows."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import bpe, chat, language_id, packing, permutation_index, quality, sharding, simhash, suffix_dedup, warc
from foliant.llm.components import components

P = pytest.importorskip("public_tokenizers")

LONG = " ".join(f"word{i % 97} x{i}" for i in range(3000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
TEXTS = [
    None, "", " ", "\n\n \t", "a", "one two three", "one two three", "ONE two\vthree", "é ß 日本語 💩", LONG, LONG, LONG + " end",
    "start " + PASSAGE + " middle " + PASSAGE, PASSAGE + " tail", "x" * 5000, "ab" * 700, "a b c " * 200, "line\nline\nline\n\nother",
    "don't we'll\r\n\r\n x", "x<|endoftext|>y", "a\t\t  b    y", "!!!???  ", "#### $$$ " * 30, "SHOUT LOUD " * 40,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, label string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], "s", None, 5, "clash") for i, t in enumerate(TEXTS)]
    rows += [(None, "null id", "en", None, 1, 1, "c"), (3, "repeated id", "en", "s", 1, 1, "c"), (3, "repeated id", "en", "s", 1, 1, "c")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def duck(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, pa.Table.from_pandas(df) if not isinstance(df, pa.Table) else df)
    return con.sql(sql).fetchall()


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# quality


def test_quality_matches_sql(docs, spark):
    out = quality.quality_report(docs).select("doc_id", *quality.METRICS, "base_failed", (~F.col("base_failed") & F.col("failed_rule").isNull()).alias("kept"))
    assert ordered(out.collect()) == ordered(duck(quality.OP1_SQL, documents=docs.toArrow()))


def test_quality_order_decides_no_result(docs, none):
    kept = [quality.quality_filter(docs, r).count() for r in (quality.RULES, quality.RULES[::-1])]
    assert kept[0] == kept[1] > 0
    assert {r.name for r in quality.order_rules(docs)} == {r.name for r in quality.RULES}
    assert quality.quality_report(none).count() == quality.quality_filter(none).count() == 0
    assert quality.quality_filter(docs).columns == docs.columns


# simhash


def test_fingerprints_and_components(docs, none):
    out = simhash.near_duplicate_classes(docs).collect()
    import xxhash

    def brute(text):
        w = (text or "").encode().lower().split()
        sh = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in sh) for b in range(64)]
        return sum((2 * c > len(sh)) << b for b, c in enumerate(counts))

    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = [(i, brute(t)) for i, t in texts]
    parent = list(range(len(want)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(want)):
        for b in range(a):
            if bin(want[a][1] ^ want[b][1]).count("1") <= 4:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(want):
        least[root(k)].append(i)
    low = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    expected = [(i, f, low[root(k)]) for k, (i, f) in enumerate(want)]
    assert ordered((r["doc_id"], r["fp0"] % (1 << 64), r["component_id"]) for r in out) == ordered(expected)
    assert simhash.near_duplicate_classes(none).count() == 0


@pytest.mark.parametrize("distances", [(4, 4), (11, 11)])
def test_all_links_are_found(spark, distances, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 150)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for x in base for k in (1, 3, distances[0], distances[0] + 1)]
    fps = np.array([*(int(x) for x in base), *near], object) % (1 << 64)
    fps = np.unique(fps.astype(np.uint64)).view(np.int64)
    monkeypatch.setattr(simhash, "SHARD_ROWS", 40)  # deep upper levels
    monkeypatch.setattr(simhash, "TASK_HOMES", 25)  # shards cut into grids
    monkeypatch.setattr(simhash, "TASK_VISITS", 60)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp0 long")
    found = {r["node"]: r["root"] for r in components(simhash.link_fingerprints(df, 1, distances)).collect()}
    u = fps.view(np.uint64)
    forest = simhash.Forest(len(u))
    a, b = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= distances[0])
    forest.link(a, b)
    least = {}
    for x, k in zip(fps.tolist(), forest.label):
        least[k] = min(least.get(k, x), x)
    assert all(found.get(x, x) == least[k] for x, k in zip(fps.tolist(), forest.label))


def test_equal_first_lanes_are_linked(spark, monkeypatch):
    rng = np.random.default_rng(4)
    flip = lambda x, n: int(x) ^ sum(1 << int(b) for b in rng.choice(63, n, replace=False))
    fps = [[int(x) for x in rng.integers(0, 1 << 63, 4)] for _ in range(60)]
    fps += [[f[0], flip(f[1], n), flip(f[2], 1), f[3]] for f in fps[:40] for n in (1, 9, 10, 30)]  # fp0 is shared
    fps += [[flip(f[0], n), *f[1:]] for f in fps[:20] for n in (2, 4, 5)]
    fps = [tuple(f) for f in dict.fromkeys(map(tuple, fps))]
    monkeypatch.setattr(simhash, "SHARD_ROWS", 40)
    monkeypatch.setattr(simhash, "TASK_HOMES", 25)
    monkeypatch.setattr(simhash, "TASK_VISITS", 60)
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs)
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(fps)], "doc_id long, fp0 long, fp1 long, fp2 long, fp3 long")
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_classes(df, distances=(4, 10), lanes=4).collect()}
    u = np.array(fps, np.int64).view(np.uint64)
    d = np.bitwise_count(u[:, None] ^ u[None]).astype(int)
    forest = simhash.Forest(len(u))
    forest.link(*np.nonzero((d[:, :, 0] <= 4) & (d.sum(axis=2) <= 10)))
    assert found == dict(enumerate(forest.label.tolist())) and len(set(found.values())) < len(fps) - 100


def test_components_of_a_path(spark):
    n = 200
    links = spark.createDataFrame([((i * 37) % n, ((i + 1) * 37) % n) for i in range(n - 1)], "u long, v long")
    assert {r["root"] for r in components(links).collect()} == {0}


# chat


def test_preferences(spark):
    rows = [
        (0, 0, "system", "be kind"), (0, 1, "user", "hi"), (0, 2, "assistant", "hello"), (0, 3, "user", "bye"),
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "go away"),
        (2, 0, "user", "same"), (3, 0, "user", "same"), (4, None, None, None), (6, 0, "user", ""), (6, 0, "user", ""), (None, 0, "user", "lost"),
    ]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, pair_id string")
    pairs = spark.createDataFrame([(k, 2 * k, 2 * k + 1) for k in range(4)], "pair_id long, chosen_id long, rejected_id long")
    out = {r["pair_id"]: r for r in chat.preference_pairs(turns, pairs).collect()}
    assert out[0]["prompt"] == "<|system|>\nbe kind<|end|>\n<|user|>\nhi<|end|>\n" and out[0]["prompt_turns"] == 2
    assert out[0]["chosen"] == "<|assistant|>\nhello<|end|>\n<|user|>\nbye<|end|>\n"
    assert out[0]["chosen_mask"] == "0:14,1:13,0:20" and out[0]["chosen_trained"] == 13
    assert out[0]["rejected"] == "<|assistant|>\ngo away<|end|>\n"
    assert (out[1]["prompt_turns"], out[1]["chosen"], out[1]["rejected"]) == (1, "", "")
    assert out[2]["chosen"] == "<|unknown|>\n<|end|>\n" and out[2]["rejected"] == ""
    assert out[3]["chosen"].count("<|user|>") == 2
    for r in out.values():
        for side in ("chosen", "rejected"):
            assert sum(int(x.split(":")[1]) for x in r[f"{side}_mask"].split(",") if x) == len(r[side])
    got = chat.preference_pairs(turns, turns.where("conv_id IS NOT NULL").select(F.expr("conv_id div 2").alias("pair_id")).distinct().selectExpr("pair_id", "2 * pair_id AS chosen_id", "2 * pair_id + 1 AS rejected_id"))
    assert ordered(got.collect()) == ordered(duck(chat.OP3_SQL, conversations=turns.where("turn IS NOT NULL OR conv_id = 4").toArrow()))


# warc


def test_loser_tree():
    rng = random.Random(5)
    for k in range(1, 20):
        runs = [sorted(rng.choices(range(30), k=rng.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(sum(runs, []))


def test_warc_round_trip(spark):
    big = "<p>" + "größe " * 50 + "WARC/1.1\r\n\r\n\r\n</p>"
    rows = [(5, "http://WWW.Example.com:80/A?b#c", big), (3, "https://example.com/a", big), (9, None, big), (None, "http://x.org", big), (1, "http://x.org/ y\r\n", None),
            (2, "mailto:a", ""), (4, "http://x.org", "short"), (6, "http://x.org", "short"), (7, "http://x.org", "x" * 100), (7, "http://x.org", "x" * 100), (8, "http://x.org", "x" * 100)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, record_type int").repartition(4)
    out = warc.archive_pages(pages).collect()
    assert len(out) == len(rows)
    keys = [warc.order_key(tuple(r)) for r in out]
    assert keys == sorted(keys)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out)
    first = {big: 3, "x" * 100: 7}
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        again = h in first and i != first[h]
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None] += 1
    assert got == want
    assert {r["ts"] for r in out if r["page_id"] == 7} == {"2024-01-01T00:00:07Z"}
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert Counter(r["ts"] for r in warc.archive_pages(pages).collect()) == Counter(r["ts"] for r in out)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    order = [(r["url_key"], r["ts"], r["page_id"] is not None, r["page_id"] or 0) for r in out]
    assert order == sorted(order)
    assert warc.url_key("http://WWW.Example.com:80/A?b#c") == "com,example)/a?b"
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_of_any_ids(spark):
    ids = [2**63 - 1, -(2**63), -1, 10**13, 2**63 - 10, 0, 5, None]
    pages = spark.createDataFrame([(i, f"http://h/{(i or 0) % 3}", "x" * 150 if k % 2 else f"page {i}") for k, i in enumerate(ids)], "page_id long, url string, html string")
    out = warc.archive_pages(pages).collect()
    assert sorted(map(repr, (r["page_id"] for r in out))) == sorted(map(repr, ids))
    keys = [warc.order_key(tuple(r[c] for c in ("url_key", "ts", "page_id", "file", "offset"))) for r in out]
    assert keys == sorted(keys)
    assert all(r["ts"][:19] >= "2024" and r["ts"] < "2059" for r in out)
    assert {(r["page_id"], r["refers_to"]) for r in out if r["record_type"] == "revisit"} == {(10**13, -(2**63)), (0, -(2**63)), (None, -(2**63))}


def test_long_pages_get_files_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    monkeypatch.setattr(warc, "FILE_RECORDS", 40)
    rows = [(i, f"http://h/{i}", c * n) for i, (c, n) in enumerate([("a", 50)] * 60 + [("b", 5000), ("c", 300_000), ("d", 5100), ("e", 2_000_000)])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    out = warc.archive_pages(pages, str(tmp_path / "warc"))
    assert Counter((r["page_id"], r["payload_bytes"]) for r in out.collect()) == Counter((i, len(h)) for i, _, h in rows)
    sizes = [p.stat().st_size for p in (tmp_path / "warc").glob("part-*")]
    assert max(sizes) < 2_010_000 and sorted(sizes)[-3] < 60_000 and len(sizes) >= 5


# language ID


def test_languages(spark):
    rng = random.Random(1)
    stock = {"en": "the and of to in that was for with this".split(), "de": "und der die nicht das ist ein auf für über".split()}
    rows = []
    for i in range(600):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(rng.choices(stock[lang], k=30)), lang))
    rows += [(600, None, "en"), (601, "123 !!", "de"), (602, "", None), (None, "the and of", None), (603, "the of and", None), (604, "the of and", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    out = language_id.identified(df, language_id.fit_languages(df)).collect()
    assert all(r["lang_pred"] == r["lang"] and r["accepted"] for r in out if r["doc_id"] is not None and r["doc_id"] < 600)
    other = {r["doc_id"]: r for r in out if r["doc_id"] is None or r["doc_id"] >= 600}
    assert all(other[i]["lang_pred"] == "und" and not other[i]["accepted"] and other[i]["score"] == 0 for i in (600, 601, 602))
    assert other[None]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in out)
    empty = language_id.identified(df, language_id.fit_languages(df.limit(0)))
    assert {(r["lang_pred"], r["accepted"]) for r in empty.collect()} == {("und", False)}
    assert language_id.identified(df.limit(0), language_id.fit_languages(df)).count() == 0


def test_values_that_are_no_languages(spark):
    rows = [(i, f"the and of {i % 7}", "en" if i % 2 else f"junk {i}") for i in range(400)]
    model = language_id.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_languages=3)
    assert len(model.models.languages) <= 3 and "en" in model.models.languages


def test_kneser_ney_sums_to_one():
    model = language_id.KneserNey(3).fit({"x": Counter({"abab": 3, "abc": 1, "ca": 2})})
    total = 0.0
    for c in "abc ":  # continuations of " a", by scoring words "a", "aa", "ab", "ac" up to that place
        word = pa.array(["a" + c.strip()] if c.strip() else ["a"])
        chars, lengths = language_id.characters(word)
        logp, _ = model.score(word)
        head, _ = model.score(pa.array(["a"]))
        first = np.exp(_prefix(model, "a" + c.strip(), 2))
        total += first / np.exp(_prefix(model, "a", 1))
    # the rest belongs to unseen characters: the discounts of " a" (3/16), "a" (1/2) and the empty context (1/3), less 4/5000
    assert total + 3 / 16 / 2 / 3 * (1 - 4 / 5000) == pytest.approx(1.0, abs=1e-4)


class SlowKneserNey:
    """The same models from strings and dictionaries, one n-gram at a time."""

    def __init__(self, counts, order, d=0.75):
        self.order, self.d = order, d
        raw = [Counter() for _ in range(order + 1)]
        for word, times in counts.items():
            s = f" {word} "
            for i in range(1, len(s)):
                for n in range(1, min(order, i + 1) + 1):
                    raw[n][s[i - n + 1 : i + 1]] += times
        self.count = [Counter() for _ in range(order + 1)]
        self.count[order] = raw[order]
        for n in range(1, order):
            before = Counter(g[1:] for g in raw[n + 1])
            self.count[n] = Counter({g: before[g] or min(t, 1) for g, t in raw[n].items()})
        self.total = [Counter() for _ in range(order + 1)]
        self.kinds = [Counter() for _ in range(order + 1)]
        for n in range(1, order + 1):
            for g, t in self.count[n].items():
                self.total[n][g[:-1]] += t
                self.kinds[n][g[:-1]] += 1

    def p(self, gram):
        n = len(gram)
        context = gram[:-1]
        lower = self.p(gram[1:]) if n > 1 else 1 / 5000
        if not self.total[n][context]:
            return lower
        if n == 1 and gram not in self.count[1]:
            return np.exp(language_id._FLOOR)
        return (max(self.count[n][gram] - self.d, 0) + self.d * self.kinds[n][context] * lower) / self.total[n][context]

    def entropy(self, text):
        total = size = 0
        for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
            s = f" {word} "
            for i in range(1, len(s)):
                total -= np.log(self.p(s[max(0, i - self.order + 1) : i + 1]))
                size += 1
        return total / size if size else None


def test_languages_against_dictionaries(spark):
    rng = random.Random(3)
    stock = {"en": "the and of to in that was for with this".split(), "de": "und der die nicht das ist ein auf für über".split(), "xx": ["a", "zz", "ab", "über", "that"]}
    rows = [(i, " ".join(rng.choices(stock[lang], k=rng.randint(1, 60))), lang) for i, lang in enumerate(rng.choices(sorted(stock), k=200))]
    rows += [(900, LONG + " über der", None), (901, "THE Über 12 qqq", None), (902, None, "en"), (903, "the the", None), (903, "the the", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learned = [r for r in rows if r[2] and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5]
    slow = {}
    for lang in stock:
        slow[lang] = SlowKneserNey(Counter(w for _, t, x in learned if x == lang for w in t.split()), language_id.ORDER)
    model = language_id.fit_languages(df, 10**6, 0)
    texts = [r[1] for r in rows]
    got = model.models.entropies(pa.array(texts, pa.string()))
    assert model.models.languages == sorted(stock)
    for text, h in zip(texts, got):
        want = [slow[x].entropy(text) for x in sorted(stock)]
        assert np.isnan(h).all() if want[0] is None else h == pytest.approx(want, rel=1e-4)
    by_text = {r["text"]: r["lang_pred"] for r in language_id.identified(df, model).collect()}
    for text in texts:
        want = [slow[x].entropy(text) for x in sorted(stock)]
        if want[0] is None:
            assert by_text[text] == "und"
        elif sorted(want)[1] - min(want) > 1e-4:
            assert by_text[text] == sorted(stock)[int(np.argmin(want))]
    assert language_id.identified(df, model).count() == len(rows)


def _prefix(model, word, upto):
    """Log probability of the first `upto` characters after the leading space."""
    chars, lengths = language_id.characters(pa.array([word]))
    whole, previous = None, None
    for n, grams in enumerate(language_id.gram_hashes(chars, lengths, model.order)):
        at = np.minimum(np.searchsorted(model.keys[n], grams), len(model.keys[n]) - 1)
        hit = model.keys[n][at] == grams
        p = np.where(hit, model.prob[n][at, 0], np.nan)
        if n == 0:
            whole = np.where(np.isnan(p), language_id._FLOOR, p)
        else:
            backed = whole.copy()
            backed[1:] += previous[:-1]
            whole = np.where(np.isnan(p), backed, p)
        previous = np.where(hit, model.back[n][at, 0], 0)
    return whole[1 : upto + 1].sum()


# suffix dedup


def brute_spans(texts, size=200):
    coded = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + size] for b in coded for i in range(len(b) - size + 1))
    out = []
    for b in coded:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = True
        out.append(gone)
    return coded, out


@pytest.mark.parametrize("group_most", [10_000, 2])
def test_repeats_are_removed(docs, none, spark, monkeypatch, group_most):
    monkeypatch.setattr(suffix_dedup, "GROUP_MOST", group_most)
    rng = random.Random(7)
    passages = ["".join(rng.choices("abcdefgh ", k=n)) for n in (199, 200, 201, 450, 1200)]
    more = ["".join(rng.choices("abcdefgh ", k=rng.randrange(400))) + rng.choice(passages) + "".join(rng.choices("xyz", k=rng.randrange(300))) for _ in range(40)]
    df = docs.select("doc_id", "text", "shard").union(spark.createDataFrame([(1000 + i, t, 1) for i, t in enumerate(more)], "doc_id long, text string, shard int"))
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    coded, gone = brute_spans([t for _, t in rows])
    want = [(i, len(b), int(g.sum()), int((np.diff(g.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest()) for (i, _), b, g in zip(rows, coded, gone)]
    out = suffix_dedup.without_repeats(df).collect()
    got = [(r["doc_id"], r["n_bytes"], sum(s["b"] - s["a"] for s in r["removed"]), len(r["removed"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in out]
    assert ordered(got) == ordered(want)
    assert suffix_dedup.without_repeats(none).count() == 0


def test_long_texts_are_cut_into_overlapping_parts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT_BYTES", 500)
    text = "".join(random.Random(2).choices("abcdef ", k=3000))
    found = set()
    for data, ends, rows, begins in suffix_dedup.segments(pa.array([b"short", text.encode(), None], pa.binary())):
        h, place, lo, hi = suffix_dedup.anchors(data, ends)
        for a, b in zip(lo, hi):
            k = np.searchsorted(ends, a, "right")
            at = a - (ends[k - 1] if k else 0) + begins[k]
            assert rows[k] == 1
            found.update(range(at, at + b - a + 1))
    assert found == set(range(3000 - 200 + 1))


# packing


def test_packing(docs, none):
    pieces = packing.tokenized_pieces(docs, packing.public_paths())
    out = packing.pack(pieces).collect()
    tok = packing.tokenizer(*packing.public_paths()).whole
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        for k, (a, b) in enumerate([(0, first), *((s, s + 1024) for s in range(first, len(ids), 1024))]):
            want[r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(packing.tokenized_pieces(none, packing.public_paths())).count() == 0
    odd = pieces.select("*", *[F.lit("x").alias(c) for c in (*packing.INNER, "sequence_id", "offset", "label")])
    assert Counter((r["doc_id"], r["piece"], r["label"]) for r in packing.pack(odd).collect()) == Counter((r["doc_id"], r["piece"], "x") for r in out)


def test_plan_is_close_to_the_bound():
    rng = random.Random(3)
    for n in (0, 1, 50, 20_000):
        histogram = Counter(min(1024, int(rng.lognormvariate(5.5, 1.0)) + 1) for _ in range(n))
        plan, least = packing.pack_plan(dict(histogram))
        got = Counter()
        for pattern, k in plan:
            assert sum(pattern) <= 1024
            for x in pattern:
                got[x] += k
        assert got == histogram
        took = sum(k for _, k in plan)
        assert -(-sum(k * v for k, v in histogram.items()) // 1024) <= least <= took <= least * 1.002 + 3
        if n == 20_000:
            assert took < sum(packing.best_fit(dict(histogram), 1024).values())


def test_plan_where_content_is_no_bound():
    plan, least = packing.pack_plan({600: 10, 500: 9, 400: 3})  # 600 + 400, 500 + 500: ten pieces of 600 go apart
    assert sum(k for _, k in plan) == 15 and 10 <= least <= 15
    assert sorted(packing.pack_plan({1024: 3})[0]) == [((1024,), 3)] and packing.pack_plan({}) == ([], 0)


def test_plan_against_every_packing():
    rng = random.Random(5)

    def fewest(pieces, free=()):
        if not pieces:
            return len(free)
        x, rest = pieces[0], pieces[1:]
        options = [fewest(rest, (*free[:i], f - x, *free[i + 1 :])) for i, f in enumerate(free) if f >= x and f not in free[:i]]
        return min([*options, fewest(rest, (*free, 30 - x))])

    for _ in range(40):
        pieces = tuple(sorted((rng.randint(1, 30) for _ in range(7)), reverse=True))
        plan, least = packing.pack_plan(dict(Counter(pieces)), 30)
        assert least <= fewest(pieces) <= sum(k for _, k in plan) <= fewest(pieces) + 1


# BPE


def test_bpe_equals_tiktoken(docs, none):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ours = bpe.encoder(path, P.PATTERN)
    theirs = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(4)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices("abcäöé日 \n\t'.!", k=rng.randrange(80))) for _ in range(400)] + ["a" * 3000, "abc" * 900]
    for t, ids in zip(texts, ours.encode_batch(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(t)
        assert ours.decode(ids) == t.encode()
    for piece in ("a" * 1000, "ababab" * 90, "hello", "é日" * 60):
        assert ours.encode_long(piece.encode()) == theirs.encode_ordinary(piece) if len(ours.pattern.findall(piece)) == 1 else True
    out = bpe.encoded(docs, path, P.PATTERN).collect()
    assert len(out) == docs.count() and all(r["n_tokens"] == len(r["ids"]) for r in out)
    assert bpe.encoded(none, path, P.PATTERN).count() == 0


def test_bpe_keeps_no_state_between_batches(monkeypatch):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 2000)  # caches turn over
    ours = bpe.BytePairEncoder(bpe.read_ranks(path), P.PATTERN)
    theirs = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})
    rng = random.Random(9)
    ours.encode_batch(["a\n"])
    assert np.frombuffer(ours.encode_batch(["b \n c"])[0], "<u4").tolist() == theirs.encode_ordinary("b \n c")
    alphabets = ["ab \n", "ab \n\t", "aé日 \n\r\u3000\x85\xa0\x0b\x1c", "a1.' \n", "don't we'll 12 \n!!", " \n"]
    for _ in range(250):
        texts = ["".join(rng.choices(rng.choice(alphabets), k=rng.randrange(24))) for _ in range(200)]
        for t, ids in zip(texts, ours.encode_batch(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(t), t
            assert ours.decode(ids) == t.encode()


# nearest neighbours


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(permutation_index, "SHARD_ROWS", (400, 500))
    monkeypatch.setattr(permutation_index, "QUERY_ROWS", 40)
    monkeypatch.setattr(permutation_index, "PIVOTS", 200)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    x[100:400] = x[100]  # a common vector
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)]
    bad = [(5000, None, "e"), (5020, [0.0] * 16, "e"), (5040, [float("nan")] * 16, "e"), (5060, [1.0] * 15, "e"), (5080, [1.0] * 15 + [None], "e"), (None, [1.0] * 16, "e")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score string")
    out = defaultdict(list)
    for r in permutation_index.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    assert set(out) == set(range(0, 2000, 20))
    y, hit = x.astype(np.float64), 0
    for q, found in out.items():
        score = y @ y[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(2000), -score))[:20]
        assert [r for _, _, r in found] == list(range(1, 21)) and q not in [v for v, _, _ in found]
        assert all(s == pytest.approx(score[v], rel=1e-12) for v, s, _ in found)
        hit += len({v for v, _, _ in found} & set(best.tolist()))
    assert hit >= 0.9 * 20 * len(out)
    few = permutation_index.nearest(df.where("vec_id < 5"), df.where("vec_id < 2")).collect()
    assert len(few) == 8
    other = df.where("vec_id < 300").union(spark.createDataFrame([(9000 + i, [1.0, float(i)], "e") for i in range(40)], df.schema))
    out = permutation_index.nearest(other, other.where("vec_id = 9020")).collect()
    assert [(r["vec_id"], r["score"]) for r in out[:2]] == [(9039, 781.0), (9038, 761.0)] and len(out) == 20 and min(r["vec_id"] for r in out) > 9000
    huge = spark.createDataFrame([(0, [1e200, -1e200]), (1, [1e200, 1e200]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, [0.5, 0.0])], "vec_id long, embedding array<double>")
    out = permutation_index.nearest(huge, huge.where("vec_id = 0"), 4).collect()
    assert [r["vec_id"] for r in out] == [2, 4, 3, 1] and np.isnan(out[3]["score"])
    assert permutation_index.nearest(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("outlier", [0, 2, 5])
def test_nearest_of_varied_lengths(spark, monkeypatch, outlier):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64)) * np.exp(0.3 * rng.normal(size=(3000, 1)))
    if outlier:  # one vector longer than all others
        x[1234] *= outlier * np.linalg.norm(x, axis=1).max() / np.linalg.norm(x[1234])
    pivots, spread = [], permutation_index.spread_pivots
    monkeypatch.setattr(permutation_index, "spread_pivots", lambda *a: pivots.append(spread(*a)) or pivots[-1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out, hit = defaultdict(set), 0
    for r in permutation_index.nearest(df, df.where("vec_id % 40 = 0")).collect():
        out[r["query_id"]].add(r["vec_id"])
    for q in range(0, 3000, 40):
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(out[q] & set(np.argsort(-score)[:20].tolist()))
    assert len(pivots[-1]) == 3000 // permutation_index.PIVOT_ROWS and hit >= 0.9 * 20 * 75


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1", "check_l"])
def test_recall_on_queries_that_nothing_was_fitted_on(spark, size):
    folder = f"/root/testdata/{size}"
    if not os.path.exists(folder):
        pytest.skip("no such tables")
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").toArrow()
    ids, x = rows.column("vec_id").to_numpy(), np.array(rows.column("embedding").to_pylist(), np.float64)
    out = defaultdict(set)
    for r in permutation_index.op9_permutation_index(spark, folder).collect():
        out[r["query_id"]].add(r["vec_id"])
    asked = np.nonzero(ids % 20 == 0)[0]
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-score, 20, axis=1)[:, :20]
    hit = sum(len(out[q] & set(ids[b].tolist())) for q, b in zip(ids[asked].tolist(), best))
    assert hit >= 0.92 * 20 * len(asked)


def test_pivots_are_refilled():
    rng = np.random.default_rng(6)
    near = permutation_index.directions(np.ones(8) + 0.05 * rng.normal(size=(300, 8)))[0]
    assert len(permutation_index.spread_pivots(near, 100)) < 100
    assert len(permutation_index.spread_pivots(near, 100, permutation_index.ALIKE)) == 100
    assert len(permutation_index.spread_pivots(np.repeat(near[:3], 50, axis=0), 100, permutation_index.ALIKE)) == 3


# sharding


def test_shards(docs, none, spark):
    more = spark.createDataFrame([(100 + i, "hot" if i % 3 == 0 else f"t{i % 40}") for i in range(300)], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(more)
    out = sharding.shard_documents(df).collect()
    sizes = Counter(r["shard"] for r in out)
    assert len(out) == df.count() and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
    for s in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    text = {r["doc_id"]: r["text"] for r in more.collect()}
    spread = defaultdict(set)
    for r in out:
        if r["doc_id"] in text:
            spread[text[r["doc_id"]]].add(r["shard"])
    assert len(spread["hot"]) <= 4 and sum(len(v) > 1 for v in spread.values()) <= 6
    null = [r for r in out if r["size"] == 1 and r["text_crc32"] == 0]
    assert len(null) == 2  # the null text and the empty one
    assert sharding.shard_documents(none).count() == 0


def fewest_cuts(groups, quota):
    """The least number of pairs of one group in different shards, over all placements within the quotas."""
    states = {tuple(quota): 0}
    for n in groups:
        after = {}
        for free, cost in states.items():
            stack = [((), n)]
            while stack:
                taken, rest = stack.pop()
                if len(taken) == len(free):
                    if not rest:
                        cut = (n * n - sum(k * k for k in taken)) // 2
                        left = tuple(f - k for f, k in zip(free, taken))
                        after[left] = min(after.get(left, 10**9), cost + cut)
                    continue
                stack += [((*taken, k), rest - k) for k in range(min(rest, free[len(taken)]) + 1)]
        states = after
    return min(states.values())


@pytest.mark.parametrize("groups", [[4, 4, 4, 4], [5, 4, 3, 2, 1, 1, 1], [9, 2, 2, 2], [3, 3, 3, 3, 3]])
def test_few_links_are_cut(spark, groups):
    texts = [f"text é {g}" for g, n in enumerate(groups) for _ in range(n)]
    out = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=4).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in out} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in enumerate(texts)}
    by_group = defaultdict(Counter)
    for r in out:
        by_group[texts[r["doc_id"]]][r["shard"]] += 1
    cut = sum((sum(c.values()) ** 2 - sum(k * k for k in c.values())) // 2 for c in by_group.values())
    least = fewest_cuts(groups, sharding.quotas(len(texts), 4))
    assert least <= cut <= 2 * least + 4


def test_admitted_moves_keep_quotas():
    rng = random.Random(6)
    for _ in range(50):
        load = [rng.randrange(20) for _ in range(5)]
        quota = [x + rng.randrange(3) for x in load]
        asked = {(i, j): rng.randrange(1, 4) for i in range(5) for j in range(5) if i != j and rng.random() < 0.5 and load[i] > 12}
        given = sharding.admit(asked, [q - x for q, x in zip(quota, load)])
        after = [load[k] + sum(n for (_, j), n in given.items() if j == k) - sum(n for (i, _), n in given.items() if i == k) for k in range(5)]
        assert all(a <= q for a, q in zip(after, quota)) and all(0 <= n <= asked[k] for k, n in given.items())
