"""Filter audits, exact search by KD-trees and prefix tries against brute force and their SQL, with awkward rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from foliant.llm import interactions, kd_tree, prefix_trie, registry

NAMES = ["op11_kd_tree_search", "op12_filter_interactions", "op13_prefix_trie"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    assert spark_rows(registry.QUERIES[name](spark, folder)) == duck_rows(registry.ORACLES[name], folder)


# filter audits


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    known = []
    for i, text, part in docs:
        t = text or ""
        w = t.encode().split()
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t],
        }
        known.append((part or "", fails, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in known}:
        mine = [x[1:] for x in known if x[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                redundant = sum(x[0][f] and any(x[0][g] for g in order[: step - 1]) for x in mine)
                unique = sum(x[0][f] and sum(x[0].values()) == 1 for x in mine)
                out[part, "".join(order), step] = (len(left), len(gone), redundant, unique, sum(x[1] for x in gone), sum(x[2] for x in gone))
                shapley[part, f] += len(gone)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_against_every_order(spark):
    rng = random.Random(1)
    stock = ["plain words " * 30, "A B C D " * 40, "x # y " * 30, "", None, " ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}" for i in range(60)), "cafeé " * 10, "a\x0bb\x0cc\td\re\n" * 12, "  " * 80, "z" * 300_000]
    docs = [(rng.choice([*range(60), None]), rng.choice(stock), rng.choice(["s", "t", "", None])) for _ in range(150)]
    labels = [(rng.choice([*range(60), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(80)]
    df = spark.createDataFrame([(*r, 7, 8) for r in docs], "doc_id long, text string, source string, part int, mask int").repartition(4)
    known = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, source string")
    out = interactions.audit_filters(df, known)
    assert {tuple(r) for r in out.collect()} == brute_audit(docs, [x for x in labels if x[0] is not None])
    assert out.count() == 3 * 600 and out.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert interactions.audit_filters(df.limit(0), known).count() == 0
    assert interactions.audit_filters(df, known.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


# KD-trees


def brute_products(rows, k):
    """rows: id and vector, or None; the smallest vector of a repeated id asks."""
    whole = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in whole:
        if i % 100 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = set()
    for q, v in asked.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))[:k]
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("clustered", [False, True])
def test_search_is_exact(spark, monkeypatch, clustered):
    monkeypatch.setattr(kd_tree, "SHARD_LEAST", 100)
    monkeypatch.setattr(kd_tree, "SHARD_BYTES", 8 * 6 * 150)  # cells of several shards
    monkeypatch.setattr(kd_tree, "QUERY_ROWS", 7)
    monkeypatch.setattr(kd_tree, "LEAF", 8)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 6)) * 0.3 + (rng.integers(0, 6, (1500, 1)) if clustered else 0)
    x[200:700] = x[200]  # a common vector, with ties by the hundred
    x[900:950] = 0
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(2000, None), (2100, [float("nan")] * 6), (2200, [float("inf")] + [1.0] * 5), (2300, [None] + [1.0] * 5), (None, [1.0] * 6)]
    rows += [(2400 + 50 * i, [0.5, float(i)]) for i in range(8)] + [(3000, []), (3001, []), (300, rows[5][1]), (7, rows[7][1]), (2800, [-1e4] * 6), (2900, [1.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, rank int, score string").repartition(5)
    out = kd_tree.top_products(df, F.col("vec_id") % 100 == 0)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_products(rows, 10)
    assert kd_tree.top_products(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (100, [1.0, 1.0]), (101, [2.0, 2.0]), (102, [3e6, -3e6])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in kd_tree.top_products(huge, F.col("vec_id") % 100 == 0).collect()] == [(100, 1, 101, 4 << 20)]


def test_boxes_prune_what_cannot_be_asked_for():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(4000, 4)) * 50 + 1000 * rng.integers(-4, 5, (4000, 1))).astype(np.int64)
    tree = kd_tree.KDTree(np.arange(4000), x, 10)
    for (a, b), low, high in zip(tree.span, tree.low, tree.high):
        assert (tree.points[a:b].min(axis=0) == low).all() and (tree.points[a:b].max(axis=0) == high).all()
    visits, walk = [], tree._walk

    class Counting(np.ndarray):
        def __matmul__(self, other):
            visits.append(len(self))
            return np.asarray(self) @ np.asarray(other)

    q = x[:20].astype(float)
    reach = kd_tree.bounds(q, tree.low.astype(float), tree.high.astype(float))
    for i in range(20):
        ids, best = walk(q[i], reach[i].tolist(), i, kd_tree._LOWEST, tree.points.astype(float).view(Counting))
        score = x @ x[i]
        score[i] = -(1 << 60)
        assert ids.tolist() == np.lexsort((np.arange(4000), -score))[:10].tolist()
    assert sum(visits) < 0.2 * 20 * 4000


# prefix tries


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in own:
        base, h = c - int(np.fmod(c, 5)), zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in sorted(paths.items()):
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    for node, who in members.items():
        below = {n: w for n, w in members.items() if n[: len(node)] == node}
        out.append((
            who[0], len(node), members[node[:-1]][0] if node else None, len(who), sum(len(n) == len(node) + 1 for n in below),
            sum(not any(m[:-1] == n for m in members if m) for n in below), sum((len(w) - 1) * len(n[-1][1].encode()) for n, w in below.items() if n),
            hashlib.sha256(",".join(str(c) for c in who if paths[c] == node).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [4096, 3])
def test_trie_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rng = random.Random(2)
    for conversations, longest, words in ((60, 6, 2), (40, 25, 1), (9, 3, 3)):
        rows = []
        for _ in range(conversations):
            c = rng.choice([rng.randrange(-12, 80), rng.randrange(10**17, 10**17 + 30)])
            if any(r[0] == c for r in rows):
                continue
            role, start = rng.choice(["user", None]), rng.randrange(3)
            rows += [(c, None if k == 0 and start == 0 else start + k, role if k % 2 else "assistant", rng.choice(["", None, "é", "text"][: words + 1])) for k in range(rng.randrange(1, longest))]
        rows += [rows[0], rows[0], (None, 0, "user", "lost")]  # rows that repeat
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, members string").repartition(5)
        out = prefix_trie.prefix_trie(df)
        assert sorted((tuple(r) for r in out.collect()), key=repr) == brute_trie(rows)
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


def test_trie_of_one_long_conversation_and_many_short_ones(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    rows = [(5, t, "user", f"t{t % 7}") for t in range(300)] + [(c, t, "user", f"t{t % 7}") for c in range(10, 40) for t in range(9)] + [(100, None, None, None)] * 3
    out = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute_trie(rows)


def test_conversations_without_turns_end_at_the_root(spark):
    given_up = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2][:4]  # they borrow from no one
    rows = [(c, t, "user", "x") for c in given_up for t in range(2)]
    out = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in out] == [(given_up[0], 0, None, 4, 0, 1, 0, hashlib.sha256(",".join(map(str, given_up)).encode()).hexdigest())]
