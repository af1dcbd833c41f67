"""Nearest neighbours, periodic runs and the prefix trie against brute force, on random and on awkward input."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import neighbours, queries, runs, trie

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, v string, id int"


def exact(rows, ask, k):
    out = {}
    for i, v in rows.items():
        if ask(i):
            s = sorted((-float(np.dot(v, w)), j) for j, w in rows.items() if j != i)[:k]
            out[i] = [(j, -x) for x, j in s]
    return out


def found(d):
    out = collections.defaultdict(list)
    for r in sorted(d.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return dict(out)


def test_neighbours_are_exact_with_factor_one(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 60)
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    monkeypatch.setattr(neighbours, "LEAF", 8)
    g = np.random.default_rng(1)
    rows = {i: g.normal(size=6) * (1 + i % 3) for i in range(300)}
    rows |= {1000 + i: rows[5] for i in range(90)}  # a very common vector, in queries too
    d = spark.createDataFrame([(i, v.tolist(), "x", 0) for i, v in rows.items()], VECTORS)
    got, want = found(neighbours.nearest(d, F.col("vec_id") % 20 == 0, 5, 1.0)), exact(rows, lambda i: i % 20 == 0, 5)
    assert {q: [j for j, _ in x] for q, x in got.items()} == {q: [j for j, _ in x] for q, x in want.items()}
    assert all(a[1] == pytest.approx(b[1], rel=1e-12) for q in got for a, b in zip(got[q], want[q], strict=True))


def test_neighbours_of_awkward_rows(spark):
    one = [1.0, 0.0]
    rows = [(0, one), (0, one), (20, [0.0, 0.0]), (40, None), (60, [1.0, None]), (80, [float("nan"), 1.0]), (None, one), (1, [0.5, 0.5]), (3, one), (2, one), (100, [float("inf"), 1.0]), (120, [1.0]), (140, [])]
    d = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], VECTORS)
    assert found(neighbours.nearest(d, F.col("vec_id") % 20 == 0, 20)) == {0: [(2, 1.0), (3, 1.0), (1, 0.5)]}
    assert neighbours.nearest(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(d.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0  # no candidate


def test_neighbours_recall(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in v.collect()}
    got, want = found(queries.op11_neighbours(spark, SF)), exact(rows, lambda i: i % 20 == 0, 20)
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values()) and hits >= 0.95 * 20 * len(want)


def brute_runs(w, least):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, q, n) for (s, n), q in out.items())


def test_runs_by_brute_force():
    g = random.Random(5)
    for _ in range(300):
        docs = []
        for _ in range(g.randint(1, 4)):
            w = [str(g.randint(1, g.randint(1, 3))) for _ in range(g.randint(0, 50))]
            if len(w) > 4 and g.random() < 0.5:
                a, p = g.randrange(len(w)), g.randint(1, len(w) // 2)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            docs.append(w)
        least = g.choice([2, 4, 12])
        for w, (n, got, left) in zip(docs, runs._found([" ".join(w) for w in docs], least), strict=True):
            want = brute_runs(w, least)
            gone = {i for s, q, length in want for i in range(s + q, s + length)}
            assert n == len(w) and sorted((r["start"], r["period"], r["length"]) for r in got) == want
            assert left == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_awkward_rows(spark):
    texts = [None, "", " \t\n", "a " * 30, "a b c " * 3, "x " + "a b c " * 4 + "d", "ä b " * 20, "word " * 20000]
    d = spark.createDataFrame([(i, t, 1, "r") for i, t in enumerate(texts)] + [(None, "a " * 12, 1, "r"), (3, "a " * 30, 1, "r")], "doc_id long, text string, n_words int, runs string")
    got = [(r["doc_id"], [(x["start"], x["length"], x["period"]) for x in r["runs"]], r["collapsed"]) for r in runs.periodic_runs(d).collect()]
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0)) == [
        (0, [], ""), (1, [], ""), (2, [], ""), (3, [(0, 30, 1)], "a"), (3, [(0, 30, 1)], "a"), (4, [], "a b c a b c a b c"), (5, [(1, 12, 3)], "x a b c d"),
        (6, [(0, 20, 1)], "ä b"), (7, [(0, 20000, 1)], "word"), (None, [(0, 12, 1)], "a"),
    ]
    assert runs.periodic_runs(d.limit(0)).count() == 0


def test_query_of_runs_by_brute_force(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, SF).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        want = brute_runs(w, 12)
        gone = {i for s, q, n in want for i in range(s + q, s + n)}
        s, q, n = min(want, key=lambda r: (-r[2], r[0], r[1]), default=(None, None, None))
        lines = "".join(f"{s},{n},{q}\n" for s, q, n in want)
        assert got[doc_id] == (len(want), s, n, q, n and 1000 * n // q, sha(lines.encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def brute_trie(own):
    """own: conv_id -> its turns as (role, text)."""
    members = collections.defaultdict(list)
    for c, s in own.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children, leaves, saved = collections.Counter(k[:-1] for k in members if k), collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode().split()) if k else 0
    ends = lambda k, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(own[c]) == len(k)).encode()).hexdigest()
    return {(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], ends(k, m)) for k, m in members.items()}


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(d):
    rows = [tuple(r) for r in d.select(TRIE).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("shard", [8, 1 << 16])
def test_trie_by_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(trie, "PIECE", 3)
    g = random.Random(3)
    own = {c: [("u", g.choice("abc") * g.randint(1, 2) + " x") for _ in range(g.randint(1, 6))] for c in range(150)}
    own |= {200 + c: [("u", "a x")] for c in range(60)}  # a very common conversation
    rows = [(c, t, *x, "k", 1) for c, s in own.items() for t, x in enumerate(s)]
    g.shuffle(rows)
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string, id int")
    ids = spark.createDataFrame([(c,) for c in [*own, 300, 301, None]], "conv_id long")
    assert nodes(trie.prefix_trie(d, ids, shard)) == brute_trie(own | {300: [], 301: []})


def test_trie_of_awkward_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    d = spark.createDataFrame([(1, None, None, "b"), (1, 0, "u", None), (2, 1, "", "b"), (2, 2, "u", ""), (2, 2, "u", ""), (None, 0, "u", "a"), (3, 0, "u" * 10, "long " * 20000)], schema)
    assert nodes(trie.prefix_trie(d)) == brute_trie({1: [("", "b"), ("u", "")], 2: [("", "b"), ("u", ""), ("u", "")], 3: [("u" * 10, "long " * 20000)]})
    assert trie.prefix_trie(d.limit(0)).count() == 0
