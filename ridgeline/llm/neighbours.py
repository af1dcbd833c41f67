"""Nearest neighbours by largest inner product: vantage-point trees per shard, their triangle-inequality pruning relaxed by a factor."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_sample, discard, small_batches, staged

#: Vectors of a shard, queries of a block, vectors of a tree's leaf, and how many vectors the tree that deals out shards is fitted on at most.
SHARD, BLOCK, LEAF, SAMPLE = 8192, 4096, 128, 20_000
#: Shards that the dealing tree can tell apart at most; larger ones are dealt out further by a hash.
LEAVES = 512


@dataclass
class Tree:
    """A vantage-point tree over points, in arrays by node: the vantage point, the largest distance to it among the inner
    half, the smallest among the outer, both children, and for leaves the stretch of `order` that holds their points."""

    points: np.ndarray
    order: np.ndarray
    vantage: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    child: np.ndarray
    span: np.ndarray


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to one point b."""
    d = a - b
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def build(points: np.ndarray, leaf: int = LEAF, tries: int = 4) -> Tree:
    """Each node's vantage point is that of a few of its points whose distances spread most; the nearer half of the node's
    points is the inner one, so equal distances cannot keep a node from being halved."""
    order, nodes, todo = np.arange(len(points)), [], [(0, len(points), -1, 0)]
    while todo:
        lo, hi, parent, side = todo.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][3][side] = at
        nodes.append([-1, 0.0, 0.0, [-1, -1], (lo, hi)])
        if hi - lo <= leaf:
            continue
        own = order[lo:hi]
        held = own[:: max(1, len(own) // 256)]
        vantage = max(own[:: max(1, len(own) // tries)][:tries], key=lambda v: distances(points[held], points[v]).std())
        d, half = distances(points[own], points[vantage]), (hi - lo + 1) // 2
        by = np.argpartition(d, half)
        order[lo:hi] = own[by]
        nodes[at][:3] = [vantage, d[by[:half]].max(), d[by[half:]].min()]
        todo += [(lo, lo + half, at, 0), (lo + half, hi, at, 1)]
    v, i, o, c, s = zip(*nodes, strict=True)
    return Tree(points, order, np.array(v), np.array(i), np.array(o), np.array(c).reshape(-1, 2), np.array(s).reshape(-1, 2))


def _reachable(tree: Tree, node: int, d: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the inner and the outer half can hold a point within `far` of queries at distances d from the vantage point."""
    return d - far <= tree.inner[node], d + far >= tree.outer[node]


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, k: int, factor: float, best: tuple[np.ndarray, np.ndarray] | None = None, lift: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids), each queries x k, of the largest inner products found, best first, ties to the smaller id; -inf and -1 fill up.

    Points and queries are lifted(): their inner product is that of the original vectors, and of
    two points the nearer to a query has the larger one. A half is passed over if the triangle
    inequality leaves no room in it for a point within `factor` times the distance of the k-th best
    so far; with a factor of one that is exact search. All queries walk down together, each to its
    nearer half first. lift is the square of the points' common length.
    """
    scores, found = best or (np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1, np.int64))
    squares = np.einsum("ij,ij->i", queries, queries) + lift
    todo: list[tuple[int, np.ndarray, np.ndarray | None]] = [(0, np.arange(len(queries)), None)]
    while todo:
        node, q, bound = todo.pop()
        if bound is not None:  # of a farther half: what can be reached now that the nearer one is known
            q = q[bound <= factor * _radius(squares[q], scores[q, -1])]
        if not len(q):
            continue
        if tree.child[node, 0] < 0:
            own = tree.order[slice(*tree.span[node])]
            there = queries[q] @ tree.points[own].T
            better = np.flatnonzero(there.max(1) >= scores[q, -1])
            q = q[better]
            s = np.hstack([scores[q], there[better]])
            i = np.hstack([found[q], np.broadcast_to(ids[own], (len(q), len(own)))])
            if len(q) and s.shape[1] > 2 * k:  # all that ties with the k-th best stays, so that ids can decide
                least = np.partition(s, -k, axis=1)[:, -k, None]
                many = int((s >= least).sum(1).max())
                if many < s.shape[1]:
                    pick = np.argpartition(s, -many, axis=1)[:, -many:]
                    s, i = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)
            by = np.lexsort((i, -s), axis=1)[:, :k]
            scores[q], found[q] = np.take_along_axis(s, by, 1), np.take_along_axis(i, by, 1)
            continue
        d = distances(queries[q], tree.points[tree.vantage[node]])
        near = 2 * d <= tree.inner[node] + tree.outer[node]
        inner, outer = tree.child[node]
        todo += [(outer, q[near], tree.outer[node] - d[near]), (inner, q[~near], d[~near] - tree.inner[node]), (outer, q[~near], None), (inner, q[near], None)]
    return scores, found


def _radius(squares: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Distance of a lifted point with this inner product; `squares` is the sum of both squared lengths. Without a score it has no end."""
    return np.sqrt(np.maximum(squares - 2 * np.where(np.isfinite(score), score, -np.inf), 0))


def lifted(vectors: np.ndarray, square: float | None) -> np.ndarray:
    """One more coordinate that brings all candidates to the squared length `square`, so that the largest inner product is the
    nearest point; a query's (square None) is 0."""
    more = np.zeros(len(vectors)) if square is None else np.sqrt(np.maximum(square - np.einsum("ij,ij->i", vectors, vectors), 0))
    return np.column_stack([vectors, more])


def leaf_of(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The leaf node that each point falls into."""
    at = np.zeros(len(points), int)
    while (open_ := tree.child[at, 0] >= 0).any():
        for node in np.unique(at[open_]):
            own = np.flatnonzero(at == node)
            near = 2 * distances(points[own], tree.points[tree.vantage[node]]) <= tree.inner[node] + tree.outer[node]
            at[own] = np.where(near, *tree.child[node])
    return at


def reached(tree: Tree, points: np.ndarray, far: np.ndarray) -> list[np.ndarray]:
    """For each query the leaves that can hold a point within `far`. A leaf's halves end where leaf_of() deals points out: in the middle."""
    out: list[list[int]] = [[] for _ in points]
    todo = [(0, np.arange(len(points)))]
    while todo:
        node, q = todo.pop()
        if tree.child[node, 0] < 0:
            for x in q.tolist():
                out[x].append(node)
        elif len(q):
            d, middle = distances(points[q], tree.points[tree.vantage[node]]), (tree.inner[node] + tree.outer[node]) / 2
            todo += [(tree.child[node, 0], q[d - far[q] <= middle]), (tree.child[node, 1], q[d + far[q] >= middle])]
    return [np.array(x, np.int32) for x in out]


def usable(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding) -> (id, v): one vector of doubles for each id.

    Null, empty and zero vectors, those with null or non-finite components and rows without id take
    no part, nor do vectors of another length than most have (of several such, the largest). Of an
    id with several vectors the least counts.
    """
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(v, lambda x: x != 0)
    known = vectors.select(F.col("vec_id").cast("long").alias("id"), F.when(fine, v).alias("v")).where("id is not null and v is not null")
    length = known.groupBy(F.size("v").alias("n")).count().agg(F.max_by("n", F.struct("count", "n")).alias("n")).first()["n"]
    return known.where(F.size("v") == F.lit(length)).groupBy("id").agg(F.min("v").alias("v"))


def _stacked(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, width))


#: What a search of a shard gives for each query of a block: the same length of scores and ids.
FOUND = "q long, v array<double>, scores array<double>, ids array<long>"


def _searched(k: int, factor: float, square: float):
    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(queries):
            return pd.DataFrame(columns=["q", "v", "scores", "ids"])
        x, q = _stacked(points["v"], 0), _stacked(queries["v"], 0)
        order = np.argsort(points["id"].to_numpy(), kind="stable")
        tree = build(lifted(x[order], square))
        best = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
        best[0][:, -1] = queries["least"].to_numpy()  # what the query's own shard has found already: only better ones count
        scores, ids = search(tree, points["id"].to_numpy()[order], lifted(q, None), k, factor, best, square)
        kept = ids >= 0
        return pd.DataFrame({"q": queries["q"], "v": queries["v"], "scores": [s[m] for s, m in zip(scores, kept, strict=True)], "ids": [i[m] for i, m in zip(ids, kept, strict=True)]})

    return run


def _in_shards(points: DataFrame, queries: DataFrame, k: int, factor: float, square: float) -> DataFrame:
    """points(leaf, id, v), queries(leaf, q, v, least) -> FOUND rows, one for each query and shard it is sent to.

    A leaf with more vectors than a shard is dealt out by a hash, and its queries go to each part; many
    queries go in blocks, and the shard to each of them.
    """
    ns = {c: {r["leaf"]: r["count"] for r in d.groupBy("leaf").count().collect()} for c, d in (("p", points), ("q", queries))}
    parts = {leaf: (math.ceil(n / SHARD), math.ceil(ns["q"].get(leaf, 0) / BLOCK)) for leaf, n in ns["p"].items()}
    many = lambda k: F.coalesce(F.get(F.lit([parts.get(x, (1, 1))[k] or 1 for x in range(max(parts, default=0) + 1)]), F.col("leaf")), F.lit(1))
    dealt = lambda key, k: F.pmod(F.xxhash64(key), many(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), many(k) - 1))
    x = points.select("leaf", dealt("id", 0).alias("part"), every(1).alias("block"), "id", "v")
    y = queries.select("leaf", every(0).alias("part"), dealt("q", 1).alias("block"), "q", "v", "least")
    keys = ["leaf", "part", "block"]
    return x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInPandas(_searched(k, factor, square), FOUND)


def nearest(vectors: DataFrame, asked: Column, k: int = 20, factor: float = 0.35, salt: int = 0) -> DataFrame:
    """vectors(vec_id, embedding) -> (query_id, rank, vec_id, score) of the k largest inner products, in double precision, of each
    row where `asked` holds with all rows but itself; ties to the smaller vec_id, all candidates if there are fewer.

    Equal vectors are searched for once, and once as candidates: of each the k + 1 smallest ids
    stay, which any answer can do with. A tree fitted on SAMPLE vectors at most deals all of them out
    to leaves, leaves of any size to shards, and each shard has a tree of its own. A query is
    searched for in its own leaf first; what is found there bounds how far the search through the
    other leaves goes. factor 1 is exact; a smaller one passes over halves that are unlikely to help.
    What takes no part is said by usable(). Further columns are ignored; without rows the result is empty.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    all_ = staged(usable(vectors))
    firsts = Window.partitionBy("v").orderBy("id")
    copies = all_.withColumn("nth", F.row_number().over(firsts)).where(F.col("nth") <= k + 1)
    groups = staged(copies.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("members")).select(F.get("members", F.lit(0)).alias("id"), "v", "members"))
    queries = staged(all_.join(vectors.where(asked).select(F.col("vec_id").cast("long").alias("id")).distinct(), "id", "left_semi").join(groups.select("v", F.col("id").alias("q")), "v").select("id", "q", "v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, square = groups.agg(F.count("*"), F.coalesce(F.max(total), F.lit(0.0))).first()
    square = square * (1 + 1e-9)
    sample = np.array([r["v"] for r in bounded_sample(groups.select("id", "v"), "id", SAMPLE).collect()], float)
    router = build(lifted(sample, square), max(1, math.ceil(len(sample) / min(LEAVES, max(1, math.ceil(n / SHARD)))))) if len(sample) else build(np.zeros((1, 1)))

    def placed(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.array(b.column(1).flatten()).reshape(len(b), -1)
                yield pa.RecordBatch.from_arrays([pa.array(leaf_of(router, lifted(x, None if query else square)).astype(np.int32)), b.column(0), b.column(1)], ["leaf", "q" if query else "id", "v"])

        return run

    points = staged(groups.select("id", "v").mapInArrow(placed(False), "leaf int, id long, v array<double>"))
    own = queries.select("q", "v").distinct().mapInArrow(placed(True), "leaf int, q long, v array<double>").withColumn("least", F.lit(-math.inf))
    own = staged(own)
    first = staged(_in_shards(points, own, k + 1, factor, square))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, least, home = np.array(b.column("v").flatten()).reshape(len(b), -1), np.array(b.column("least")), np.array(b.column("leaf"))
            q = lifted(x, None)
            to = reached(router, q, factor * _radius(np.einsum("ij,ij->i", q, q) + square, least))
            at = np.repeat(np.arange(len(b)), [len(t) for t in to])
            leaf = np.concatenate([np.zeros(0, np.int32), *to])
            away = leaf != home[at]
            taken = pa.array(at[away])
            yield pa.RecordBatch.from_arrays([pa.array(leaf[away]), *(b.column(c).take(taken) for c in ("q", "v", "least"))], ["leaf", "q", "v", "least"])

    order = lambda x, y: F.when(x["s"] > y["s"], -1).when(x["s"] < y["s"], 1).when(x["i"] < y["i"], -1).when(x["i"] > y["i"], 1).otherwise(0)

    def merged(found: DataFrame, more: int) -> DataFrame:
        pairs = F.arrays_zip(F.col("scores").alias("s"), F.col("ids").alias("i"))
        return found.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list(pairs)), order), 1, more).alias("top"))

    known = merged(first, k + 1).select("q", F.when(F.size("top") > k, F.get("top", F.lit(k))["s"]).otherwise(F.lit(-math.inf)).alias("least"))
    others = staged(own.drop("least").join(known, "q").mapInArrow(spread, "leaf int, q long, v array<double>, least double"))
    second = _in_shards(points, others, k + 1, factor, square)
    top = staged(merged(first.unionByName(second), k + 1))
    each = top.select("q", F.explode("top").alias("t")).select("q", F.col("t.s").alias("s"), F.col("t.i").alias("id")).join(groups.select("id", "members"), "id")
    ids = F.flatten(F.collect_list(F.transform("members", lambda i: F.struct(F.col("s").alias("s"), i.alias("i")))))
    answers = each.groupBy("q").agg(F.slice(F.array_sort(ids, order), 1, k + 1).alias("top"))
    out = queries.select("id", "q").join(answers, "q").select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("top", lambda t: t["i"] != F.col("id")), 1, k)).alias("at", "t"))
    out = staged(out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.i").alias("vec_id"), F.col("t.s").alias("score")))
    discard(all_, groups, queries, points, own, first, others, top)
    return out
