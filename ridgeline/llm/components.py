"""Connected components by repeated contraction, all of it in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of long ids -> (node, root) for every node of an edge; root is the smallest id that node can reach.

    Each round ranks the nodes by a hash of its own, points every node at the neighbour of the
    lowest rank below its own, jumps pointers once, and contracts the edges. Of nodes with a
    neighbour at most half keep the lowest rank around, whatever the order of the ids, so the
    number of rounds grows with the logarithm of the number of nodes. The last step looks up the
    smallest id of each component. Minima are pre-aggregated; joins are plain, so Spark can split
    a hot key. Loops, repeated edges, an empty input and null ends (ignored) are all fine.
    """
    e = staged(_tidy(edges.select("u", "v").where("u is not null and v is not null")))
    labels, turn = None, 0
    while not e.isEmpty():
        rank = lambda c, k=turn: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("rank"), F.col(c).alias("id"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = staged(both.groupBy("u").agg(F.min(rank("v")).alias("m")).select("u", F.least(rank("u"), "m")["id"].alias("p")))
        up = staged(near.join(near.select(F.col("u").alias("p"), F.col("p").alias("pp")), "p").select("u", F.col("pp").alias("p")))
        last = labels
        if labels is None:
            labels = staged(up.select(F.col("u").alias("node"), F.col("p").alias("root")))
        else:
            labels = staged(labels.join(up.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root")))
        a, b = up.select("u", F.col("p").alias("pu")), up.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        done = e
        e = staged(_tidy(e.join(a, "u").join(b, "v").select(F.col("pu").alias("u"), F.col("pv").alias("v"))))
        discard(near, up, done, last)
        turn += 1
    if labels is None:
        return edges.selectExpr("u as node", "v as root").limit(0)
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    out = staged(labels.join(least, "root").select("node", F.col("least").alias("root")))
    discard(labels, e)
    return out


def _tidy(e: DataFrame) -> DataFrame:
    return e.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
