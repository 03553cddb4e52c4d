"""Connected components of a graph given as a table of edges, by alternating star operations.

A large star points a node's larger neighbours to the smallest node in reach,
a small star does so for its smaller ones; both are an aggregation and a join,
so a node with very many neighbours is combined before it moves.  A few rounds
leave stars only.  The join tells nodes of very many neighbours apart: the few
there can be are broadcast (``store.meet``), so the centre of a large star is
not gathered by one task.  Each round is materialised; nothing is collected.

A graph of at most ``FEW`` edges, as counted, is done by one task instead: the
same components without the rounds.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship

from .store import cut, meet

FEW = 16384


def _union_find(batches):
    """All edges (u, v) of a small graph to (node, root)."""
    root: dict[int, int] = {}

    def up(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = up(root.setdefault(u, u)), up(root.setdefault(v, v))
            root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([up(x) for x in nodes], pa.int64())], ["node", "root"])


def _pull(edges: DataFrame, n: int) -> DataFrame:
    """edges (u, v) with m, the smallest node among u and its neighbours v of the given direction."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")).withColumn("m", F.least("m", "u"))
    return meet(edges.select("u", "v"), least, "u", "_n", n).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b longs); root: the smallest node of its component."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen, n = None, e.count()
    if n <= FEW:
        ship(e.sparkSession)
        return e.repartition(1).mapInArrow(_union_find, "node bigint, root bigint")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _pull(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _pull(large, n)
        e = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if mark == seen:
            break
        seen, n = mark, mark[0]
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
