"""Connected components of an edge table, by alternating large and small stars.

First a union-find contracts what LOCAL edges, a task's share, link among themselves; if
there are no more edges, that is all. Otherwise each round links every node to the smallest
node it knows of; labels travel over joins and pre-aggregated minima, and each round's edges
are written to shared storage, so nothing is collected. Nodes that hold more than a thousandth of the edges
are joined by broadcast where their edges lie, so a hub's edges stay spread over tasks.

Cases: loops and repeated edges change nothing; edges with a null end are dropped; an
empty table gives an empty result; other columns than a and b are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_keys, materialise, remove, trim

#: Edges that one task contracts.
LOCAL = 250_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b): large stars link each larger neighbour to a node's minimum,
    small stars each smaller one and the node itself. Replaces ``edges``."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")), "lowest")
    linked = join_keys(both, lowest, "a", "n")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b")))
    out = materialise(out.where("a <> b").distinct(), "edges")
    remove(lowest)
    remove(edges)
    return out


def _forest(edges: DataFrame, tasks: int) -> DataFrame:
    """(node, root) from a union-find over the edges of each of ``tasks`` partitions; a root is
    the least node of what its partition links."""

    def scan(batches):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while (up := root.get(top, top)) != top:
                top = up
            while x != top:
                root[x], x = top, root[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(a), find(b)
                root[max(x, y)] = root[min(x, y)] = min(x, y)
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["a", "b"])
        trim()

    return edges.coalesce(tasks).mapInArrow(scan, "a long, b long")


def components(edges: DataFrame, rounds: int = 60, local: int = LOCAL) -> DataFrame:
    """(node, component): for every node with an edge, its component's least node."""
    edges = materialise(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    tasks = max(1, -(-edges.count() // local))
    forest = materialise(_forest(edges, tasks), "components")
    remove(edges)
    if tasks == 1:
        return forest.toDF("node", "component")
    edges, state = materialise(forest.where("a <> b").distinct(), "edges"), None
    for _ in range(rounds):
        edges = _star(_star(edges, True), False)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == state:
            named = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
            found = materialise(named, "components")
            remove(edges)
            remove(forest)
            return found
        state = now
    raise RuntimeError("components did not settle")
