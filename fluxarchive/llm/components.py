"""Connected components by contraction.

Each task contracts its edges to a forest and names every node's root there. A node that tasks name differently joins its
roots, and only those links go on to the next level. A node has at most one row a task, so a hub with any number of edges
is never one task's group. Names must be spread like hashes: then each level leaves a fraction of the nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, merge_join

MAX_LEVELS = 100
#: Edges that a task contracts at a time.
TASK_EDGES = 1_000_000


def _forest(edges: list[pa.RecordBatch]) -> pa.RecordBatch:
    """node, root: every node of the edges, with the least node that it reaches over them."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for b in edges:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, b_ = root(u), root(v)
            if a != b_:
                parent[max(a, b_)] = min(a, b_)
    nodes = list(parent)
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "root"])


def _contracted(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= TASK_EDGES:
                yield _forest(held)
                held, n = [], 0
        if held:
            yield _forest(held)

    return edges.select("u", "v").mapInArrow(run, "node bigint, root bigint")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: u, v (long). node, component: one node of the component, the same for all nodes that reach each other; every
    node that has an edge to another one. Only counts reach the driver."""
    edges, levels = edges.where("u <> v"), []
    while True:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("components did not settle")
        least = F.min("root").over(W.partitionBy("node"))  # rows of a node: one a task
        roots = scratch.write(_contracted(edges).withColumn("least", least), f"cc{len(levels)}")
        levels.append(roots.select("node", F.col("least").alias("component")).distinct())
        edges = roots.where("root <> least").select(F.col("root").alias("u"), F.col("least").alias("v")).distinct()
        if edges.isEmpty():
            break
    out = levels.pop()
    while levels:
        above = out.select(F.col("node").alias("component"), F.col("component").alias("__top"))
        below = levels.pop()
        out = merge_join(below, above, "component", "left").select("node", F.coalesce("__top", "component").alias("component"))
    return out
