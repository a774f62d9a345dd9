"""Connected components by distributed union-find.

Each task joins its share of the edges into local forests and passes on one edge for each node, from the node to its local
root; so a star or a clique, however many edges it has, leaves a task as a forest. The forests are merged level by level:
edges that share a node meet where that node's hash sends them, the node's roots are joined there, and the links between
roots, which are far fewer, make the next level. No level gathers all links, components or nodes into one task, and a node
that a third of all edges share is reduced to one edge for each task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import Stage

#: Edges that one local forest takes at a time, for the memory of a Python worker.
CHUNK = 2_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and their roots, the smallest node of each tree, of the edges (a, b). Vectorised union-find by pointer jumping."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            return nodes, nodes[root]
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        up = root[root]
        while not np.array_equal(up, root):
            root, up = up, up[up]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        e = np.concatenate(held)
        nodes, roots = forest(e[:, 0], e[:, 1])
        moved = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(roots[moved])], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            size += batch.num_rows
        if size >= CHUNK:
            out = flush()
            held, size = [np.column_stack([out.column(0).to_numpy(), out.column(1).to_numpy()])], out.num_rows
            if size > CHUNK // 2:  # a forest that large is passed on and merged at the next level
                yield out
                held, size = [], 0
    if size:
        yield flush()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, root of every node of ``edges`` (a, b, both long): the root is the smallest node of the component.

    Null ends, self-loops and repeated edges add nothing; a node of self-loops only has no row. No edges give no rows.
    """
    stage = Stage(spark, "components")
    pairs = edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    links = stage.cut(pairs.mapInArrow(_local, "a long, b long"))
    levels = []
    while True:
        low = stage.cut(links.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")))
        levels.append(low.select(F.col("a").alias("node"), F.col("low").alias("root")))
        # the node's other roots are linked to its smallest one; a root that has a root keeps that link
        more = links.join(low.where("low <> high").select("a", "low"), "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        roots = links.select(F.col("b").alias("a")).distinct()
        up = low.join(roots, "a", "left_semi").select("a", F.col("low").alias("b"))
        above = stage.cut(more.unionByName(up).distinct().mapInArrow(_local, "a long, b long"))
        stage.drop(links)
        links = above
        if links.isEmpty():
            break
    # from the top level down: a node's root is the root of its root
    found = levels[-1]
    for level in reversed(levels[:-1]):
        top = found.select(F.col("node").alias("root"), F.col("root").alias("_top"))
        down = level.join(top, "root", "left").select("node", F.coalesce("_top", "root").alias("root"))
        rest = found.join(level, "node", "left_anti")
        found = stage.cut(down.unionByName(rest))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).distinct()
