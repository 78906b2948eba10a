"""Connected components by alternating star steps, as joins and aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.session import cut


#: Edges a task holds at once while it shortens chains.
HELD = 1 << 20


def _stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Edges from every node to the smallest one that these edges reach."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u):]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(above := root[root], root):
            root = above
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    leaf = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[root[leaf]])], ["u", "v"])


def _shorten(batches):
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= HELD:
            yield _stars(*(np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1)))
            held, n = [], 0
    if n:
        yield _stars(*(np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1)))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, root)``, root the smallest node reached.

    Every round links nodes to the smallest neighbour (larger neighbours first,
    then smaller ones), which ends in stars after O(log^2 n) rounds. A node's
    neighbours are only ever aggregated with ``min``; no adjacency list is
    collected, so a hub costs partial aggregates and a skew-split join. Chains
    take most rounds, so tasks first turn the edges they hold (dealt by range,
    neighbours together) into stars; only what crosses tasks is left to the
    rounds. Joins go by shuffle at every size: their sides grow with the edges,
    and a broadcast would pass them through the driver in each round. Each
    round is written out, which cuts lineage and survives lost executors; the
    loop ends when the written edges of two rounds are the same rows. This runs
    jobs while the plan is made.
    """
    edges = (
        edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
        .filter(F.col("u") != F.col("v"))
        .repartitionByRange("u", "v")
    )
    edges = cut(edges.mapInArrow(_shorten, "u long, v long").distinct(), "edges")
    size = edges.count()
    while size:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Larger neighbours of u point to the smallest node around u.
        large = (
            both.filter(F.col("v") > F.col("u"))
            .join(low.hint("merge"), "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # Smaller neighbours of u, and u itself, point to the smallest of them.
        small = large.join(low.hint("merge"), "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").filter(F.col("u") != F.col("v")).distinct()
        before, edges = edges, cut(small, "star")
        was, size = size, edges.count()
        if size == was and edges.join(before, ["u", "v"], "left_anti").isEmpty():
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
