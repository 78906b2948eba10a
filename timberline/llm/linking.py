"""Links between the members of buckets, exact, without putting out the pairs of a bucket.

Nodes that share a bucket are candidates. First every member is checked against
its bucket's smallest node. Buckets whose members then still lie in different
components go to tasks that hold at most two blocks of ``block`` members, compare
those of different components and put out links only, at most one for each
component joined. No candidate pair is left out: one in the same component needs
no check, all others get one.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators.components import connected_components
from timberline.session import cut


class Roots:
    """Union-find over the components that meet in one task."""

    def __init__(self, root: list[int]):
        self.root, self.parent = root, {r: r for r in root}

    def find(self, x: int) -> int:
        r = self.root[x]
        while self.parent[r] != r:
            self.parent[r] = self.parent[self.parent[r]]
            r = self.parent[r]
        return r

    def join(self, x: int, y: int) -> None:
        self.parent[self.find(x)] = self.find(y)


def bucket_links(spread: DataFrame, payloads: Callable[[DataFrame], DataFrame], alike: Callable[[bytes, bytes], bool],
                 settle: Callable[[list[bytes], list[int], list[bool]], list[tuple[int, int]]], block: int = 1024) -> DataFrame:
    """``(a, b)`` links from ``spread`` rows of ``(node, bucket)``, enough to connect all that are alike.

    ``payloads`` gives ``(node, body)`` for a table of nodes, ``alike`` decides a pair, ``settle`` finds links by
    position among bodies with roots; a pair counts if one of it is marked left and the other not, or if all are.
    """
    buckets = spread.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("last")).filter("head <> last")
    buckets = cut(buckets.select("bucket", "head"), "buckets")
    members = cut(spread.join(buckets, "bucket").filter("node <> head").select("bucket", "node", "head").distinct(), "members")
    pairs = cut(members.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    bodies = cut(payloads(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()), "bodies")

    def check(batches):
        for batch in batches:
            both = zip(batch.column("body_a").to_pylist(), batch.column("body_b").to_pylist(), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([alike(x, y) for x, y in both], pa.bool_()))

    one = bodies.select(F.col("node").alias("a"), F.col("body").alias("body_a"))
    two = bodies.select(F.col("node").alias("b"), F.col("body").alias("body_b"))
    edges = cut(pairs.join(one, "a").join(two, "b").select("a", "b", "body_a", "body_b").mapInArrow(check, "a long, b long"), "links")

    roots = connected_components(edges).withColumnRenamed("node", "of")
    rooted = cut(members.join(roots, members["node"] == roots["of"], "left").select(
        "bucket", "node", F.coalesce("root", "node").alias("root")), "rooted")
    # The head has met everyone; others of different components have not met.
    still = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("m"))
    still = still.filter("low <> high").select("bucket", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    own = F.pmod(F.hash("node"), F.col("blocks"))
    tasks = rooted.join(still, "bucket").select("bucket", "node", "root", own.alias("own"),
                                                F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = tasks.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root", "own")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node, root, mine, i, j, body = (table.column(c).to_pylist() for c in ("node", "root", "own", "i", "j", "body"))
        left = [True] * len(node) if i[0] == j[0] else [o == i[0] for o in mine]
        found = settle(body, root, left)
        return pa.table({"a": pa.array([node[x] for x, _ in found], pa.int64()), "b": pa.array([node[y] for _, y in found], pa.int64())})

    more = tasks.join(bodies, "node").groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")
    return edges.unionByName(cut(more, "links"))
