"""Isolation forest (Liu, Ting, Zhou 2008) grown and applied as Spark jobs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from timberline.operators.scoring import FEATURES
from timberline.session import cut

TREES = 50
SAMPLE = 256
SEED = 42
LEAST_ROWS = 20

_TREE = "dataset string, tree int, feature array<int>, split array<double>, below array<int>, above array<int>, path array<double>, psi int"


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def tree_samples(features: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """For each (dataset, tree) the ``sample`` rows of smallest hash of id and tree.

    One rule for every size: a row names the trees whose hash of it lies below a
    threshold that leaves about four samples per tree, and only those are ranked.
    """
    sizes = cut(features.groupBy("dataset").agg(F.count(F.lit(1)).alias("_n")), "sizes").filter(
        F.col("_n") >= LEAST_ROWS
    )
    share = F.least(F.lit(1.0), F.lit(4.0 * sample) / F.col("_n"))

    def spot(tree):
        return F.pmod(F.xxhash64("id", tree, F.lit(seed)), F.lit(1 << 40))

    every = F.sequence(F.lit(0), F.lit(trees - 1))
    near = features.join(sizes, "dataset").withColumn("_share", share)
    near = near.withColumn("tree", F.explode(F.filter(every, lambda k: spot(k) / float(1 << 40) <= F.col("_share"))))
    order = Window.partitionBy("dataset", "tree").orderBy("_h", "id")
    return (
        near.withColumn("_h", spot(F.col("tree")))
        .withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= sample)
        .select("dataset", "tree", "id", *FEATURES)
    )


def _grow(group: pd.DataFrame) -> pd.DataFrame:
    """One tree from its sample: random feature, random cut, until alone or too deep."""
    dataset, tree = group.dataset.iloc[0], int(group.tree.iloc[0])
    x = group.sort_values("id")[list(FEATURES)].to_numpy("float64")
    rng = np.random.default_rng([SEED, tree])
    limit = math.ceil(math.log2(max(2, len(x))))
    feature, split, below, above, path = [], [], [], [], []
    todo = [(np.arange(len(x)), 0, -1, False)]
    while todo:
        rows, depth, parent, left = todo.pop()
        here = len(feature)
        if parent >= 0:
            (below if left else above)[parent] = here
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        leaf = depth >= limit or len(rows) <= 1 or len(usable) == 0
        f = -1 if leaf else int(rng.choice(usable))
        cut_at = 0.0 if leaf else float(rng.uniform(low[f], high[f]))
        feature.append(f)
        split.append(cut_at)
        below.append(-1)
        above.append(-1)
        path.append(depth + average_path(len(rows)) if leaf else 0.0)
        if not leaf:
            side = part[:, f] <= cut_at
            todo.append((rows[~side], depth + 1, here, False))
            todo.append((rows[side], depth + 1, here, True))
    return pd.DataFrame(
        [[dataset, tree, feature, split, below, above, path, len(x)]],
        columns=["dataset", "tree", "feature", "split", "below", "above", "path", "psi"],
    )


def grow_forest(features: DataFrame) -> DataFrame:
    return cut(tree_samples(features).groupBy("dataset", "tree").applyInPandas(_grow, _TREE), "forest")


def _score(x: np.ndarray, trees: list) -> np.ndarray:
    """2 ** (-mean path / expected path) for every row."""
    total = np.zeros(len(x))
    for feature, split, below, above, path, _ in trees:
        at = np.zeros(len(x), dtype="int64")
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            rows = np.flatnonzero(inner)
            go = x[rows, f[rows]] <= split[at[rows]]
            at[rows] = np.where(go, below[at[rows]], above[at[rows]])
        total += path[at]
    expected = average_path(trees[0][5]) or 1.0
    return 2.0 ** (-(total / len(trees)) / expected)


def _as_arrays(row) -> tuple:
    return (
        np.array(row.feature), np.array(row.split), np.array(row.below), np.array(row.above),
        np.array(row.path), int(row.psi),
    )


def raw_scores(features: DataFrame, forest: DataFrame, width: int = 1 << 18) -> DataFrame:
    """``dataset, id, raw``.

    The trees of a dataset (50 of at most 511 nodes each) are a table; they meet
    its rows in id blocks of bounded size, so neither passes through the driver.
    """
    rows = features.join(forest.select("dataset").distinct(), "dataset", "left_semi")
    rows = rows.withColumn("_block", F.floor(F.col("id") / width))
    blocks = rows.select(F.col("dataset").alias("_of"), F.col("_block").alias("_at")).distinct()
    spread = forest.join(blocks, forest["dataset"] == blocks["_of"]).drop("dataset")

    def together(part: pd.DataFrame, grown: pd.DataFrame) -> pd.DataFrame:
        arrays = [_as_arrays(row) for row in grown.sort_values("tree").itertuples()]
        raw = _score(part[list(FEATURES)].to_numpy("float64"), arrays)
        return pd.DataFrame({"dataset": part.dataset.to_numpy(), "id": part.id.to_numpy(), "raw": raw})

    return rows.groupBy("dataset", "_block").cogroup(spread.groupBy("_of", "_at")).applyInPandas(
        together, "dataset string, id long, raw double")


def forest_scores(features: DataFrame) -> DataFrame:
    """``dataset, id, iforest`` in 0..1 per dataset (1 most isolated).

    Datasets below LEAST_ROWS rows get no score; equal scores all read 0.1.
    """
    features = cut(features, "features")
    scored = cut(raw_scores(features, grow_forest(features)), "raw-scores")
    ends = scored.groupBy("dataset").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    return scored.join(ends, "dataset").select(
        "dataset", "id",
        F.when(F.col("hi") > F.col("lo"), (F.col("raw") - F.col("lo")) / (F.col("hi") - F.col("lo")))
        .otherwise(0.1)
        .alias("iforest"),
    )
