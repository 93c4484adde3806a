"""Random-forest regression on residuals: level-wise trees over distributed feature histograms, with the splits chosen on the driver.

A level is one aggregate for all trees: rows are summed per (tree, node, feature, bin), which combines before the shuffle; the driver gets trees x nodes x features x bins sums, whatever the number of rows, and sends back one split a node.
Bins are cut at quantiles of each feature, or between all of its values if these are few.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.operators.metrics import resampled
from helixmill.scratch import stored


class Forest(NamedTuple):
    """Per tree, nodes in level order: the feature looked at, the greatest value that goes left, and the leaves' values."""

    features: np.ndarray
    cuts: np.ndarray
    values: np.ndarray


def cut_points(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Per feature, ascending values to split at: midpoints of all values if they are at most `bins`, else of quantiles."""
    counts = rows.agg(*(F.approx_count_distinct(F.get("x", F.lit(f)), 0.02).alias(f"c{f}") for f in range(width))).first()
    few = [f for f in range(width) if counts[f"c{f}"] <= bins]
    asks = [F.collect_set(F.get("x", F.lit(f))).alias(f"v{f}") if f in few else F.percentile_approx(F.get("x", F.lit(f)), [(k + 1) / (bins + 1) for k in range(bins)], 10_000).alias(f"v{f}") for f in range(width)]
    found = rows.agg(*asks).first()
    out = []
    for f in range(width):
        v = np.unique(np.array(found[f"v{f}"], float))
        out.append((v[1:] + v[:-1]) / 2)
    return out


def _bin(f: int, cuts: np.ndarray) -> Column:
    """The number of cuts below the feature's value; the value goes left of cut c if it is at most cuts[c]."""
    x = F.get("x", F.lit(f))
    return F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: c < x)) if len(cuts) else F.lit(0)


def _best(hist: np.ndarray, least: int) -> tuple[float, int, int]:
    """Gain, feature and cut of the best split of a node's histogram (features x bins x (number, sum)); the first among equals."""
    best = (1e-9, -1, -1)
    for f in range(hist.shape[0]):
        left = np.cumsum(hist[f], axis=0)[:-1]
        whole = hist[f].sum(0)
        right = whole - left
        for c in np.flatnonzero((left[:, 0] >= least) & (right[:, 0] >= least)):
            gain = left[c, 1] ** 2 / left[c, 0] + right[c, 1] ** 2 / right[c, 0] - whole[1] ** 2 / whole[0]
            if gain > best[0] + 1e-9 * abs(best[0]):
                best = (float(gain), f, int(c))
    return best


def fit(rows: DataFrame, width: int, *, trees: int = 100, depth: int = 3, least: int = 50, bins: int = 32, seed: str = "0", bootstrap: bool = True) -> Forest:
    """Fits rows of id, x (features) and y. bootstrap: each tree sees as many rows as there are, drawn with replacement; else all trees see all rows. A split leaves `least` rows or more on both sides."""
    held = stored(rows.select("id", "x", F.col("y").cast("double").alias("y")), "forest")
    points = cut_points(held, width, bins)
    most = max((len(p) for p in points), default=0) + 1
    binned = held.select("id", "y", F.array(*(_bin(f, p) for f, p in enumerate(points))).alias("b"))
    if bootstrap:
        seen = resampled(binned, trees, seed, [], ["b", "y"]).withColumnRenamed("replicate", "tree")
    else:
        seen = binned.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "b", "y")
    at = stored(seen.withColumn("node", F.lit(0)), "level")
    spark, inner = rows.sparkSession, 2**depth - 1
    features, cuts = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    for level in range(depth):
        sums = at.select("tree", "node", "y", F.posexplode("b").alias("f", "bin")).groupBy("tree", "node", "f", "bin").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()
        hist = np.zeros((trees, 2**level, width, most, 2))
        for r in sums:
            hist[r["tree"], r["node"], r["f"], r["bin"]] = r["n"], r["s"]
        splits = []
        for t in range(trees):
            for node in range(2**level):
                _, f, c = _best(hist[t, node], least) if hist[t, node].any() else (0, -1, -1)
                if f >= 0:
                    features[t, 2**level - 1 + node], cuts[t, 2**level - 1 + node] = f, points[f][c]
                splits.append((t, node, max(f, 0), c if f >= 0 else most))
        chosen = F.broadcast(spark.createDataFrame(splits, "tree int, node int, f int, c int"))
        # bins up to the cut's number go left
        at = at.join(chosen, ["tree", "node"]).select("tree", (F.col("node") * 2 + (F.get("b", F.col("f")) > F.col("c")).cast("int")).alias("node"), "b", "y")
    leaves = np.zeros((trees, 2**depth))
    for r in at.groupBy("tree", "node").agg(F.avg("y").alias("v")).collect():
        leaves[r["tree"], r["node"]] = r["v"]
    return Forest(features, cuts, leaves)


def predict(rows: DataFrame, forest: Forest, name: str) -> DataFrame:
    """rows (x) with the mean of the trees' values."""
    depth = int(np.log2(forest.values.shape[1]))
    model = [([int(f) for f in fs], [float(c) for c in cs], [float(v) for v in vs]) for fs, cs, vs in zip(*forest, strict=True)]
    table = F.broadcast(rows.sparkSession.createDataFrame([(model,)], "_trees array<struct<f:array<int>,c:array<double>,v:array<double>>>"))
    inner = 2**depth - 1

    def value(tree: Column) -> Column:
        down = lambda at, _: at * 2 + 1 + (F.get("x", F.get(tree["f"], at)) > F.get(tree["c"], at)).cast("int")
        return F.get(tree["v"], F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), down) - inner)

    total = F.aggregate("_trees", F.lit(0.0), lambda s, tree: s + value(tree))
    return rows.join(table).withColumn(name, total / F.lit(float(len(model)))).drop("_trees")
