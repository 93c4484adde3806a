"""Forests and displacement predictors against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.plans import forest, research


def grown(x, y, depth, least):
    """The best split at each node by trying all: sums of squares, ties to the first feature and cut."""
    if depth == 0:
        return float(y.mean()) if len(y) else 0.0
    best = (1e-9, None, None)
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for c in (v[1:] + v[:-1]) / 2:
            go = x[:, f] <= c
            if min(go.sum(), (~go).sum()) >= least:
                gain = y[go].sum() ** 2 / go.sum() + y[~go].sum() ** 2 / (~go).sum() - y.sum() ** 2 / len(y)
                if gain > best[0] + 1e-9 * abs(best[0]):
                    best = (gain, f, c)
    _, f, c = best
    if f is None:
        return float(y.mean()) if len(y) else 0.0
    go = x[:, f] <= c
    return f, c, grown(x[go], y[go], depth - 1, least), grown(x[~go], y[~go], depth - 1, least)


def follow(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("depth,least", [(1, 5), (3, 5), (3, 60), (2, 500)])
def test_trees_are_brute_force(spark, depth, least):
    g = np.random.default_rng(3)
    x = np.column_stack([g.integers(0, 9, 400), g.integers(0, 3, 400), g.normal(size=400).round(1)]).astype(float)
    y = np.where(x[:, 0] > 4, 2.0, 0.0) + x[:, 1] * (x[:, 2] > 0) + g.integers(0, 2, 400)
    rows = spark.createDataFrame([(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y double").repartition(4)
    model = forest.fit(rows, 3, trees=2, depth=depth, least=least, bins=100, bootstrap=False)
    tree = grown(x, y, depth, least)
    got = {r.id: r.p for r in forest.predict(rows, model, "p").collect()}
    assert got == pytest.approx({i: follow(tree, v) for i, v in enumerate(x)}, abs=1e-9)
    assert (model.features[0] == model.features[1]).all()


def test_forest_of_drawn_rows(spark):
    """Trees differ, their mean follows the target, and reruns agree."""
    g = np.random.default_rng(4)
    x = g.normal(size=(600, 2))
    rows = spark.createDataFrame([(i, [float(a), float(b)], float(3 * (a > 0) + 0.1 * b)) for i, (a, b) in enumerate(x)], "id long, x array<double>, y double").repartition(3)
    models = [forest.fit(rows.repartition(n), 2, trees=6, depth=3, least=20, seed="s") for n in (2, 5)]
    assert all(np.allclose(a, b) for a, b in zip(*models, strict=True)) and len({tuple(c) for c in models[0].cuts}) > 1
    error = forest.predict(rows, models[0], "p").agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)), F.var_pop("y")).first()
    assert error[0] < 0.2 * error[1]


def test_predictability_is_brute_force(spark):
    g = np.random.default_rng(5)
    n, width, kinds = 300, 6, 4
    s, kind, fold, label = g.normal(size=(n, width)), g.integers(0, kinds, n), g.integers(0, 3, n), g.integers(0, 2, n)
    kind[0] = kinds  # a class of one row
    a = np.eye(kinds + 1)[kind]
    d = s @ g.normal(size=(width, width)) * 0.3 + a @ g.normal(size=(kinds + 1, width)) + 0.1 * g.normal(size=(n, width))
    rows = [(i, int(fold[i]), int(kind[i]), int(label[i]), s[i].tolist(), a[i].tolist(), d[i].tolist()) for i in range(n)]
    frame = spark.createDataFrame(rows, "id int, fold int, cls int, label int, s array<double>, a array<double>, d array<double>").repartition(4)
    got = {r.predictor: r for r in research.predictability(frame, width, kinds + 1, lam=2.0, lam_action=0.5, least=2).collect()}
    want = {k: np.zeros_like(d) for k in ("global_mean", "class_mean", "ridge_action", "ridge_state_action")}
    solve = lambda x, y, lam: np.linalg.solve(x.T @ x + lam * np.eye(x.shape[1]), x.T @ y)
    for k in range(3):
        test, train = fold == k, fold != k
        mean = d[train].mean(0)
        want["global_mean"][test] = mean
        for i in np.flatnonzero(test):
            same = train & (kind == kind[i])
            want["class_mean"][i] = d[same].mean(0) if same.sum() >= 2 else mean
        ones = np.hstack([a, np.ones((n, 1))])
        want["ridge_action"][test] = ones[test] @ solve(ones[train], d[train], 0.5)
        x = np.hstack([s, a])
        m, std = x[train].mean(0), x[train].std(0)
        z = (x - m) / np.where(std == 0, 1, std)
        want["ridge_state_action"][test] = z[test] @ solve(z[train], d[train] - mean, 2.0) + mean
    for name, p in want.items():
        size, long = np.linalg.norm(p, axis=1), np.linalg.norm(d, axis=1)
        pairs = [(u > v) + (u == v) / 2 for u in size[label == 1].round(9) for v in size[label == 0].round(9)]
        assert got[name].n == n and got[name].mean_cosine == pytest.approx(((p * d).sum(1) / (size * long)).mean(), abs=1e-9)
        assert got[name].error == pytest.approx(((p - d) ** 2).sum() / (d**2).sum(), abs=1e-9) and got[name].auroc == pytest.approx(np.mean(pairs), abs=1e-9)
    assert got["ridge_state_action"].error < got["ridge_action"].error < got["global_mean"].error
