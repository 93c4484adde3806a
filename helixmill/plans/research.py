"""Linear models and spectra: sums over rows are distributed, d x d algebra is done on the driver (d is a vector's width, not the data's size)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.operators.metrics import auroc
from helixmill.scratch import few, stored


#: Widths up to which sums of products are columns of one aggregate.
SMALL = 16


def gram(rows: DataFrame, column: str, width: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Number of rows, sum vector and sum of outer products of an array column, in one pass: of sums over the upper triangle if it is small, else of each task's matrix."""
    if width > SMALL:
        m = fold_moments(rows.select(F.lit(0).alias("fold"), column), [column], [width]).get(0, np.zeros((width + 1, width + 1)))
        return float(m[-1, -1]), m[:-1, -1], m[:-1, :-1]
    at = [F.get(column, F.lit(i)) for i in range(width)]
    cells = [(i, j) for i in range(width) for j in range(i, width)]
    one = rows.agg(F.count("*").alias("n"), F.array(*(F.sum(a) for a in at)).alias("s"), F.array(*(F.sum(at[i] * at[j]) for i, j in cells)).alias("g")).first()
    n = float(one["n"])
    if not n:
        return 0.0, np.zeros(width), np.zeros((width, width))
    g = np.zeros((width, width))
    for (i, j), v in zip(cells, one["g"], strict=True):
        g[i, j] = g[j, i] = v
    return n, np.array(one["s"]), g


def covariance(rows: DataFrame, column: str, width: int) -> np.ndarray:
    n, s, g = gram(rows, column, width)
    return g / n - np.outer(s / n, s / n) if n else g


def eigenvalues(rows: DataFrame, column: str, width: int) -> np.ndarray:
    """Variances along the principal components, largest first."""
    return np.maximum(np.linalg.eigvalsh(covariance(rows, column, width))[::-1], 0)


def explained_variance(rows: DataFrame, column: str, width: int) -> np.ndarray:
    """Shares of variance of the principal components, largest first."""
    values = eigenvalues(rows, column, width)
    return values / values.sum() if values.sum() else values


def ridge(rows: DataFrame, features: list[str], target: str, lam: float) -> np.ndarray:
    """Weights of the features and the intercept by the normal equations."""
    x = [F.col(c).cast("double") for c in features] + [F.lit(1.0)]
    width = len(x) + 1
    _, _, g = gram(rows.select(F.array(*x, F.col(target).cast("double")).alias("v")), "v", width)
    a = g[:-1, :-1] + lam * np.diag([1.0] * len(features) + [0.0])
    return np.linalg.solve(a, g[:-1, -1])


def logistic_probe(rows: DataFrame, features: list[str], label: str, *, lam: float = 0.0, rounds: int = 30, tolerance: float = 1e-10) -> np.ndarray:
    """Weights of the features and the intercept by Newton steps: each takes one pass of sums over the rows and one d x d solution on the driver."""
    x = [*(F.col(c).cast("double") for c in features), F.lit(1.0)]
    d, y = len(x), F.col(label).cast("double")
    cells, w = [(i, j) for i in range(d) for j in range(i, d)], np.zeros(d)
    for _ in range(rounds):
        odds = sum((F.lit(float(w[i])) * x[i] for i in range(1, d)), F.lit(float(w[0])) * x[0])
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))
        one = rows.agg(*(F.sum((y - p) * a).alias(f"g{i}") for i, a in enumerate(x)), *(F.sum(p * (F.lit(1.0) - p) * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in cells)).first()
        ridge_ = lam * np.diag([1.0] * (d - 1) + [0.0])
        g, h = np.array([one[f"g{i}"] for i in range(d)]) - ridge_ @ w, np.zeros((d, d))
        for i, j in cells:
            h[i, j] = h[j, i] = one[f"h{i}_{j}"]
        step = np.linalg.solve(h + ridge_, g)
        w = w + step
        if np.abs(step).max() < tolerance:
            break
    return w


def gaussian_kl(rows: DataFrame, column: str, width: int, eps: float = 1e-6) -> float:
    """KL divergence of the fitted Gaussian from the standard one, from the covariance's eigenvalues."""
    n, s, _ = gram(rows, column, width)
    values = np.maximum(np.linalg.eigvalsh(covariance(rows, column, width)), eps)
    mean = s / n if n else s
    return float(0.5 * (values.sum() + mean @ mean - width - np.log(values).sum()))


def fold_directions(rows: DataFrame) -> DataFrame:
    """(fold, i, direction): difference of the label means of each component over the other folds. Rows: fold, label, x."""
    many = rows.select("fold", "label", F.posexplode("x").alias("i", "v"))
    sums = many.groupBy("fold", "i").agg(*(F.sum(F.when(F.col("label") == k, F.col("v"))).alias(f"s{k}") for k in (0, 1)), *(F.count_if(F.col("label") == k).alias(f"n{k}") for k in (0, 1)))
    whole = sums.groupBy("i").agg(*(F.sum(c).alias(f"all_{c}") for c in ("s0", "s1", "n0", "n1")))
    rest = lambda k: (F.col(f"all_s{k}") - F.coalesce(f"s{k}", F.lit(0.0))) / F.nullif((F.col(f"all_n{k}") - F.col(f"n{k}")).cast("double"), F.lit(0.0))
    return sums.join(whole, "i").select("fold", "i", (rest(1) - rest(0)).alias("direction"))


def project(rows: DataFrame, directions: DataFrame) -> DataFrame:
    """id, label, score: each row on the direction its own fold had no part in."""
    by_fold = directions.groupBy("fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "direction"))), lambda d: d["direction"]).alias("d"))
    score = F.aggregate(F.zip_with("x", "d", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.join(few(by_fold, "directions", 1000), "fold").select("id", "label", score.alias("score"))


def fold_moments(rows: DataFrame, columns: list[str], widths: list[int]) -> dict[int, np.ndarray]:
    """Per fold, the sum of outer products of the joined array columns and a 1: tasks add up their own matrices, and Spark sums these cell by cell; the driver gets one matrix a fold.

    rows: fold and the columns."""
    width = sum(widths) + 1

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            fold = batch.column(0).to_numpy()
            z = np.hstack([*(c.flatten().to_numpy().reshape(batch.num_rows, w) for c, w in zip(batch.columns[1:], widths, strict=True)), np.ones((batch.num_rows, 1))])
            for k in np.unique(fold):
                mine = z[fold == k]
                sums[int(k)] = sums.get(int(k), 0.0) + mine.T @ mine
        for k, m in sums.items():
            i, j = np.triu_indices(width)
            yield pa.record_batch([pa.array(np.full(len(i), k, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j])], ["fold", "i", "j", "v"])

    plain = rows.select(F.col("fold").cast("int").alias("fold"), *(F.col(c).cast("array<double>").alias(c) for c in columns))
    out: dict[int, np.ndarray] = {}
    for r in plain.mapInArrow(add, "fold int, i int, j int, v double").groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).collect():  # folds x width x width / 2
        m = out.setdefault(r["fold"], np.zeros((width, width)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["v"]
    return out


def _weights(m: np.ndarray, features: list[int], targets: list[int], lam: float, *, standardize: bool, intercept: bool) -> np.ndarray:
    """(features + 1) x targets: ridge weights and an offset, from sums of outer products whose last row belongs to the 1."""
    n = m[-1, -1]
    mean, moments = m[features, -1] / n, m[np.ix_(features, features)]
    cross, offset = m[np.ix_(features, targets)], m[-1, targets] / n if intercept else np.zeros(len(targets))
    scale = np.ones(len(features))
    if standardize:
        std = np.sqrt(np.maximum(np.diag(moments) / n - mean**2, 0))
        scale = np.where(std > 1e-12, std, 1.0)
        moments, cross = (moments - n * np.outer(mean, mean)) / np.outer(scale, scale), (cross - np.outer(mean, m[-1, targets])) / scale[:, None]
    else:
        mean = np.zeros(len(features))
        cross = cross - np.outer(m[features, -1], offset)
    w = np.linalg.solve(moments + lam * np.eye(len(features)), cross) / scale[:, None]
    return np.vstack([w, offset - mean @ w])


def predictability(rows: DataFrame, state: int, actions: int, *, lam: float = 1.0, lam_action: float = 1.0, least: int = 2) -> DataFrame:
    """How well displacements can be told before an edit: predictor, n, mean_cosine, error (squared error as a share of that of zero) and auroc of the predicted length for the label; rows are predicted by what the other folds taught.

    rows: id, fold (a group's rows have one), cls, label, s (state), a (the action's features), d (displacement). Predictors: the mean displacement, the class's mean (the global one below `least` rows), ridge on the
    action, and ridge on state and action, standardised on the training folds. One pass sums up each fold; the fits are differences of these sums; a second pass predicts."""
    moments = fold_moments(rows, ["s", "a", "d"], [state, actions, state])
    whole = sum(moments.values())
    x, a, y = list(range(state)), list(range(state, state + actions)), list(range(state + actions, 2 * state + actions))
    models = {}
    for k, m in moments.items():
        rest = whole - m
        if rest[-1, -1] > 0:
            ones = _weights(rest, [*a, len(rest) - 1], y, lam_action, standardize=False, intercept=False)
            models[k] = rest[y, -1] / rest[-1, -1], ones, _weights(rest, x + a, y, lam, standardize=True, intercept=True)
    many = rows.select("fold", "cls", F.posexplode("d").alias("i", "v")).groupBy("fold", "cls", "i").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    all_ = many.groupBy("cls", "i").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    pairs_ = many.select("fold").distinct().join(few(all_, "classes")).join(many, ["fold", "cls", "i"], "left")  # folds x classes x components
    left = F.col("all_n") - F.coalesce("n", F.lit(0))
    mean = F.when(left >= least, (F.col("all_s") - F.coalesce("s", F.lit(0.0))) / left)
    means = pairs_.groupBy("fold", "cls").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", mean.alias("v")))), lambda p: p["v"]).alias("class_mean"))
    met = rows.join(few(means, "means", 10_000), ["fold", "cls"]).select("id", "label", F.col("fold").cast("int").alias("fold"), *(F.col(c).cast("array<double>").alias(c) for c in ("s", "a", "d", "class_mean")))

    def score(batches):
        for batch in batches:
            n, fold = batch.num_rows, batch.column(2).to_numpy()
            s, act, d = (batch.column(k).flatten().to_numpy().reshape(n, w) for k, w in ((3, state), (4, actions), (5, state)))
            by_class = batch.column(6).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, state)
            for name in ("global_mean", "class_mean", "ridge_action", "ridge_state_action"):
                p = np.zeros((n, state))
                for k in np.unique(fold):
                    if int(k) not in models:
                        continue
                    mine, (mean_, ones, full) = fold == k, models[int(k)]
                    if name == "global_mean":
                        p[mine] = mean_
                    elif name == "class_mean":
                        p[mine] = np.where(np.isnan(by_class[mine]), mean_, by_class[mine])
                    elif name == "ridge_action":
                        p[mine] = act[mine] @ ones[:-2] + ones[-2] + ones[-1]
                    else:
                        p[mine] = np.hstack([s[mine], act[mine]]) @ full[:-1] + full[-1]
                size, long = np.linalg.norm(p, axis=1), np.linalg.norm(d, axis=1)
                cosine = (p * d).sum(1) / np.where(size * long > 0, size * long, 1.0)
                columns = [batch.column(1), pa.array([name] * n), pa.array(cosine), pa.array(((p - d) ** 2).sum(1)), pa.array(long**2), pa.array(np.round(size, 9))]
                yield pa.record_batch(columns, ["label", "predictor", "cosine", "missed", "length", "score"])

    scored = stored(met.mapInArrow(score, "label int, predictor string, cosine double, missed double, length double, score double"), "predicted")
    sums = scored.groupBy("predictor").agg(F.count("*").alias("n"), F.avg("cosine").alias("mean_cosine"), (F.sum("missed") / F.nullif(F.sum("length"), F.lit(0.0))).alias("error"))
    return sums.join(auroc(scored.select("predictor", "label", "score"), ["predictor"]).select("predictor", "auroc"), "predictor")
