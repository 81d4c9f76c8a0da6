"""Fitting: temperatures, cross-fitting, mixture weights, forecasts and their selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import log_softmax

T_MIN, T_MAX = 0.05, 20.0


def gradient(df: DataFrame, by: list[str], betas: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """by, k, g: mean over rows of E[logit] - logit of the label at inverse temperature beta; betas: (by, betas array)."""
    z = F.transform(logits, lambda x: x.cast("double") - F.array_max(logits).cast("double"))

    def slope(b: Column) -> Column:
        e = F.transform("z", lambda x: F.exp(x * b))
        total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
        mean = F.aggregate(F.zip_with(e, F.col("z"), lambda p, x: p * x), F.lit(0.0), lambda s, x: s + x)
        return mean / total - F.get("z", F.col(label))

    rows = df.select(*by, label, z.alias("z")).join(F.broadcast(betas), by)
    each = rows.select(*by, F.posexplode(F.transform("betas", slope)).alias("k", "g"))
    return each.groupBy(*by, "k").agg(F.avg("g").alias("g"))


def fit_temperatures(df: DataFrame, by: list[str], logits: str = "logits", label: str = "label", points: int = 16, passes: int = 13) -> DataFrame:
    """by, temperature, boundary: the temperature of least mean NLL of each key, between 0.05 and 20.

    The NLL is convex in beta = 1/T, so its slope is bracketed: each pass over the data takes the slope at `points` inner
    points for all keys together and keeps the bracket with the change of sign. Keys (seeds, views) are few; rows stay on
    the executors. A slope of 0 at T = 1 (within 1e-12) gives 1.
    """
    spark = df.sparkSession
    keys = [tuple(r) for r in df.select(*by).distinct().collect()]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    lo, hi, done = dict.fromkeys(keys, 1 / T_MAX), dict.fromkeys(keys, 1 / T_MIN), {}

    def slopes(grid: dict) -> dict:
        t = spark.createDataFrame([(*k, [float(x) for x in v]) for k, v in grid.items()], kinds + ", betas array<double>")
        return {(tuple(r[c] for c in by), r["k"]): r["g"] for r in gradient(df, by, t, logits, label).collect()}

    if keys:
        g = slopes({k: [1.0, 1 / T_MAX, 1 / T_MIN] for k in keys})
        for k in keys:
            if abs(g[k, 0]) < 1e-12:
                done[k] = (1.0, False)
            elif g[k, 1] >= 0:
                done[k] = (T_MAX, True)
            elif g[k, 2] <= 0:
                done[k] = (T_MIN, True)
    for _ in range(passes):
        left = [k for k in keys if k not in done]
        if not left:
            break
        grid = {k: [lo[k] + (hi[k] - lo[k]) * (i + 1) / (points + 1) for i in range(points)] for k in left}
        g = slopes(grid)
        for k in left:
            up = next((i for i in range(points) if g[k, i] > 0), points)
            lo[k], hi[k] = (grid[k][up - 1] if up else lo[k]), (grid[k][up] if up < points else hi[k])
    rows = [(*k, *done.get(k, (2 / (lo[k] + hi[k]) if k not in done else 0.0, False))) for k in keys]
    return spark.createDataFrame(rows, kinds + ", temperature double, boundary boolean")


def cross_fit(df: DataFrame, by: list[str], fold: str, folds: int = 5, logits: str = "logits", label: str = "label") -> DataFrame:
    """Rows with logp at the temperature fitted on the other folds, and that temperature."""
    spark = df.sparkSession
    f = F.broadcast(spark.range(folds).select(F.col("id").cast("int").alias("score_fold")))
    fit = df.join(f, F.col(fold) != F.col("score_fold"))
    t = fit_temperatures(fit, [*by, "score_fold"], logits, label).withColumnRenamed("score_fold", fold)
    return df.join(F.broadcast(t), [*by, fold]).withColumn("logp", log_softmax(F.col(logits), F.col("temperature")))


def simplex_projection(x):
    """Euclidean projection on the probability simplex (any dimension)."""
    import numpy as np

    u = np.sort(np.asarray(x, float))[::-1]
    c = (np.cumsum(u) - 1) / np.arange(1, len(u) + 1)
    return np.maximum(x - c[np.flatnonzero(u > c)[-1]], 0)


def log_remainder(z):
    """z - log1p(z), by series where |z| <= 1e-3 so that nothing cancels."""
    import numpy as np

    z = np.asarray(z, float)
    small = np.abs(z) <= 1e-3
    s = np.where(small, z, 0.0)
    series = s * s * (1 / 2 - s * (1 / 3 - s * (1 / 4 - s * (1 / 5 - s * (1 / 6 - s / 7)))))
    big = np.where(small, 1.0, z)
    return np.where(small, series, big - np.log1p(big))


def solve_mixture(logs, alpha, tol: float = 1e-10, steps: int = 10_000):
    """Weights w on the simplex that minimise -sum alpha log(sum_v w_v exp(logs_v)); (weights, iterations, residual).

    Projected gradient with Armijo steps from the uniform start. The change of the objective is computed from relative
    changes of each row's mixture, so steps far below the rounding of the objective itself are still judged.
    """
    import numpy as np

    logs, alpha = np.asarray(logs, float), np.asarray(alpha, float)
    p = np.exp(logs - logs.max(1, keepdims=True))
    w = np.full(p.shape[1], 1 / p.shape[1])
    for i in range(steps + 1):
        mix = p @ w
        g = -(alpha / mix) @ p
        g = g - g[np.argmax(w)]  # a common shift does not change the projection
        residual = float(np.abs(w - simplex_projection(w - g)).max())
        if residual <= tol:
            return w, i, residual
        step = 1.0
        for _ in range(80):
            d = simplex_projection(w - step * g) - w
            rel = (p @ d) / mix
            # The change is g.d + sum alpha (rel - log1p(rel)); the first term is exact to rounding, the second never negative.
            if rel.min() > -1 and float(alpha @ log_remainder(rel)) <= -(1 - 1e-4) * float(g @ d):
                break
            step /= 2
        else:
            raise RuntimeError("no step lowers the objective")
        w = np.maximum(w + d, 0)
        w /= w.sum()
    raise RuntimeError("not converged")


def learned_weights(df: DataFrame, by: list[str], cls: str, logs: str) -> DataFrame:
    """by, weights, iterations, residual: the static mixture of least equal-class NLL, one solve a key.

    Rows hold the true-label log-probability of each view. A key's rows are one task's input (tens of thousands of
    short rows a key by the nature of the fit, which is on one evaluation month).
    """

    def fit(pdf):
        import numpy as np
        import pandas as pd

        n = pdf.groupby(cls)[cls].transform("count").to_numpy(float)
        w, i, r = solve_mixture(np.stack(pdf[logs].to_numpy()), 1 / (pdf[cls].nunique() * n))
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), w.tolist(), i, r]], columns=[*by, "weights", "iterations", "residual"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return df.groupBy(*by).applyInPandas(fit, kinds + ", weights array<double>, iterations int, residual double")


def forecasts(losses: DataFrame, drift: DataFrame, view: str, loss: str, d: str, betas: tuple[float, ...] = (0.0, 0.5, 1.0)) -> DataFrame:
    """losses with beta and forecast = loss + beta * drift of the view."""
    grid = F.explode(F.array(*(F.lit(b) for b in betas))).alias("beta")
    return losses.join(F.broadcast(drift.select(view, d)), view).select(*losses.columns, d, grid).withColumn("forecast", F.col(loss) + F.col("beta") * F.col(d))


def select_beta(errors: DataFrame, view: str, error: str, tie: float = 1e-12) -> DataFrame:
    """beta, mae, chosen: mean over classes, then over views, of the absolute error; ties within `tie` go to the least beta."""
    per = errors.groupBy("beta", view).agg(F.avg(F.abs(error)).alias("m")).groupBy("beta").agg(F.avg("m").alias("mae"))
    least = per.agg(F.min("mae").alias("_l"))
    near = per.join(F.broadcast(least), F.lit(True)).withColumn("_near", F.col("mae") - F.col("_l") <= tie)
    best = near.where("_near").agg(F.min("beta").alias("_b"))
    return near.join(F.broadcast(best), F.lit(True)).select("beta", "mae", (F.col("beta") == F.col("_b")).alias("chosen"))
