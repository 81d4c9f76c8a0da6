"""Simulated uncertainty studies: many small synthetic datasets, one row each, spread over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Group sizes per class of the seven layouts; fixed values of the study design.
EVEN = [4] * 20
LAYOUTS = {
    1: [EVEN, EVEN, EVEN],
    2: [[1] * 10 + [2] * 6 + [8] * 3 + [40]] * 3,
    3: [EVEN, EVEN, EVEN],
    4: [EVEN, EVEN, EVEN],
    5: [EVEN, EVEN, [4] * 5],
    6: [[80] + [4] * 19] * 3,
    7: [EVEN, EVEN, EVEN],
}
VIEWS = 3


def one_dataset(layout: int, index: int, replicates: int, scale: float = 0.1):
    """(point, uncertainty) per view of one dataset: losses with class, group, block and sample effects.

    Layout 3 has strong group effects, 4 effects of blocks of groups that the estimator does not see, 7 groups shared by
    the classes. The uncertainty is the sample SD over exponential group weights of the equal-class weighted mean loss.
    """
    import numpy as np

    rng = np.random.default_rng([layout, index])
    sizes = LAYOUTS[layout]
    cls = np.concatenate([np.full(sum(s), c) for c, s in enumerate(sizes)])
    own = np.concatenate([np.repeat(np.arange(len(s)), s) for s in sizes])
    group = own if layout == 7 else cls * 100 + own
    names, g = np.unique(group, return_inverse=True)
    shared = lambda n: (rng.standard_normal((n, 1)) + rng.standard_normal((n, VIEWS))) * np.sqrt(0.5)
    effect, noise = shared(len(names)), shared(len(cls))
    if layout == 4:
        blocks, b = np.unique(names // 100 * 100 + names % 100 // 4, return_inverse=True)
        effect = np.sqrt(0.75) * shared(len(blocks))[b] + np.sqrt(0.25) * effect
    a = 0.9 if layout == 3 else 0.5
    z = np.sqrt(a) * effect[g] + np.sqrt(1 - a) * noise
    loss = 0.3 + 0.2 * cls[:, None] + 0.1 * np.arange(VIEWS) + scale * z * z
    w = np.random.default_rng(42).exponential(size=(replicates, len(names)))
    point, reps = np.zeros(VIEWS), np.zeros((replicates, VIEWS))
    for c in range(len(sizes)):
        at = cls == c
        n = np.bincount(g[at], minlength=len(names))
        t = np.stack([np.bincount(g[at], loss[at, v], len(names)) for v in range(VIEWS)], 1)
        point += loss[at].mean(0) / len(sizes)
        reps += (w @ t) / (w @ n)[:, None] / len(sizes)
    return point, reps.std(0, ddof=1)


def run(spark: SparkSession, layouts: list[int], datasets: int = 300, replicates: int = 2000) -> DataFrame:
    """layout, dataset, view, point, uncertainty."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for layout, index in zip(b["layout"], b["dataset"]):
                p, u = one_dataset(int(layout), int(index), replicates)
                out += [(layout, index, v, p[v], u[v]) for v in range(VIEWS)]
            yield pd.DataFrame(out, columns=["layout", "dataset", "view", "point", "uncertainty"])

    cells = spark.range(len(layouts) * datasets).select(F.element_at(F.array(*(F.lit(x) for x in layouts)), (F.col("id") / datasets).cast("int") + 1).alias("layout"), (F.col("id") % datasets).cast("int").alias("dataset"))
    return cells.mapInPandas(work, "layout int, dataset int, view int, point double, uncertainty double")


def summary(df: DataFrame) -> DataFrame:
    """layout, view, empirical_sd, u_mean, u_rms, ratio (mean u / SD), jackknife_se of the ratio, review (ratio outside 0.8..1.25).

    Leaving one dataset out changes sums only, so each jackknife value follows from the totals.
    """
    t = df.groupBy("layout", "view").agg(F.count("*").alias("n"), F.sum("point").alias("p"), F.sum(F.col("point") * F.col("point")).alias("pp"), F.sum("uncertainty").alias("u"), F.sum(F.col("uncertainty") * F.col("uncertainty")).alias("uu"))
    j = df.join(F.broadcast(t), ["layout", "view"])
    m = F.col("n") - 1
    var = lambda n, p, pp: (pp - p * p / n) / (n - 1)
    left = ((F.col("u") - F.col("uncertainty")) / m) / F.sqrt(var(m, F.col("p") - F.col("point"), F.col("pp") - F.col("point") * F.col("point")))
    jk = j.groupBy("layout", "view").agg(F.sqrt(F.var_pop(left) * (F.count("*") - 1)).alias("jackknife_se"))
    sd = F.sqrt(var(F.col("n"), F.col("p"), F.col("pp")))
    r = t.select("layout", "view", sd.alias("empirical_sd"), (F.col("u") / F.col("n")).alias("u_mean"), F.sqrt(F.col("uu") / F.col("n")).alias("u_rms"), (F.col("u") / F.col("n") / sd).alias("ratio"))
    return r.join(jk, ["layout", "view"]).withColumn("review", ~F.col("ratio").between(0.8, 1.25))
