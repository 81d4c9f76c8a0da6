"""Drift of embeddings: equal-class moments, kernel distances, bandwidth, weighted medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.cohort import ranked_by_hash


def equal_class_moments(df: DataFrame, cls: str, embedding: str) -> DataFrame:
    """dim, mean, std: the mean of class means, and the root of the mean over classes of the mean squared deviation from it."""
    x = df.select(cls, F.posexplode(F.transform(embedding, lambda v: v.cast("double"))).alias("dim", "x"))
    per = x.groupBy(cls, "dim").agg(F.avg("x").alias("m"), F.avg(F.col("x") * F.col("x")).alias("q"))
    # mean((x - mu)^2) = q - 2 mu m + mu^2: one pass over the rows, the rest over class moments.
    mu = per.groupBy("dim").agg(F.avg("m").alias("mean"))
    return per.join(mu, "dim").groupBy("dim").agg(F.first("mean").alias("mean"), F.sqrt(F.greatest(F.avg(F.col("q") - 2 * F.col("mean") * F.col("m") + F.col("mean") * F.col("mean")), F.lit(0.0))).alias("std"))


def z_scores(df: DataFrame, embedding: str, moments: DataFrame, mask: float = 1e-8) -> DataFrame:
    """Replaces the embedding by its z-scores over coordinates with std > mask. Moments are one row a dimension."""
    m = moments.where(F.col("std") > mask).agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("_m"))
    return df.join(F.broadcast(m), F.lit(True)).withColumn(embedding, F.transform("_m", lambda s: (F.col(embedding)[s["dim"]].cast("double") - s["mean"]) / s["std"])).drop("_m")


def squared_distance(a: Column, b: Column) -> Column:
    """Mean over coordinates of squared differences."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def kernel_means(x: DataFrame, y: DataFrame, by: str, embedding: str, h: float, weight: str | None = None) -> DataFrame:
    """by, sum over pairs of w * w' * exp(-d / 2h); without weights the mean over pairs.

    Pairs are made within a class only, of stages that were capped before (at most 128 rows a class, capped_groups).
    """
    cols = lambda d, s: d.select(by, F.col(embedding).alias(f"e{s}"), (F.col(weight) if weight else F.lit(1.0)).alias(f"w{s}"))
    k = cols(x, 1).join(cols(y, 2), by).select(by, "w1", "w2", F.exp(-squared_distance(F.col("e1"), F.col("e2")) / (2 * h)).alias("k"))
    total = F.sum(F.col("w1") * F.col("w2") * F.col("k"))
    return k.groupBy(by).agg((total if weight else total / F.count("*")).alias("k"))


def class_mmd2(a: DataFrame, b: DataFrame, by: str, embedding: str, h: float, weight: str | None = None) -> DataFrame:
    """by, mmd2: biased squared MMD per class with an RBF kernel, diagonals included; tiny negative round-off becomes 0."""
    if h <= 0:
        raise ValueError("a positive bandwidth is required")
    xx, yy, xy = (kernel_means(p, q, by, embedding, h, weight).withColumnRenamed("k", n) for p, q, n in ((a, a, "xx"), (b, b, "yy"), (a, b, "xy")))
    raw = F.col("xx") + F.col("yy") - 2 * F.col("xy")
    return xx.join(yy, by).join(xy, by).select(by, F.when(raw.between(-64 * 2.220446049250313e-16, 0.0), F.lit(0.0)).otherwise(raw).alias("mmd2"))


def group_mass(df: DataFrame, by: list[str], group: str, out: str = "weight") -> DataFrame:
    """Adds the weight 1 / (groups of the key * size of the row's group): every group has equal mass."""
    sizes = df.groupBy(*by, group).agg(F.count("*").alias("_n"))
    groups = sizes.groupBy(*by).agg(F.count("*").alias("_g"))
    return df.join(sizes, [*by, group]).join(groups, by).withColumn(out, 1.0 / (F.col("_g") * F.col("_n"))).drop("_n", "_g")


def weighted_median(df: DataFrame, value: str, mass: str, by: list[str] = ()) -> DataFrame:
    """by, median: the least value at which the cumulative integer mass reaches half of the total.

    Masses are whole numbers, so the comparison is exact. Equal values are summed first. A key's distinct values are
    one window's rows: the distances of a reference capped at 128 a class.
    """
    v = df.groupBy(*by, value).agg(F.sum(F.col(mass).cast("decimal(38,0)")).alias("_w"))
    w = W.partitionBy(*by)
    c = v.select(*by, value, F.sum("_w").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0)).alias("_c"), F.sum("_w").over(w).alias("_t"))
    return c.where(F.col("_c") * 2 >= F.col("_t")).groupBy(*by).agg(F.min(value).alias("median"))


def class_pairs(df: DataFrame, by: str, sample: str, embedding: str) -> DataFrame:
    """by, left, right, distance: unordered pairs within a class of a capped reference (at most 128 rows a class)."""
    a = df.select(by, F.col(sample).alias("left"), F.col(embedding).alias("ea"))
    b = df.select(by, F.col(sample).alias("right"), F.col(embedding).alias("eb"))
    return a.join(b, by).where("left < right").select(by, "left", "right", squared_distance(F.col("ea"), F.col("eb")).alias("distance"))


#: Least common multiple of the possible numbers k(k-1)/2 of pairs, up to 128 of them a class: equal class masses in whole numbers.
PAIR_MASS = 5_765_760


def reference_pairs(df: DataFrame, by: str, sample: str, prefix: Column, cap: int = 128) -> DataFrame:
    """by, left, right: the first `cap` pairs of each class in hash order (ranked_by_hash), left < right.

    df is a capped reference (at most 128 rows a class). Only ids are paired; embeddings join the pairs that stay.
    """
    a, b = df.select(by, F.col(sample).alias("left")), df.select(by, F.col(sample).alias("right"))
    pairs = a.join(b, by).where("left < right").withColumn("_l", F.col("left").cast("string")).withColumn("_r", F.col("right").cast("string"))
    return ranked_by_hash(pairs, [by], ["_l", "_r"], prefix, cap).select(by, "left", "right")


def train_bandwidth(reference: DataFrame, by: str, sample: str, embedding: str, prefix: Column) -> DataFrame:
    """median: the lower weighted median of the distances of the 128 ranked pairs of each class, all classes of equal mass.

    reference: z-scores of at most 128 rows a class. A class of one row has no pair; that is an error, as the classes
    would not have equal mass.
    """
    pairs = reference_pairs(reference, by, sample, prefix)
    e = reference.select(by, sample, embedding)
    left, right = (e.select(by, F.col(sample).alias(s), F.col(embedding).alias(f"_{s}")) for s in ("left", "right"))
    far = pairs.join(left, [by, "left"]).join(right, [by, "right"]).select(by, squared_distance(F.col("_left"), F.col("_right")).alias("distance"))
    n = pairs.groupBy(by).agg(F.count("*").alias("_n"))
    lone = F.raise_error(F.lit("a class has fewer than 2 reference rows"))
    n = reference.select(by).distinct().join(n, by, "left").withColumn("mass", F.when(F.col("_n").isNull(), lone.cast("long")).otherwise((F.lit(PAIR_MASS) / F.col("_n")).cast("long"))).select(by, "mass")
    # From the classes to their pairs, so that a class without pairs is seen.
    return weighted_median(n.join(far, by, "left"), "distance", "mass")


def capped_groups(df: DataFrame, by: list[str], stage: str, group: str, rank: str) -> DataFrame:
    """Per key and stage, before and after the cap n = least stage size (at most 128): samples, groups, groups lost, largest group."""
    per = df.groupBy(*by, stage).agg(F.count("*").alias("samples_before"), F.count_distinct(group).alias("groups_before"))
    n = per.groupBy(*by).agg(F.least(F.min("samples_before"), F.lit(128)).alias("n"), F.count("*").alias("_s")).where("_s = 2").drop("_s")
    kept = df.join(n, by).where(F.col(rank) <= F.col("n")).groupBy(*by, stage, group).agg(F.count("*").alias("k"))
    after = kept.groupBy(*by, stage).agg(F.sum("k").alias("samples_after"), F.count("*").alias("groups_after"), F.max("k").alias("largest_after"))
    j = per.join(after, [*by, stage])
    lost = F.col("groups_before") - F.col("groups_after")
    return j.withColumn("groups_lost", lost).withColumn("post_cap_below5", F.col("groups_after") < 5).withColumn("lost_at_least5", lost >= 5)


def rank_and_condition(df: DataFrame, embedding: str, weight: str) -> tuple[int, float | None]:
    """Numeric rank and condition number of the weighted z-score matrix.

    The Gram matrix of the coordinates (dims x dims, bounded by the embedding) is summed over partitions and only it is brought
    to the driver; its eigenvalues are the squared singular values.
    """
    import numpy as np

    first = df.select(F.size(embedding).alias("p")).first()
    if first is None:
        raise ValueError("no rows")
    p = first["p"]

    def part(batches):
        g = np.zeros((p, p))
        for b in batches:
            if len(b):
                x = np.stack(b["e"].to_numpy()) * np.sqrt(b["w"].to_numpy())[:, None]
                g += x.T @ x
        yield __import__("pandas").DataFrame({"i": range(p), "row": list(g)})

    rows = df.select(F.col(embedding).alias("e"), F.col(weight).alias("w")).mapInPandas(part, "i int, row array<double>")
    sums = rows.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    g = np.zeros((p, p))
    g[sums["i"], sums["j"]] = sums["v"]
    s = np.sqrt(np.maximum(np.linalg.eigvalsh(g)[::-1], 0))
    rank = int((s > s[0] * p * np.sqrt(np.finfo(float).eps)).sum())
    return rank, float(s[0] / s[-1]) if rank == p else None
