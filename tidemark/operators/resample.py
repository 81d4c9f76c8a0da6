"""Resampling of whole groups over their sufficient statistics: draws meet group sums, never rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _draws(spark: SparkSession, groups: list, replicates: int, seed: int, column: str, kind: str, draw: Callable, tasks: int = 8) -> DataFrame:
    """replicate, group_id, column without zeros: rows of one PCG64 stream, made on the executors.

    draw(rng, g, n) gives the next n x g values. The stream cannot be entered in its middle, so a task makes it from the start
    up to its own replicates and drops what comes before; a step holds about a million values.
    """
    g, names = len(groups), "string" if groups and isinstance(groups[0], str) else "bigint"
    step = max(1, 1_000_000 // max(g, 1))

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        at = np.array(groups)
        for b in batches:
            for lo, hi in zip(b["lo"], b["hi"]):
                rng = np.random.default_rng(seed)
                for r in range(0, hi, step):
                    d = draw(rng, g, min(step, replicates - r))
                    i, c = np.nonzero(d)
                    keep = (i + r >= lo) & (i + r < hi)
                    i, c = i[keep], c[keep]
                    if len(i):
                        yield pd.DataFrame({"replicate": (i + r).astype("int32"), "group_id": at[c], column: d[i, c]})

    parts = spark.range(0, tasks, 1, tasks).select((F.col("id") * replicates / tasks).cast("int").alias("lo"), ((F.col("id") + 1) * replicates / tasks).cast("int").alias("hi"))
    return parts.mapInPandas(work, f"replicate int, group_id {names}, {column} {kind}")


def multinomial_draws(spark: SparkSession, groups: list, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """replicate, group_id, multiplicity: PCG64 draws of G groups with replacement; groups that a replicate misses have no row."""

    def draw(rng, g, n):
        import numpy as np

        return rng.multinomial(g, np.full(g, 1 / g), size=n)

    return _draws(spark, groups, replicates, seed, "multiplicity", "bigint", draw)


def exponential_draws(spark: SparkSession, groups: list, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """replicate, group_id, weight: exponential(1) weights."""
    return _draws(spark, groups, replicates, seed, "weight", "double", lambda rng, g, n: rng.exponential(size=(n, g)))


def seed_group_draws(spark: SparkSession, groups: list, seeds: list, replicates: int = 20_000, seed: int = 42, tasks: int = 16) -> tuple[DataFrame, DataFrame]:
    """(replicate, group_id, weight) and (replicate, seed, multiplicity): each replicate draws as many groups and seeds as there are.

    One PCG64 stream gives a replicate's seeds, then its groups; a task makes it from the start and keeps its own replicates.
    """
    g, k = len(groups), len(seeds)
    names = "string" if groups and isinstance(groups[0], str) else "bigint"

    def rows(what: int, column: str, kind: str, out: str) -> DataFrame:
        def work(batches: Iterator) -> Iterator:
            import numpy as np
            import pandas as pd

            at = np.array((seeds, groups)[what])
            for b in batches:
                for lo, hi in zip(b["lo"], b["hi"]):
                    rng = np.random.Generator(np.random.PCG64(seed))
                    parts, held = [], 0
                    for r in range(hi):
                        drawn = rng.integers(0, k, size=k), rng.integers(0, g, size=g)
                        if r < lo:
                            continue
                        m = np.bincount(drawn[what], minlength=len(at))
                        c = np.flatnonzero(m)
                        parts.append((np.full(len(c), r, "int32"), at[c], m[c]))
                        held += len(c)
                        if held > 100_000 or r == hi - 1:
                            yield pd.DataFrame({n: np.concatenate(x) for n, x in zip(("replicate", column, out), zip(*parts))})
                            parts, held = [], 0

        parts = spark.range(0, tasks, 1, tasks).select((F.col("id") * replicates / tasks).cast("int").alias("lo"), ((F.col("id") + 1) * replicates / tasks).cast("int").alias("hi"))
        return parts.mapInPandas(work, f"replicate int, {column} {kind}, {out} bigint")

    return rows(1, "group_id", names, "weight"), rows(0, "seed", "int", "multiplicity")


def hash_draws(spark: SparkSession, groups: DataFrame, replicates: int, weight: Column) -> DataFrame:
    """replicate, group_id, weight with weights given by an expression of both: draws that any engine can repeat."""
    return groups.join(F.broadcast(spark.range(replicates).select(F.col("id").alias("replicate"))), F.lit(True)).select("replicate", "group_id", weight.alias("weight"))


def group_sums(df: DataFrame, group: str, values: list[str], by: list[str] = ()) -> DataFrame:
    """by, group, n and the sums of additive values."""
    return df.groupBy(*by, group).agg(F.count("*").alias("n"), *(F.sum(v).alias(v) for v in values))


def resampled(draws: DataFrame, sums: DataFrame, values: list[str], weight: str = "weight", by: list[str] = ()) -> DataFrame:
    """replicate, by, and per value sum(w * total) / sum(w * n)."""
    # Draws made in Python look as small as their list of tasks to the optimiser, which would broadcast them.
    j = draws.join(sums.hint("shuffle_hash"), "group_id")
    return j.groupBy("replicate", *by).agg(*((F.sum(F.col(weight) * F.col(v)) / F.sum(F.col(weight) * F.col("n"))).alias(v) for v in values))


def intervals(df: DataFrame, by: list[str], value: str, levels: list[float]) -> DataFrame:
    """by, level, quantile (linear interpolation) of a value over replicates."""
    q = df.groupBy(*by).agg(F.percentile(value, F.array(*(F.lit(x) for x in levels))).alias("q"))
    return q.select(*by, F.posexplode("q").alias("i", "quantile")).select(*by, F.element_at(F.array(*(F.lit(x) for x in levels)), F.col("i") + 1).alias("level"), "quantile")


def leave_one_out(sums: DataFrame, values: list[str]) -> DataFrame:
    """group_id, n, and per value the mean without the group and its shift from the mean over all. Totals are one row."""
    t = sums.agg(F.sum("n").alias("_n"), *(F.sum(v).alias(f"_{v}") for v in values))
    j = sums.join(F.broadcast(t), F.lit(True))
    loo = lambda v: (F.col(f"_{v}") - F.col(v)) / (F.col("_n") - F.col("n"))
    return j.select("group_id", "n", *(loo(v).alias(f"loo_{v}") for v in values), *((loo(v) - F.col(f"_{v}") / F.col("_n")).alias(f"shift_{v}") for v in values))


def multiplicity_correlation(draws: DataFrame, results: DataFrame, values: list[str], weight: str = "weight") -> DataFrame:
    """group_id, corr_<value>: correlation over replicates of a group's multiplicity with the replicate's value.

    Replicates that miss a group have multiplicity 0 and need no row in draws. Null where either does not vary. results: one row
    a replicate; its mean is taken off before sums are formed, so nothing cancels.
    """
    means = results.agg(F.count("*").alias("_r"), *(F.avg(v).alias(f"_m_{v}") for v in values), *(F.var_pop(v).alias(f"_v_{v}") for v in values))
    at = draws.select("replicate", "group_id", F.col(weight).cast("double").alias("_w")).join(results.join(F.broadcast(means), F.lit(True)), "replicate")  # means: one row
    off = lambda v: F.col(v) - F.col(f"_m_{v}")
    sums = at.groupBy("group_id").agg(F.max("_r").alias("_r"), F.sum("_w").alias("_s"), F.sum(F.col("_w") * F.col("_w")).alias("_q"), *(F.sum(F.col("_w") * off(v)).alias(f"_c_{v}") for v in values), *(F.max(f"_v_{v}").alias(f"_v_{v}") for v in values))
    spread = F.col("_q") / F.col("_r") - (F.col("_s") / F.col("_r")) * (F.col("_s") / F.col("_r"))
    corr = lambda v: F.when((spread > 1e-12) & (F.col(f"_v_{v}") > 0), F.col(f"_c_{v}") / F.col("_r") / F.sqrt(spread * F.col(f"_v_{v}")))
    return sums.select("group_id", *(corr(v).alias(f"corr_{v}") for v in values))


def influential(loo: DataFrame, values: list[str], largest: int = 10) -> DataFrame:
    """The rows of leave_one_out for the largest groups by (-n, group_id) and for the group of the largest absolute shift of each value.

    Ties of a shift go to the least group. A group comes once, with why: a sorted array of 'size' and value names.
    """
    top = loo.orderBy(F.desc("n"), "group_id").limit(largest).select("group_id", F.lit("size").alias("why"))
    first = [loo.agg(F.min_by("group_id", F.struct(-F.abs(f"shift_{v}"), "group_id")).alias("group_id")).where("group_id IS NOT NULL").select("group_id", F.lit(v).alias("why")) for v in values]
    for f in first:
        top = top.unionByName(f)
    named = top.groupBy("group_id").agg(F.array_sort(F.collect_set("why")).alias("why"))  # at most largest + len(values) rows
    return loo.join(F.broadcast(named), "group_id")


def distribution(df: DataFrame, value: str, levels: list[float]) -> DataFrame:
    """One row: mean, sd (sample), moment skewness and excess kurtosis, quantiles."""
    return df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.skewness(value).alias("skewness"), F.kurtosis(value).alias("excess_kurtosis"), *(F.percentile(value, F.lit(x)).alias(f"q_{str(x).replace('.', '_')}") for x in levels))


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """bin, n of equal bins between least and greatest value, the last closed; empty bins are 0. The range is one row."""
    r = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = F.when(F.col("_hi") == F.col("_lo"), bins // 2).otherwise(F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)))
    got = df.where(F.col(value).isNotNull()).join(F.broadcast(r), F.lit(True)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").fillna(0, ["n"])


def support_pilot(matrix: DataFrame, draws: DataFrame, groups: int) -> DataFrame:
    """class, samples, groups, effective_groups, largest, absence (1 - m/G)^G and the share of draws that miss the class.

    matrix: (group_id, class, n); draws: (replicate, group_id, multiplicity), of G groups each.
    """
    base = matrix.groupBy("class").agg(F.sum("n").alias("samples"), F.count("*").alias("groups"), (F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("effective_groups"), F.max("n").alias("largest"))
    base = base.withColumn("absence", F.pow(1 - F.col("groups") / F.lit(float(groups)), F.lit(groups)))
    hit = draws.where("multiplicity > 0").join(matrix, "group_id").select("replicate", "class").distinct().groupBy("class").agg(F.count("*").alias("hits"))
    reps = draws.agg(F.count_distinct("replicate").alias("replicates"))
    return base.join(hit, "class", "left").join(F.broadcast(reps), F.lit(True)).withColumn("missed_share", 1 - F.coalesce("hits", F.lit(0)) / F.col("replicates")).drop("hits", "replicates")
