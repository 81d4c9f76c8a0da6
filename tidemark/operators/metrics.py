"""Probabilities and classification metrics over rows of (keys, sample, label, logits or log-probabilities)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def log_softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Stable log-softmax of logits / temperature."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    z = F.transform(logits, lambda x: x.cast("double") / t)
    top = F.array_max(z)
    total = F.log(F.aggregate(F.transform(z, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x))
    return F.transform(z, lambda x: x - top - total)


def argmax(a: Column) -> Column:
    """Index of the largest element, the lowest one on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def mixture(logs: list[Column], weights: list[Column | float] | None = None) -> Column:
    """Log of the weighted mean of probabilities given as log-probability arrays; views of weight 0 are dropped."""
    w = [F.lit(1.0 / len(logs))] * len(logs) if weights is None else [x if isinstance(x, Column) else F.lit(float(x)) for x in weights]
    stacked = F.arrays_zip(*(x.alias(f"v{i}") for i, x in enumerate(logs)))

    def one(s: Column) -> Column:
        terms = F.array(*(F.when(w[i] > 0, s[str(i)] + F.log(w[i])) for i in range(len(logs))))
        terms = F.filter(terms, lambda x: x.isNotNull())
        top = F.array_max(terms)
        return top + F.log(F.aggregate(F.transform(terms, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x))

    del stacked
    zipped = F.transform(F.sequence(F.lit(0), F.size(logs[0]) - 1), lambda i: F.struct(*(x[i].alias(str(n)) for n, x in enumerate(logs))))
    return F.transform(zipped, one)


def sample_metrics(df: DataFrame, label: str = "label", logp: str = "logp") -> DataFrame:
    """Adds predicted, correct, nll, brier (summed over classes) and confidence."""
    p = F.transform(F.col(logp), F.exp)
    brier = F.aggregate(F.transform(p, lambda x: x * x), F.lit(0.0), lambda a, x: a + x) - 2 * p[F.col(label)] + 1
    return df.select("*", argmax(F.col(logp)).alias("predicted"), (-F.col(logp)[F.col(label)]).alias("nll"), brier.alias("brier"), F.array_max(p).alias("confidence")).withColumn("correct", (F.col("predicted") == F.col(label)).cast("int"))


def confusion(df: DataFrame, by: list[str], label: str = "label", predicted: str = "predicted", classes: int | None = None) -> DataFrame:
    """by, label, predicted, n; with `classes` the dense grid, zeros included."""
    c = df.groupBy(*by, F.col(label).cast("int").alias("label"), F.col(predicted).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    if classes is None:
        return c
    axis = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
    grid = axis.join(axis.withColumnRenamed("label", "predicted"), F.lit(True))
    grid = df.select(*by).distinct().join(F.broadcast(grid), F.lit(True)) if by else grid
    return grid.join(c, [*by, "label", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def per_class(conf: DataFrame, by: list[str], classes: int) -> DataFrame:
    """by, label, support, predicted_count, tp, recall (null without support), f1 (0 where undefined), from confusion counts."""
    both = conf.select(*by, F.explode(F.array(F.struct(F.col("label").alias("c"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"), F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("t")), F.struct(F.col("predicted").alias("c"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"), F.lit(0).cast("long").alias("t")))).alias("x"))
    got = both.groupBy(*by, F.col("x.c").alias("label")).agg(F.sum("x.s").alias("support"), F.sum("x.p").alias("predicted_count"), F.sum("x.t").alias("tp"))
    axis = F.broadcast(conf.sparkSession.range(classes).select(F.col("id").cast("int").alias("label")))
    grid = conf.select(*by).distinct().join(axis, F.lit(True)) if by else axis
    full = grid.join(got, [*by, "label"], "left").fillna(0, ["support", "predicted_count", "tp"])
    total = F.col("support") + F.col("predicted_count")
    return full.withColumn("recall", F.when(F.col("support") > 0, F.col("tp") / F.col("support"))).withColumn("f1", F.when(total > 0, 2 * F.col("tp") / total).otherwise(0.0))


def summary(df: DataFrame, by: list[str], classes: int, label: str = "label") -> DataFrame:
    """by, samples, supported_classes, accuracy, macro_f1_supported, macro_f1_fixed, balanced_accuracy, nll, brier, ece_15.

    df as from sample_metrics. One aggregate for the sample means, one over the small confusion counts, one over bins.
    """
    means = df.groupBy(*by).agg(F.count("*").alias("samples"), F.avg("correct").alias("accuracy"), F.avg("nll").alias("nll"), F.avg("brier").alias("brier"))
    pc = per_class(confusion(df, by, label), by, classes).groupBy(*by).agg(
        F.count_if(F.col("support") > 0).alias("supported_classes"), F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1_supported"), F.avg("f1").alias("macro_f1_fixed"), F.avg("recall").alias("balanced_accuracy")
    )
    e = bins(df, by).groupBy(*by).agg(F.sum(F.col("count") * F.abs(F.col("accuracy") - F.col("mean_confidence"))).alias("_e"))
    out = means.join(pc, by).join(e, by) if by else means.join(pc, F.lit(True)).join(e, F.lit(True))
    return out.withColumn("ece_15", F.col("_e") / F.col("samples")).drop("_e")


def bins(df: DataFrame, by: list[str], n: int = 15) -> DataFrame:
    """by, bin, count, accuracy, mean_confidence of the non-empty confidence bins."""
    return df.groupBy(*by, F.least(F.floor(F.col("confidence") * n), F.lit(n - 1)).cast("int").alias("bin")).agg(F.count("*").alias("count"), F.avg("correct").alias("accuracy"), F.avg("confidence").alias("mean_confidence"))


def all_bins(df: DataFrame, by: list[str], n: int = 15) -> DataFrame:
    """As bins, with the empty ones: count 0, and null accuracy and confidence."""
    axis = F.broadcast(df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin")))
    grid = df.select(*by).distinct().join(axis, F.lit(True)) if by else axis
    return grid.join(bins(df, by, n), [*by, "bin"], "left").fillna(0, ["count"])


def balanced_loss(df: DataFrame, by: list[str], label: str, loss: str, support: DataFrame | None = None) -> DataFrame:
    """by, class_balanced: the mean over classes of the mean loss in the class; support (label) fixes the classes.

    A class of the support without samples makes the result null, never a smaller denominator.
    """
    per = df.groupBy(*by, label).agg(F.avg(loss).alias("_m"))
    if support is not None:
        grid = df.select(*by).distinct().join(F.broadcast(support.select(label).distinct()), F.lit(True))
        per = grid.join(per, [*by, label], "left")
    return per.groupBy(*by).agg(F.when(F.count("*") == F.count("_m"), F.avg("_m")).alias("class_balanced"))


def softmax_weights(df: DataFrame, by: list[str], score: Column) -> DataFrame:
    """Adds weight: softmax of score within each key (a key's views are few)."""
    w = W.partitionBy(*by)
    d = df.withColumn("_s", score)
    d = d.withColumn("_x", F.exp(F.col("_s") - F.max("_s").over(w)))
    return d.withColumn("weight", F.col("_x") / F.sum("_x").over(w)).drop("_s", "_x")


def fixed_support_f1(df: DataFrame, by: list[str], support: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """by + f1: mean F1 over the classes of support (by or part of by, label), 0 where a class has neither truth nor prediction."""
    keys = [c for c in by if c in support.columns]
    t = df.groupBy(*by, F.col(label).alias("label")).agg(F.count("*").alias("s"), F.count_if(F.col(label) == F.col(predicted)).alias("tp"))
    p = df.groupBy(*by, F.col(predicted).alias("label")).agg(F.count("*").alias("p"))
    grid = df.select(*by).distinct().join(F.broadcast(support.select(*keys, "label").distinct()), keys if keys else F.lit(True))
    j = grid.join(t, [*by, "label"], "left").join(p, [*by, "label"], "left").fillna(0, ["s", "tp", "p"])
    return j.groupBy(*by).agg(F.avg(F.when(F.col("s") + F.col("p") > 0, 2 * F.col("tp") / (F.col("s") + F.col("p"))).otherwise(0.0)).alias("f1"))


def mean_and_worst(monthly: DataFrame, by: list[str], value: str) -> DataFrame:
    """by (seed and method), mean_month, worst_month: the worst within a seed, before any mean over seeds."""
    return monthly.groupBy(*by).agg(F.avg(value).alias("mean_month"), F.min(value).alias("worst_month"))


def spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, mean, sample_sd, least, most."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sample_sd"), F.min(value).alias("least"), F.max(value).alias("most"))


def contrasts(per_seed: DataFrame, pairs: list[tuple[str, str]], method: str, seed: str, values: list[str]) -> DataFrame:
    """left_method, right_method, outcome and the spread of the paired seed differences."""
    s = per_seed.sparkSession
    p = F.broadcast(s.createDataFrame(pairs, "left_method string, right_method string"))
    long = per_seed.select(method, seed, F.inline(F.array(*(F.struct(F.lit(v).alias("outcome"), F.col(v).alias("value")) for v in values))))
    a = long.join(p, F.col(method) == F.col("left_method")).select(seed, "outcome", "left_method", "right_method", F.col("value").alias("a"))
    b = long.select(F.col(method).alias("right_method"), seed, "outcome", F.col("value").alias("b"))
    return spread(a.join(b, ["right_method", seed, "outcome"]).withColumn("d", F.col("a") - F.col("b")), ["left_method", "right_method", "outcome"], "d")
