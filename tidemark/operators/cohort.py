"""Selection of classes and samples by time: months, periods, stages, eligibility, buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.ranking import global_rank
from tidemark.session import Scratch


def utc_month(ts: Column) -> Column:
    """yyyy-MM in UTC of a timestamp (the session's zone is UTC)."""
    return F.date_format(ts, "yyyy-MM")


def period(ts: Column, bounds: list[tuple[str, str, str]]) -> Column:
    """The name of the half-open period [start, end) that holds ts, else null; bounds are (name, start, end)."""
    out = None
    for name, start, end in bounds:
        inside = (ts >= F.lit(start).cast("timestamp")) & (ts < F.lit(end).cast("timestamp"))
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def stage(month: Column, train_from: str, train_end: str, stages: dict[str, str]) -> Column:
    """train for months in [train_from, train_end), else the stage whose month it is, else null."""
    out = F.when((month >= train_from) & (month < train_end), "train")
    for name, m in stages.items():
        out = out.when(month == m, name)
    return out


def eligible(df: DataFrame, cls: str, sample: str, month: str, min_samples: int = 50, min_months: int = 3, when: Column | None = None, keep_all: bool = False) -> DataFrame:
    """Distinct samples and months per class; keeps classes that reach both minima, or all with a flag.

    when: only rows for which it is true are counted, but with keep_all every class is reported, with zeros if need be.
    Both distinct counts come from one pass over (class, sample, month) states, so no row is expanded.
    """
    on = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    states = df.groupBy(cls, F.when(on, F.col(sample)).alias("_s"), F.when(on, F.col(month)).alias("_m")).agg(F.lit(1).alias("_1"))
    out = states.groupBy(cls).agg(F.count_distinct("_s").alias("samples"), F.count_distinct("_m").alias("months"))
    ok = (F.col("samples") >= min_samples) & (F.col("months") >= min_months)
    return out.withColumn("eligible", ok) if keep_all else out.where(ok)


def class_index(classes: DataFrame, cls: str) -> DataFrame:
    """class, class_index: 0.. in the order of names. Classes of a study are few: one window over them."""
    return classes.select(cls).where(F.col(cls).isNotNull()).distinct().select(cls, (F.row_number().over(W.orderBy(cls)) - 1).alias("class_index"))


def kind(cls: str, cohort: DataFrame, df: DataFrame) -> DataFrame:
    """Adds kind: known_class, unknown_class, or benign where the class is null or blank."""
    known = cohort.select(F.col(cls)).distinct().withColumn("_known", F.lit(True))
    blank = F.col(cls).isNull() | (F.trim(cls) == "")
    return df.join(known, cls, "left").withColumn("kind", F.when(blank, "benign").when(F.col("_known"), "known_class").otherwise("unknown_class")).drop("_known")


def size_bucket(size: Column, cutoffs: list[float]) -> Column:
    """Right-closed bucket: the number of cutoffs below size."""
    return sum((size > q).cast("int") for q in cutoffs) + F.lit(0)


def confidence_bin(c: Column, bins: int = 15) -> Column:
    """floor(bins * c), the last bin closed."""
    return F.least(F.floor(c * bins), F.lit(bins - 1)).cast("int")


def simplex(w: Column, n: int = 3, tol: float = 1e-12) -> Column:
    """Whether an array holds n finite weights, none negative, of sum 1 within tol."""
    fine = F.forall(w, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")))
    return F.coalesce((F.size(w) == n) & fine & (F.abs(F.aggregate(w, F.lit(0.0), lambda a, x: a + x) - 1) <= tol), F.lit(False))


def zero_filled(counts: DataFrame, keys: dict[str, DataFrame], value: str) -> DataFrame:
    """Counts on the whole grid of small dimensions (one-column tables), with 0 where nothing was counted."""
    grid = None
    for k, dim in keys.items():
        d = dim.select(k).distinct()
        grid = d if grid is None else grid.join(F.broadcast(d), F.lit(True))
    return grid.join(counts, list(keys), "left").withColumn(value, F.coalesce(value, F.lit(0)))


def first_copies(df: DataFrame, content: str, ts: str, sample: str) -> DataFrame:
    """Adds first_sample: the first sample, by (ts, sample), with the same content; null contents have none.

    An aggregate and a join, so a content that many rows share is combined before it is moved.
    """
    first = df.where(F.col(content).isNotNull()).groupBy(content).agg(F.min_by(sample, F.struct(ts, sample)).alias("first_sample"))
    return df.join(first, content, "left")


def evenly_spaced(df: DataFrame, order: list[str], scratch: Scratch, picks: int = 10) -> DataFrame:
    """The rows at ranks i * (n - 1) // (picks - 1) of the given total order, i = 0..picks-1, with rank_index."""
    ranked = global_rank(df, order, scratch)
    n = ranked.count()
    wanted = sorted({i * (n - 1) // (picks - 1) for i in range(picks)}) if n else [-1]
    return ranked.where(F.col("rank_index").isin(wanted))


def group_summary(df: DataFrame, group: str, cls: str, retained: Column) -> DataFrame:
    """Per group: all, retained and excluded samples, classes of all and of retained, and the class names joined by |."""
    kept = F.coalesce(retained, F.lit(False))
    per = df.groupBy(group, cls).agg(F.count("*").alias("n"), F.sum(kept.cast("int")).alias("k"))
    return per.groupBy(group).agg(
        F.sum("n").alias("all_samples"), F.sum("k").alias("retained_samples"), (F.sum("n") - F.sum("k")).alias("excluded_samples"),
        F.count(cls).alias("class_count_all"), F.count(F.when(F.col("k") > 0, F.col(cls))).alias("class_count_retained"), F.array_join(F.array_sort(F.collect_set(cls)), "|").alias("classes"),
    )


def identical_groups(df: DataFrame, key: str, sample: str, content: str, cls: str, month: str) -> DataFrame:
    """Groups of two or more samples of one key: samples, pairs, distinct contents, classes and months."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(sample).alias("samples"), F.count_distinct(content).alias("unique_contents"), F.count_distinct(cls).alias("class_count"), F.count_distinct(month).alias("month_count"))
    return g.where("samples >= 2").withColumn("pairs", F.expr("samples * (samples - 1) div 2"))


def graph_summary(members: DataFrame, group: str, cls: str, stage_col: str, retained: str) -> DataFrame:
    """One row: groups, active groups, largest, several-class and several-stage groups, and (sum s)^2 / sum s^2."""
    g = members.groupBy(group).agg(F.sum(F.col(retained).cast("int")).alias("s"), F.count_distinct(F.when(F.col(retained), F.col(cls))).alias("c"), F.count_distinct(F.when(F.col(retained), F.col(stage_col))).alias("t"))
    active = F.col("s") > 0
    return g.agg(
        F.count("*").alias("all_groups"), F.count_if(active).alias("active_groups"), F.max("s").alias("largest_retained_group"), F.count_if(active & (F.col("c") > 1)).alias("multi_label_active_groups"),
        F.count_if(active & (F.col("t") > 1)).alias("cross_stage_active_groups"), F.coalesce(F.sum(F.when(F.col("t") > 1, F.col("s"))), F.lit(0)).alias("samples_in_cross_stage_groups"),
        F.round(F.sum("s") * F.sum("s") / F.sum(F.col("s") * F.col("s")), 6).alias("size_concentration"),
    )


def size_histogram(members: DataFrame, group: str, retained: str) -> DataFrame:
    """size, groups: how many groups have so many retained members."""
    return members.where(F.col(retained)).groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def support_table(members: DataFrame, classes: DataFrame, cls: str, stage_col: str, group: str, retained: str, outcomes: DataFrame, min_samples: int = 20, min_groups: int = 5, stages: tuple[str, str] = ("A", "B")) -> DataFrame:
    """Per class and stage: samples, groups, largest group; eligible with enough of both in every stage; S_eval adds outcomes > 0.

    Classes without members are reported with zeros. outcomes: (class, n).
    """
    g = members.where(F.col(retained)).groupBy(cls, stage_col, group).agg(F.count("*").alias("n"))
    cols = []
    for s in stages:
        here = F.when(F.col(stage_col) == s, F.col("n"))
        cols += [F.coalesce(F.sum(here), F.lit(0)).alias(f"{s}_samples"), F.count(here).alias(f"{s}_groups"), F.coalesce(F.max(here), F.lit(0)).alias(f"{s}_largest_group")]
    per = classes.select(cls).distinct().join(g, cls, "left").groupBy(cls).agg(*cols)
    ok, reasons = F.lit(True), []
    for s in stages:
        few, thin = F.col(f"{s}_samples") < min_samples, F.col(f"{s}_groups") < min_groups
        ok = ok & ~few & ~thin
        reasons += [F.when(few, f"{s}:samples<{min_samples}"), F.when(thin, f"{s}:groups<{min_groups}")]
    out = per.join(outcomes.select(cls, F.col("n").alias("C_samples")), cls, "left").withColumn("C_samples", F.coalesce("C_samples", F.lit(0)))
    return out.withColumn("eligible_S", ok).withColumn("failure_reasons", F.concat_ws("|", *reasons)).withColumn("S_eval", F.col("eligible_S") & (F.col("C_samples") > 0))


def fold_support(manifest: DataFrame, cls: str, group: str, fold: str, folds: int = 5) -> DataFrame:
    """Per class: samples, groups, samples per fold, in_support (20 samples and 5 groups), least number of fit samples."""
    m = manifest.groupBy(cls).agg(F.count("*").alias("samples"), F.count_distinct(group).alias("groups"), *(F.count_if(F.col(fold) == f).alias(f"fold_{f}_score") for f in range(folds)))
    return m.withColumn("in_support", (F.col("samples") >= 20) & (F.col("groups") >= 5)).withColumn("minimum_fit_samples", F.col("samples") - F.greatest(*(f"fold_{f}_score" for f in range(folds))))


def fold_summary(manifest: DataFrame, cls: str, group: str, fold: str) -> DataFrame:
    """Per fold: fit and score samples, groups and classes scored. The total joins back as one row a fold."""
    per = manifest.groupBy(fold).agg(F.count("*").alias("score_samples"), F.count_distinct(group).alias("score_groups"), F.count_distinct(cls).alias("score_classes"))
    return per.withColumn("fit_samples", F.sum("score_samples").over(W.partitionBy()) - F.col("score_samples"))


def support_matrix(members: DataFrame, group: str, cls: str) -> DataFrame:
    """group, class, n in long form."""
    return members.groupBy(group, cls).agg(F.count("*").alias("n"))


def incidence(df: DataFrame, group: str, cls: str) -> DataFrame:
    """One row: groups, groups of several classes, samples in these, largest group."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(cls).alias("c"))
    return g.agg(F.count("*").alias("groups"), F.count_if(F.col("c") > 1).alias("multi_class_groups"), F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("n"))), F.lit(0)).alias("samples_in_multi_class_groups"), F.max("n").alias("largest_group"))


def equal_side_capacity(df: DataFrame, by: list[str], size: str) -> DataFrame:
    """Per key the largest equal budget of two sides when whole groups are split between them.

    Subset sums up to half the total, as bits of one integer, by one task a key. Equal sizes are counted first and
    enter as powers of two times the size, so a key takes as many steps as it has distinct sizes, times a logarithm.
    """
    counts = df.groupBy(*by, size).agg(F.count("*").alias("_n"))

    def best(pdf):
        total = int((pdf[size].astype("int64") * pdf["_n"]).sum())
        bits, mask = 1, (1 << (total // 2 + 1)) - 1
        for s, n in zip(pdf[size].astype(int), pdf["_n"].astype(int)):
            k, s, n = 1, int(s), int(n)
            while n > 0:
                take = min(k, n)
                bits |= (bits << (s * take)) & mask
                n, k = n - take, 2 * k
        return pdf[by].head(1).assign(capacity=bits.bit_length() - 1)

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by) + ", capacity long"
    return counts.groupBy(*by).applyInPandas(best, schema)


def ranked_by_hash(df: DataFrame, by: list[str], ids: list[str], prefix: Column, cap: int) -> DataFrame:
    """The first `cap` rows of each key in the order of SHA-256 of the compact JSON array prefix + ids, with its hash."""
    text = F.concat(F.lit("["), prefix, *(x for i in ids for x in (F.lit(',"'), F.col(i).cast("string"), F.lit('"'))), F.lit("]"))
    h = df.withColumn("rank_hash", F.sha2(text, 256))
    r = F.row_number().over(W.partitionBy(*by).orderBy("rank_hash", *ids))
    return h.withColumn("rank", r).where(F.col("rank") <= cap)
