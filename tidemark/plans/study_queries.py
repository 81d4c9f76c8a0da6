"""Whole studies: calibrate, weigh, measure drift, select, evaluate; and dataset scans with remapped labels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators import calibration, cohort, drift, metrics, resample, simulation
from tidemark.plans import model_queries as mq
from tidemark.plans.registry import query
from tidemark.plans.select_queries import COHORT, _cohort
from tidemark.plans.tables import FOLDS, FUSED, LOGITS, MANIFEST, TRAIN, folds, fused, inventory, logits, manifest, predictions

R = mq.R


@query("S11_S12_S13_month_dataset", f"WITH {MANIFEST}, {COHORT}, i AS (SELECT family, row_number() OVER (ORDER BY family) - 1 AS class_index FROM k) SELECT m.sha, i.class_index FROM m JOIN i ON m.family = i.family WHERE m.split = 'test' AND m.month = '2020-05'")
def s11(spark, d):
    i = cohort.class_index(_cohort(spark, d), "family")
    return manifest(spark, d).where("split = 'test' AND month = '2020-05'").join(F.broadcast(i), "family").select("sha", "class_index")


@query("S15_episode_labels", f"WITH {MANIFEST}, {FOLDS}, e AS (SELECT family, row_number() OVER (ORDER BY family) - 1 AS episode_label FROM (SELECT DISTINCT family FROM f WHERE retained AND family IS NOT NULL)) SELECT DISTINCT m.sha, e.episode_label FROM m JOIN e ON m.family = e.family WHERE m.split = 'train'")
def s15(spark, d):
    e = cohort.class_index(folds(spark, d).where("retained"), "family").withColumnRenamed("class_index", "episode_label")
    return manifest(spark, d).where("split = 'train'").join(F.broadcast(e), "family").select("sha", "episode_label").distinct()


@query("S19_inventory_cross_check", f"WITH {MANIFEST}, {TRAIN} SELECT count(*) AS pairs, count(*) FILTER (m.family IS NOT DISTINCT FROM t.family) AS same_family, count(*) FILTER (m.ts = t.ts) AS same_time FROM m JOIN t ON m.sha = t.sha")
def s19(spark, d):
    t = inventory(spark, d, "train_tlsh").select("sha", F.col("family").alias("tf"), F.col("ts").alias("tt"))
    return manifest(spark, d).join(t, "sha").agg(F.count("*").alias("pairs"), F.count_if(F.col("family").eqNullSafe(F.col("tf"))).alias("same_family"), F.count_if(F.col("ts") == F.col("tt")).alias("same_time"))


def _calibrated(spark, d):
    """B rows (months 3-5) of seed 0 at temperatures fitted on A (months 0-2), per view."""
    g = logits(spark, d).where("seed = 0")
    t = calibration.fit_temperatures(g.where("month < 3"), ["view"], "z")
    b = g.where("month >= 3").join(F.broadcast(t), "view")
    return metrics.sample_metrics(b.withColumn("logp", metrics.log_softmax(F.col("z"), F.col("temperature"))))


@query("E02_calibrate_a_score_b")
def e02(spark, d):
    return metrics.summary(_calibrated(spark, d), ["view"], 10)


def _z_stages(spark, d):
    """A and B on the reference's z-scores, and the bandwidth of the reference's pairs."""
    z = mq._reference_z(spark, d, mq._staged(spark, d))
    return z.where("stage = 'A'"), z.where("stage = 'B'"), mq._bandwidth(spark, d).first()[0]


@query("E20_rank_and_condition")
def e20(spark, d):
    z = mq._z(spark, d).where("stage = 'train'").withColumn("w", F.lit(1.0))
    rank, cond = drift.rank_and_condition(z, "e", "w")
    return spark.createDataFrame([(rank, cond)], "rank int, condition double")


@query("E21_drift_measurement")
def e21(spark, d):
    a, b, h = _z_stages(spark, d)
    return drift.class_mmd2(a, b, "label", "e", h).agg(F.avg("mmd2").alias("mmd2")).select(F.lit(h).alias("bandwidth"), "mmd2", (F.col("mmd2") / 2).alias("drift"))


@query("E23_sampling_sensitivity")
def e23(spark, d):
    a, b, h = _z_stages(spark, d)
    r = F.row_number().over(W.partitionBy("label").orderBy(F.sha2(F.col("vec_id").cast("string"), 256), "vec_id"))
    cap = lambda x: x.withColumn("r", r).where("r <= 64").drop("r")
    mass = lambda x: drift.group_mass(x, ["label"], "group_id")
    arms = {"primary": drift.class_mmd2(a, b, "label", "e", h), "cap64": drift.class_mmd2(cap(a), cap(b), "label", "e", h), "group_balanced": drift.class_mmd2(mass(a), mass(b), "label", "e", h, "weight")}
    out = None
    for name, x in arms.items():
        x = x.agg(F.avg("mmd2").alias("mmd2")).select(F.lit(name).alias("arm"), "mmd2")
        out = x if out is None else out.unionByName(x)
    return out


@query("E28_bootstrap_flags")
def e28(spark, d):
    """Distribution of the bootstrap of uniform minus first view, with the flags |skew| > 2 or kurtosis > 10."""
    u = fused(spark, d).where("seed = 0").select("vec_id", "group_id", F.col("nll").alias("a"))
    v = predictions(spark, d).where("seed = 0 AND view = 0").select("vec_id", F.col("nll").alias("b"))
    s = resample.group_sums(u.join(v, "vec_id").withColumn("delta", F.col("a") - F.col("b")), "group_id", ["delta"])
    groups = [r[0] for r in s.select("group_id").orderBy("group_id").collect()]
    draws = resample.multinomial_draws(spark, groups).withColumnRenamed("multiplicity", "weight")
    x = resample.distribution(resample.resampled(draws, s, ["delta"]), "delta", [0.025, 0.5, 0.975])
    return x.withColumn("flagged", (F.abs("skewness") > 2) | (F.col("excess_kurtosis") > 10))


@query("E31_uncertainty_simulation")
def e31(spark, d):
    return simulation.summary(simulation.run(spark, [1, 2, 3, 4, 5, 6, 7]))


@query("E35_V05_view_composition")
def e35(spark, d):
    """Temperature on A, class-balanced loss on B, drift from A to B, and the weights that follow, per view."""
    loss = metrics.balanced_loss(_calibrated(spark, d), ["view"], "label", "nll").withColumnRenamed("class_balanced", "loss")
    a, b, h = _z_stages(spark, d)
    q = drift.class_mmd2(a, b, "label", "e", h).agg((F.avg("mmd2") / 2).alias("drift"))
    both = loss.join(F.broadcast(q), F.lit(True)).withColumn("k", F.lit(0))
    w = metrics.softmax_weights(both, ["k"], -F.col("loss")).withColumnRenamed("weight", "q_weight")
    return metrics.softmax_weights(w, ["k"], -F.col("loss") - F.col("drift")).withColumnRenamed("weight", "qd_weight").drop("k")


@query("V08_V14_readback", f"WITH {LOGITS}{FUSED} SELECT seed, count(*) AS samples, min(abs(list_sum(list_transform(range(1, 11), lambda i: (exp(logp[i]) - CASE WHEN i = label + 1 THEN 1 ELSE 0 END) * (exp(logp[i]) - CASE WHEN i = label + 1 THEN 1 ELSE 0 END))) - brier) <= 1e-12 AND abs(list_sum(list_transform(logp, lambda x: exp(x))) - 1) <= 1e-12) AS agrees FROM u GROUP BY seed")
def v08(spark, d):
    """Two forms of Brier and NLL of the mixture agree within 1e-12 on every sample."""
    u = fused(spark, d)
    p = F.transform("logp", F.exp)
    direct = F.aggregate(F.transform(p, lambda x, i: (x - (i == F.col("label")).cast("double")) * (x - (i == F.col("label")).cast("double"))), F.lit(0.0), lambda s, x: s + x)
    ok = (F.abs(direct - F.col("brier")) <= 1e-12) & (F.abs(F.aggregate(p, F.lit(0.0), lambda s, x: s + x) - 1) <= 1e-12)
    return u.groupBy("seed").agg(F.count("*").alias("samples"), F.min(ok).alias("agrees"))


@query("V16_package", f"WITH {LOGITS}{mq.QUALITY} SELECT seed, 'view' || view AS view, round(loss, 6) AS loss, round(exp(-loss) / sum(exp(-loss)) OVER (PARTITION BY seed), 6) AS weight FROM ql")
def v16(spark, d):
    """Signals and weights of every seed and view, composed as nested structs and read back as rows."""
    w = metrics.softmax_weights(mq._losses(spark, d), ["seed"], -F.col("loss"))
    packed = w.groupBy("seed").agg(F.collect_list(F.struct(F.concat(F.lit("view"), "view").alias("view"), "loss", "weight")).alias("views"))
    return packed.select("seed", F.inline("views")).select("seed", "view", R("loss"), R("weight"))


@query("K09_K10_long_tables", f"WITH {LOGITS}{FUSED}{mq.METHODS} SELECT seed, method, 'mean_month' AS metric, round(mean_month, 6) AS value FROM ps UNION ALL SELECT seed, method, 'worst_month', round(worst_month, 6) FROM ps")
def k09(spark, d):
    from tidemark.sources.sinks import long_table

    x = metrics.mean_and_worst(mq._by_method(spark, d), ["seed", "method"], "value")
    return long_table(x, ["seed", "method"], ["mean_month", "worst_month"]).withColumn("value", F.round("value", 6))
