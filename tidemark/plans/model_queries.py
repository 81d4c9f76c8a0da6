"""Predictions, metrics, fusion, forecasts, drift and resampling over the embeddings table (see tables.logits)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators import calibration, cohort, drift, metrics, resample
from tidemark.plans.registry import query
from tidemark.plans.tables import CLASSES, FUSED, LOGITS, fused, logits, predictions
from tidemark.session import table

R = lambda c: F.round(c, 6).alias(c)


@query("B16_log_softmax", f"WITH {LOGITS} SELECT vec_id, seed, view, i - 1 AS class, round(logp[i], 6) AS logp FROM l, range(1, 11) t(i) WHERE seed = 0")
def b16(spark, d):
    g = logits(spark, d).where("seed = 0").select("vec_id", "seed", "view", F.posexplode(metrics.log_softmax(F.col("z"))).alias("class", "logp"))
    return g.withColumn("logp", F.round("logp", 6))


@query("B16_log_softmax_seeds", f"WITH {LOGITS} SELECT vec_id, seed, view, i - 1 AS class, round(logp[i], 6) AS logp FROM l, range(1, 11) t(i)")
def b16_seeds(spark, d):
    """All seeds; B16_log_softmax above keeps seed 0."""
    g = logits(spark, d).select("vec_id", "seed", "view", F.posexplode(metrics.log_softmax(F.col("z"))).alias("class", "logp"))
    return g.withColumn("logp", F.round("logp", 6))


@query("B17_argmax", f"WITH {LOGITS} SELECT vec_id, seed, view, predicted FROM p")
def b17(spark, d):
    return predictions(spark, d).select("vec_id", "seed", "view", F.col("predicted"))


@query("P10_confidence_bin", f"WITH {LOGITS} SELECT view, least(floor(confidence * 15), 14)::INT AS bin, count(*) AS n FROM p GROUP BY 1, 2")
def p10b(spark, d):
    return predictions(spark, d).groupBy("view", cohort.confidence_bin(F.col("confidence")).alias("bin")).agg(F.count("*").alias("n"))


@query("P11_simplex", "SELECT vec_id, abs(list_sum(list_transform(range(1, 4), lambda i: abs(embedding[i]::DOUBLE))) - 1) <= 0.5 AS near_simplex FROM embeddings")
def p11(spark, d):
    w = F.transform(F.slice("embedding", 1, 3), lambda x: F.abs(x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", cohort.simplex(w, 3, 0.5).alias("near_simplex"))


@query("A14_confusion", f"WITH {LOGITS} SELECT a.seed, a.view, b.i AS label, c.i AS predicted, count(p.vec_id) AS n FROM (SELECT DISTINCT seed, view FROM p) a CROSS JOIN range(10) b(i) CROSS JOIN range(10) c(i) LEFT JOIN p ON p.seed = a.seed AND p.view = a.view AND p.label = b.i AND p.predicted = c.i GROUP BY 1, 2, 3, 4")
def a14(spark, d):
    return metrics.confusion(predictions(spark, d), ["seed", "view"], classes=CLASSES)


PER_CLASS = """, t AS (SELECT seed, view, label AS c, count(*) AS s, count(*) FILTER (label = predicted) AS tp FROM p GROUP BY 1, 2, 3), q AS (SELECT seed, view, predicted AS c, count(*) AS pr FROM p GROUP BY 1, 2, 3),
pc AS (SELECT a.seed, a.view, b.i AS label, coalesce(t.s, 0) AS support, coalesce(q.pr, 0) AS predicted_count, coalesce(t.tp, 0) AS tp FROM (SELECT DISTINCT seed, view FROM p) a CROSS JOIN range(10) b(i) LEFT JOIN t ON t.seed = a.seed AND t.view = a.view AND t.c = b.i LEFT JOIN q ON q.seed = a.seed AND q.view = a.view AND q.c = b.i),
pf AS (SELECT *, CASE WHEN support > 0 THEN tp / support END AS recall, CASE WHEN support + predicted_count > 0 THEN 2 * tp / (support + predicted_count) ELSE 0 END AS f1 FROM pc)"""


@query("A15_per_class", f"WITH {LOGITS}{PER_CLASS} SELECT seed, view, label, support, predicted_count, tp, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pf")
def a15(spark, d):
    x = metrics.per_class(metrics.confusion(predictions(spark, d), ["seed", "view"]), ["seed", "view"], CLASSES)
    return x.select("seed", "view", "label", "support", "predicted_count", "tp", R("recall"), R("f1"))


BINS = ", bn AS (SELECT seed, view, least(floor(confidence * 15), 14)::INT AS bin, count(*) AS count, avg(CASE WHEN label = predicted THEN 1.0 ELSE 0 END) AS accuracy, avg(confidence) AS mean_confidence FROM p GROUP BY 1, 2, 3)"


@query("A16_A17_A18_summary", f"WITH {LOGITS}{PER_CLASS}{BINS}, sm AS (SELECT seed, view, count(*) AS samples, avg(CASE WHEN label = predicted THEN 1.0 ELSE 0 END) AS accuracy, avg(nll) AS nll, avg(brier) AS brier FROM p GROUP BY 1, 2), sc AS (SELECT seed, view, count(*) FILTER (support > 0) AS supported_classes, avg(f1) FILTER (support > 0) AS macro_f1_supported, avg(f1) AS macro_f1_fixed, avg(recall) AS balanced_accuracy FROM pf GROUP BY 1, 2), se AS (SELECT seed, view, sum(count * abs(accuracy - mean_confidence)) AS e FROM bn GROUP BY 1, 2) SELECT sm.seed, sm.view, samples, supported_classes, round(accuracy, 6) AS accuracy, round(nll, 6) AS nll, round(brier, 6) AS brier, round(macro_f1_supported, 6) AS macro_f1_supported, round(macro_f1_fixed, 6) AS macro_f1_fixed, round(balanced_accuracy, 6) AS balanced_accuracy, round(e / samples, 6) AS ece_15 FROM sm JOIN sc ON sm.seed = sc.seed AND sm.view = sc.view JOIN se ON sm.seed = se.seed AND sm.view = se.view")
def a16(spark, d):
    x = metrics.summary(predictions(spark, d), ["seed", "view"], CLASSES)
    return x.select("seed", "view", "samples", "supported_classes", *(R(c) for c in ("accuracy", "nll", "brier", "macro_f1_supported", "macro_f1_fixed", "balanced_accuracy", "ece_15")))


@query("A18_bins", f"WITH {LOGITS}{BINS} SELECT a.seed, a.view, b.i::INT AS bin, coalesce(bn.count, 0) AS count, round(bn.accuracy, 6) AS accuracy, round(bn.mean_confidence, 6) AS mean_confidence FROM (SELECT DISTINCT seed, view FROM p) a CROSS JOIN range(15) b(i) LEFT JOIN bn ON bn.seed = a.seed AND bn.view = a.view AND bn.bin = b.i")
def a18(spark, d):
    return metrics.all_bins(predictions(spark, d), ["seed", "view"]).select("seed", "view", "bin", "count", R("accuracy"), R("mean_confidence"))


@query("A21_balanced_loss", f"WITH {LOGITS}, b AS (SELECT seed, view, label, avg(nll) AS x FROM p GROUP BY 1, 2, 3) SELECT seed, view, round(avg(x), 6) AS class_balanced FROM b GROUP BY 1, 2")
def a21(spark, d):
    return metrics.balanced_loss(predictions(spark, d), ["seed", "view"], "label", "nll").select("seed", "view", R("class_balanced"))


@query("E03_uniform_fusion", f"WITH {LOGITS}{FUSED} SELECT vec_id, seed, i - 1 AS class, round(logp[i], 6) AS logp FROM x, range(1, 11) t(i) WHERE seed = 1")
def e03(spark, d):
    return fused(spark, d).where("seed = 1").select("vec_id", "seed", F.posexplode("logp").alias("class", "logp")).withColumn("logp", F.round("logp", 6))


@query("E04_weighted_fusion", f"WITH {LOGITS} SELECT a.vec_id, a.seed, i - 1 AS class, round(ln(0.25 * exp(a.logp[i]) + 0.75 * exp(c.logp[i])), 6) AS logp FROM l a JOIN l c ON a.vec_id = c.vec_id AND a.seed = c.seed AND a.view = 0 AND c.view = 2, range(1, 11) t(i) WHERE a.seed = 1")
def e04(spark, d):
    return fused(spark, d, [0.25, 0.0, 0.75]).where("seed = 1").select("vec_id", "seed", F.posexplode("logp").alias("class", "logp")).withColumn("logp", F.round("logp", 6))


@query("E03_uniform_fusion_seeds", f"WITH {LOGITS}{FUSED} SELECT vec_id, seed, i - 1 AS class, round(logp[i], 6) AS logp FROM x, range(1, 11) t(i)")
def e03_seeds(spark, d):
    """All seeds, as in E04_weighted_fusion_seeds; E03 and E04 above keep seed 1."""
    return fused(spark, d).select("vec_id", "seed", F.posexplode("logp").alias("class", "logp")).withColumn("logp", F.round("logp", 6))


@query("E04_weighted_fusion_seeds", f"WITH {LOGITS} SELECT a.vec_id, a.seed, i - 1 AS class, round(ln(0.25 * exp(a.logp[i]) + 0.75 * exp(c.logp[i])), 6) AS logp FROM l a JOIN l c ON a.vec_id = c.vec_id AND a.seed = c.seed AND a.view = 0 AND c.view = 2, range(1, 11) t(i)")
def e04_seeds(spark, d):
    return fused(spark, d, [0.25, 0.0, 0.75]).select("vec_id", "seed", F.posexplode("logp").alias("class", "logp")).withColumn("logp", F.round("logp", 6))


QUALITY = ", ql AS (SELECT seed, view, avg(x) AS loss FROM (SELECT seed, view, label, avg(nll) AS x FROM p GROUP BY 1, 2, 3) GROUP BY 1, 2)"


def _losses(spark, d):
    return metrics.balanced_loss(predictions(spark, d), ["seed", "view"], "label", "nll").withColumnRenamed("class_balanced", "loss")


@query("E06_quality_weights", f"WITH {LOGITS}{QUALITY} SELECT seed, view, round(exp(-loss) / sum(exp(-loss)) OVER (PARTITION BY seed), 6) AS weight FROM ql")
def e06(spark, d):
    return metrics.softmax_weights(_losses(spark, d), ["seed"], -F.col("loss")).select("seed", "view", R("weight"))


@query("E07_quality_drift_weights", f"WITH {LOGITS}{QUALITY} SELECT seed, view, round(exp(-loss - 0.5 * (view + 1) / 10) / sum(exp(-loss - 0.5 * (view + 1) / 10)) OVER (PARTITION BY seed), 6) AS weight FROM ql")
def e07(spark, d):
    return metrics.softmax_weights(_losses(spark, d), ["seed"], -F.col("loss") - 0.5 * (F.col("view") + 1) / 10).select("seed", "view", R("weight"))


@query("E08_forecast", f"WITH {LOGITS}, b AS (SELECT view, label, avg(nll) AS loss FROM p WHERE seed = 0 AND month < 3 GROUP BY 1, 2) SELECT view, label, beta::DOUBLE AS beta, round(loss + beta * (view + 1) / 10, 6) AS forecast FROM b, (SELECT unnest([0.0, 0.5, 1.0]) AS beta)")
def e08(spark, d):
    return _forecast(spark, d).select("view", "label", "beta", R("forecast"))


def _forecast(spark, d):
    p = predictions(spark, d).where("seed = 0 AND month < 3").groupBy("view", "label").agg(F.avg("nll").alias("loss"))
    signal = spark.range(3).select(F.col("id").cast("int").alias("view"), ((F.col("id") + 1) / 10).alias("drift"))
    return calibration.forecasts(p, signal, "view", "loss", "drift")


ERRORS = ", b AS (SELECT view, label, avg(nll) FILTER (month < 3) AS loss, avg(nll) FILTER (month >= 3) AS seen FROM p WHERE seed = 0 GROUP BY 1, 2), er AS (SELECT view, label, beta, loss + beta * (view + 1) / 10 - seen AS e FROM b, (SELECT unnest([0.0, 0.5, 1.0]) AS beta))"


@query("E09_beta_choice", f"WITH {LOGITS}{ERRORS}, a AS (SELECT beta, avg(x) AS mae FROM (SELECT beta, view, avg(abs(e)) AS x FROM er GROUP BY 1, 2) GROUP BY 1) SELECT beta::DOUBLE AS beta, round(mae, 6) AS mae, beta = (SELECT min(beta) FROM a WHERE mae - (SELECT min(mae) FROM a) <= 1e-12) AS chosen FROM a")
def e09(spark, d):
    return calibration.select_beta(_residuals(spark, d), "view", "residual").select("beta", R("mae"), "chosen")


def _residuals(spark, d):
    seen = predictions(spark, d).where("seed = 0 AND month >= 3").groupBy("view", "label").agg(F.avg("nll").alias("seen"))
    return _forecast(spark, d).join(seen, ["view", "label"]).withColumn("residual", F.col("forecast") - F.col("seen"))


@query("E10_residuals", f"WITH {LOGITS}{ERRORS} SELECT view, label, beta::DOUBLE AS beta, round(e, 6) AS residual FROM er")
def e10(spark, d):
    return _residuals(spark, d).select("view", "label", "beta", R("residual"))


@query("A22_fixed_support_f1", f"WITH {LOGITS}{FUSED}, sp AS (SELECT DISTINCT month, label FROM u), k AS (SELECT DISTINCT seed, month FROM u), j AS (SELECT k.seed, k.month, sp.label, (SELECT count(*) FROM u WHERE u.seed = k.seed AND u.month = k.month AND u.label = sp.label) AS s, (SELECT count(*) FROM u WHERE u.seed = k.seed AND u.month = k.month AND u.predicted = sp.label) AS p, (SELECT count(*) FROM u WHERE u.seed = k.seed AND u.month = k.month AND u.label = sp.label AND u.predicted = sp.label) AS tp FROM k JOIN sp ON k.month = sp.month) SELECT seed, month, round(avg(CASE WHEN s + p > 0 THEN 2 * tp / (s + p) ELSE 0 END), 6) AS f1 FROM j GROUP BY 1, 2")
def a22(spark, d):
    return _monthly(spark, d).select("seed", "month", R("f1"))


def _monthly(spark, d):
    u = fused(spark, d)
    return metrics.fixed_support_f1(u, ["seed", "month"], u.select("month", "label").distinct())


#: Accuracy per seed, method and month; methods are the three views and the uniform mixture.
METHODS = ", mm AS (SELECT seed, 'view' || view AS method, month, avg(CASE WHEN label = predicted THEN 1.0 ELSE 0 END) AS value FROM p GROUP BY 1, 2, 3 UNION ALL SELECT seed, 'uniform', month, avg(CASE WHEN label = predicted THEN 1.0 ELSE 0 END) FROM u GROUP BY 1, 2, 3), ps AS (SELECT seed, method, avg(value) AS mean_month, min(value) AS worst_month FROM mm GROUP BY 1, 2)"


def _by_method(spark, d):
    a = predictions(spark, d).groupBy("seed", F.concat(F.lit("view"), "view").alias("method"), "month").agg(F.avg("correct").alias("value"))
    return a.unionByName(fused(spark, d).groupBy("seed", F.lit("uniform").alias("method"), "month").agg(F.avg("correct").alias("value")))


@query("A23_mean_and_worst", f"WITH {LOGITS}{FUSED}{METHODS} SELECT seed, method, round(mean_month, 6) AS mean_month, round(worst_month, 6) AS worst_month FROM ps")
def a23(spark, d):
    return metrics.mean_and_worst(_by_method(spark, d), ["seed", "method"], "value").select("seed", "method", R("mean_month"), R("worst_month"))


@query("A24_seed_spread", f"WITH {LOGITS}{FUSED}{METHODS} SELECT method, round(avg(mean_month), 6) AS mean, round(stddev_samp(mean_month), 6) AS sample_sd, round(min(mean_month), 6) AS least, round(max(mean_month), 6) AS most FROM ps GROUP BY method")
def a24(spark, d):
    x = metrics.mean_and_worst(_by_method(spark, d), ["seed", "method"], "value")
    return metrics.spread(x, ["method"], "mean_month").select("method", *(R(c) for c in ("mean", "sample_sd", "least", "most")))


@query("A25_contrasts", f"WITH {LOGITS}{FUSED}{METHODS}, ln AS (SELECT seed, method, 'mean_month' AS outcome, mean_month AS v FROM ps UNION ALL SELECT seed, method, 'worst_month', worst_month FROM ps) SELECT a.method AS left_method, b.method AS right_method, a.outcome, round(avg(a.v - b.v), 6) AS mean, round(stddev_samp(a.v - b.v), 6) AS sample_sd, round(min(a.v - b.v), 6) AS least, round(max(a.v - b.v), 6) AS most FROM ln a JOIN ln b ON a.seed = b.seed AND a.outcome = b.outcome AND a.method = 'uniform' AND b.method <> 'uniform' GROUP BY 1, 2, 3")
def a25(spark, d):
    x = metrics.mean_and_worst(_by_method(spark, d), ["seed", "method"], "value")
    c = metrics.contrasts(x, [("uniform", f"view{v}") for v in range(3)], "method", "seed", ["mean_month", "worst_month"])
    return c.select("left_method", "right_method", "outcome", *(R(c) for c in ("mean", "sample_sd", "least", "most")))


@query("W08_worst_months", f"WITH {LOGITS}{FUSED}{METHODS}, r AS (SELECT *, rank() OVER (PARTITION BY seed, method ORDER BY value) AS k FROM mm) SELECT seed, method, month, round(value, 6) AS value FROM r WHERE k = 1")
def w08(spark, d):
    r = F.rank().over(W.partitionBy("seed", "method").orderBy("value"))
    return _by_method(spark, d).withColumn("k", r).where("k = 1").select("seed", "method", "month", R("value"))


@query("V01_strata", f"WITH {LOGITS}{FUSED} SELECT seed, (CASE WHEN size > 250 THEN 1 ELSE 0 END) + (CASE WHEN size > 500 THEN 1 ELSE 0 END) + (CASE WHEN size > 750 THEN 1 ELSE 0 END) AS bucket, h AS horizon, count(*) AS samples, round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(nll), 6) AS nll FROM u, (SELECT unnest([1, 3, 6]) AS h) WHERE month < h GROUP BY 1, 2, 3")
def v01(spark, d):
    h = F.explode(F.array(F.lit(1), F.lit(3), F.lit(6))).alias("horizon")
    u = fused(spark, d).select("seed", "size", "month", "correct", "nll", h).where("month < horizon")
    return u.groupBy("seed", cohort.size_bucket(F.col("size"), [250, 500, 750]).alias("bucket"), "horizon").agg(F.count("*").alias("samples"), F.round(F.avg("correct"), 6).alias("accuracy"), F.round(F.avg("nll"), 6).alias("nll"))


@query("V02_retained_status", f"WITH {LOGITS}{FUSED} SELECT seed, t AS threshold, CASE WHEN count(DISTINCT month) = 6 THEN 'ESTIMATED' ELSE 'NOT_ESTIMABLE' END AS status, count(*) AS samples, count(DISTINCT month) AS months FROM u, (SELECT unnest([0, 10, 20]) AS t) WHERE size > t * 49 GROUP BY 1, 2")
def v02(spark, d):
    t = F.explode(F.array(F.lit(0), F.lit(10), F.lit(20))).alias("threshold")
    u = fused(spark, d).select("seed", "size", "month", t).where("size > threshold * 49")
    return u.groupBy("seed", "threshold").agg(F.when(F.count_distinct("month") == 6, "ESTIMATED").otherwise("NOT_ESTIMABLE").alias("status"), F.count("*").alias("samples"), F.count_distinct("month").alias("months"))


@query("V04_methods", f"WITH {LOGITS}{FUSED} SELECT 'view' || view AS method, count(*) AS samples, round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(nll), 6) AS nll FROM p GROUP BY 1 UNION ALL SELECT 'uniform', count(*), round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0 END), 6), round(avg(nll), 6) FROM u")
def v04(spark, d):
    cols = lambda df, m: df.select(m.alias("method"), "correct", "nll")
    u = cols(predictions(spark, d), F.concat(F.lit("view"), "view")).unionByName(cols(fused(spark, d), F.lit("uniform")))
    return u.groupBy("method").agg(F.count("*").alias("samples"), F.round(F.avg("correct"), 6).alias("accuracy"), F.round(F.avg("nll"), 6).alias("nll"))


@query("J16_complete_cells", f"WITH {LOGITS} SELECT seed, view, count(*) AS n FROM g GROUP BY 1, 2")
def j16(spark, d):
    return logits(spark, d).groupBy("seed", "view").agg(F.count("*").alias("n"))


@query("J04_aligned_views", f"WITH {LOGITS} SELECT a.vec_id, a.seed, a.label = b.label AND b.label = c.label AS aligned FROM g a JOIN g b ON a.vec_id = b.vec_id AND a.seed = b.seed AND b.view = 1 JOIN g c ON a.vec_id = c.vec_id AND a.seed = c.seed AND c.view = 2 WHERE a.view = 0")
def j04(spark, d):
    g = logits(spark, d).groupBy("vec_id", "seed").agg(F.count_distinct("view").alias("v"), F.count_distinct("label").alias("l"))
    return g.where("v = 3").select("vec_id", "seed", (F.col("l") == 1).alias("aligned"))


SUMS = ", gs AS (SELECT group_id, count(*) AS n, sum(CASE WHEN label = predicted THEN 1 ELSE 0 END)::DOUBLE AS correct, sum(nll) AS nll, sum(brier) AS brier FROM u WHERE seed = 0 GROUP BY 1)"
VALUES = ["correct", "nll", "brier"]


def _sums(spark, d):
    u = fused(spark, d).where("seed = 0").withColumn("correct", F.col("correct").cast("double"))
    return resample.group_sums(u, "group_id", VALUES)


@query("A30_A31_group_sums", f"WITH {LOGITS}{FUSED}{SUMS} SELECT group_id, n, correct, round(nll, 6) AS nll, round(brier, 6) AS brier FROM gs")
def a30(spark, d):
    return _sums(spark, d).select("group_id", "n", "correct", R("nll"), R("brier"))


DRAWS = ", dr AS (SELECT r AS replicate, group_id, (group_id * 7919 + r * 104729 + group_id * r * 31) % 4 AS weight FROM gs, range(200) t(r))"
RES = ", rs AS (SELECT replicate, sum(weight * correct) / sum(weight * n) AS correct, sum(weight * nll) / sum(weight * n) AS nll, sum(weight * brier) / sum(weight * n) AS brier FROM dr JOIN gs ON dr.group_id = gs.group_id GROUP BY replicate)"


def _resampled(spark, d):
    s = _sums(spark, d)
    w = (F.col("group_id") * 7919 + F.col("replicate") * 104729 + F.col("group_id") * F.col("replicate") * 31) % 4
    return resample.resampled(resample.hash_draws(spark, s.select("group_id"), 200, w), s, VALUES)


@query("E25_group_bootstrap", f"WITH {LOGITS}{FUSED}{SUMS}{DRAWS}{RES} SELECT replicate, round(correct, 6) AS correct, round(nll, 6) AS nll, round(brier, 6) AS brier FROM rs")
def e25(spark, d):
    return _resampled(spark, d).select("replicate", *(R(v) for v in VALUES))


@query("E26_intervals", f"WITH {LOGITS}{FUSED}{SUMS}{DRAWS}{RES} SELECT l::DOUBLE AS level, round(quantile_cont(nll, 0.025) FILTER (l = 0.025), 6) AS q_low, round(quantile_cont(nll, 0.975) FILTER (l = 0.975), 6) AS q_high FROM rs, (SELECT unnest([0.025, 0.975]) AS l) GROUP BY l")
def e26(spark, d):
    i = resample.intervals(_resampled(spark, d), [], "nll", [0.025, 0.975])
    return i.select("level", F.round(F.when(F.col("level") < 0.5, F.col("quantile")), 6).alias("q_low"), F.round(F.when(F.col("level") > 0.5, F.col("quantile")), 6).alias("q_high"))


@query("E27_leave_one_out", f"WITH {LOGITS}{FUSED}{SUMS}, t AS (SELECT sum(n) AS tn, sum(nll) AS tl FROM gs) SELECT group_id, n, round((tl - nll) / (tn - n), 6) AS loo_nll, round((tl - nll) / (tn - n) - tl / tn, 6) AS shift_nll FROM gs, t")
def e27(spark, d):
    return resample.leave_one_out(_sums(spark, d), ["nll"]).select("group_id", "n", R("loo_nll"), R("shift_nll"))


@query("E24_A33_uncertainty", f"WITH {LOGITS}, b AS (SELECT view, label, group_id, count(*) AS n, sum(nll) AS nll FROM p WHERE seed = 0 GROUP BY 1, 2, 3), r AS (SELECT k AS replicate, view, label, sum((1 + (group_id * 13 + k * 7) % 5) * nll) / sum((1 + (group_id * 13 + k * 7) % 5) * n) AS x FROM b, range(100) t(k) GROUP BY 1, 2, 3), q AS (SELECT replicate, view, avg(x) AS loss FROM r GROUP BY 1, 2) SELECT view, round(avg(loss), 6) AS mean, round(stddev_samp(loss), 6) AS uncertainty FROM q GROUP BY view")
def e24(spark, d):
    s = resample.group_sums(predictions(spark, d).where("seed = 0"), "group_id", ["nll"], ["view", "label"])
    w = 1 + (F.col("group_id") * 13 + F.col("replicate") * 7) % 5
    draws = resample.hash_draws(spark, s.select("group_id").distinct(), 100, w)
    q = resample.resampled(draws, s, ["nll"], by=["view", "label"]).groupBy("replicate", "view").agg(F.avg("nll").alias("loss"))
    return q.groupBy("view").agg(F.round(F.avg("loss"), 6).alias("mean"), F.round(F.stddev_samp("loss"), 6).alias("uncertainty"))


@query("E30_support_pilot", "WITH m AS (SELECT vec_id // 3 AS group_id, label AS class, count(*) AS n FROM embeddings GROUP BY 1, 2), g AS (SELECT count(DISTINCT group_id) AS g FROM m), d AS (SELECT r AS replicate, group_id, (group_id * 17 + r * 5) % 3 AS w FROM (SELECT DISTINCT group_id FROM m), range(50) t(r)), h AS (SELECT class, count(DISTINCT replicate) AS hits FROM d JOIN m ON d.group_id = m.group_id WHERE w > 0 GROUP BY class) SELECT m.class, sum(n)::BIGINT AS samples, count(*) AS groups, round(sum(n) * sum(n) / sum(n * n), 6)::DOUBLE AS effective_groups, max(n) AS largest, round(pow(1 - count(*) / min(g)::DOUBLE, min(g)), 6) AS absence, round(1 - coalesce(min(hits), 0) / 50, 6) AS missed_share FROM m CROSS JOIN g LEFT JOIN h ON m.class = h.class GROUP BY m.class")
def e30(spark, d):
    m = table(spark, d, "embeddings").groupBy(F.expr("vec_id div 3").alias("group_id"), F.col("label").alias("class")).agg(F.count("*").alias("n"))
    draws = resample.hash_draws(spark, m.select("group_id").distinct(), 50, (F.col("group_id") * 17 + F.col("replicate") * 5) % 3).withColumnRenamed("weight", "multiplicity")
    x = resample.support_pilot(m, draws, m.select("group_id").distinct().count())
    return x.select("class", "samples", "groups", R("effective_groups"), "largest", R("absence"), R("missed_share"))


def _groups(sums):
    """The groups in the order of the draws; as many as the draws have columns."""
    return [r[0] for r in sums.select("group_id").distinct().orderBy("group_id").collect()]


def _bootstrap(spark, d):
    s = _sums(spark, d)
    draws = resample.multinomial_draws(spark, _groups(s)).withColumnRenamed("multiplicity", "weight")
    return resample.resampled(draws, s, VALUES)


@query("E24_A33_exponential_draws")
def e24_whole(spark, d):
    """2,000 exponential draws: mean, SD, quantiles of the equal-class loss of each view, and its covariance with every view."""
    s = resample.group_sums(predictions(spark, d).where("seed = 0"), "group_id", ["nll"], ["view", "label"])
    draws = resample.exponential_draws(spark, _groups(s))
    q = resample.resampled(draws, s, ["nll"], by=["view", "label"]).groupBy("replicate").agg(*(_class_mean(v).alias(f"v{v}") for v in range(3)))
    pick = lambda f: [f(v) for v in range(3)]
    each = pick(lambda v: F.struct(F.lit(v).alias("view"), F.avg(f"v{v}").alias("mean"), F.stddev_samp(f"v{v}").alias("uncertainty"), *(F.percentile(f"v{v}", F.lit(x)).alias(f"q_{str(x).replace('.', '_')}") for x in (0.025, 0.5, 0.975)), *(F.covar_samp(f"v{v}", f"v{u}").alias(f"covariance_{u}") for u in range(3))))
    return q.agg(F.array(*each).alias("views")).select(F.inline("views"))


def _class_mean(view):
    return F.avg(F.when(F.col("view") == view, F.col("nll")))


@query("E25_multinomial_draws")
def e25_whole(spark, d):
    """2,000 draws of whole groups, as in the reference."""
    return _bootstrap(spark, d)


@query("E26_multinomial_intervals")
def e26_whole(spark, d):
    return resample.intervals(_bootstrap(spark, d), [], "nll", [0.025, 0.975])


@query("E30_multinomial_pilot")
def e30_whole(spark, d):
    """500 draws, the most that the reference's pilot allows."""
    m = table(spark, d, "embeddings").groupBy(F.expr("vec_id div 3").alias("group_id"), F.col("label").alias("class")).agg(F.count("*").alias("n"))
    groups = _groups(m)
    return resample.support_pilot(m, resample.multinomial_draws(spark, groups, 500), len(groups))


@query("A34_summaries", f"WITH {LOGITS}{QUALITY} SELECT view, round(avg(loss), 6) AS mean, round(stddev_samp(loss), 6) AS sample_sd, round(min(loss), 6) AS least, round(max(loss), 6) AS most FROM ql GROUP BY view")
def a34(spark, d):
    return metrics.spread(_losses(spark, d), ["view"], "loss").select("view", *(R(c) for c in ("mean", "sample_sd", "least", "most")))


STAGED = "st AS (SELECT vec_id, label, vec_id // 3 AS group_id, CASE vec_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'A' ELSE 'B' END AS stage, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
MOMENTS = ", xs AS (SELECT label, i - 1 AS dim, e[i] AS x FROM st, range(1, 65) t(i) WHERE stage = 'train'), cm AS (SELECT label, dim, avg(x) AS m FROM xs GROUP BY 1, 2), mu AS (SELECT dim, avg(m) AS mean FROM cm GROUP BY dim), mo AS (SELECT dim, min(mean) AS mean, sqrt(avg(v)) AS std FROM (SELECT label, xs.dim, min(mean) AS mean, avg((x - mean) * (x - mean)) AS v FROM xs JOIN mu ON xs.dim = mu.dim GROUP BY 1, 2) GROUP BY dim)"


def _staged(spark, d):
    s = F.expr("CASE vec_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'A' ELSE 'B' END").alias("stage")
    return table(spark, d, "embeddings").select("vec_id", "label", F.expr("vec_id div 3").alias("group_id"), s, F.transform("embedding", lambda x: x.cast("double")).alias("e"))


def _moments(spark, d):
    return drift.equal_class_moments(_staged(spark, d).where("stage = 'train'"), "label", "e")


@query("A28_equal_class_moments", f"WITH {STAGED}{MOMENTS} SELECT dim, round(mean, 6) AS mean, round(std, 6) AS std FROM mo")
def a28(spark, d):
    return _moments(spark, d).select("dim", R("mean"), R("std"))


@query("B15_z_scores", f"WITH {STAGED}{MOMENTS} SELECT vec_id, dim, round((e[dim + 1] - mean) / std, 5) AS z FROM st, mo WHERE stage = 'A'")
def b15(spark, d):
    z = drift.z_scores(_staged(spark, d).where("stage = 'A'"), "e", _moments(spark, d))
    return z.select("vec_id", F.posexplode("e").alias("dim", "z")).withColumn("z", F.round("z", 5))


def _z(spark, d):
    return drift.z_scores(_staged(spark, d), "e", _moments(spark, d))


@query("E16_E17_class_mmd2", f"""WITH {STAGED}, pr AS (SELECT a.label, a.stage AS sa, b.stage AS sb, exp(-list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i]))) / 64 / 0.04) AS k FROM st a JOIN st b ON a.label = b.label WHERE a.stage <> 'train' AND b.stage <> 'train')
SELECT label, round(avg(k) FILTER (sa = 'A' AND sb = 'A') + avg(k) FILTER (sa = 'B' AND sb = 'B') - 2 * avg(k) FILTER (sa = 'A' AND sb = 'B'), 6) AS mmd2 FROM pr GROUP BY label""")
def e16(spark, d):
    s = _staged(spark, d)
    return drift.class_mmd2(s.where("stage = 'A'"), s.where("stage = 'B'"), "label", "e", 0.02).select("label", R("mmd2"))


@query("E18_group_mass_mmd2", f"""WITH {STAGED}, ng AS (SELECT stage, label, group_id, count(*) AS n FROM st GROUP BY 1, 2, 3), gg AS (SELECT stage, label, count(*) AS g FROM ng GROUP BY 1, 2),
wt AS (SELECT st.*, 1.0::DOUBLE / (g * n) AS w FROM st JOIN ng ON st.stage = ng.stage AND st.label = ng.label AND st.group_id = ng.group_id JOIN gg ON st.stage = gg.stage AND st.label = gg.label),
pr AS (SELECT a.label, a.stage AS sa, b.stage AS sb, a.w * b.w * exp(-list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i]))) / 64 / 0.04) AS k FROM wt a JOIN wt b ON a.label = b.label WHERE a.stage <> 'train' AND b.stage <> 'train')
SELECT label, round(sum(k) FILTER (sa = 'A' AND sb = 'A') + sum(k) FILTER (sa = 'B' AND sb = 'B') - 2 * sum(k) FILTER (sa = 'A' AND sb = 'B'), 6) AS mmd2 FROM pr GROUP BY label""")
def e18(spark, d):
    s = drift.group_mass(_staged(spark, d), ["stage", "label"], "group_id")
    return drift.class_mmd2(s.where("stage = 'A'"), s.where("stage = 'B'"), "label", "e", 0.02, "weight").select("label", R("mmd2"))


PAIRS = f"{STAGED}, rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256(vec_id::VARCHAR), vec_id) AS r FROM st WHERE stage = 'train'), pp AS (SELECT a.label, round(list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i]))) / 64, 9) AS distance FROM rk a JOIN rk b ON a.label = b.label AND a.vec_id < b.vec_id WHERE a.r <= 20 AND b.r <= 20)"


@query("A27_E19_bandwidth", f"WITH {PAIRS}, v AS (SELECT distance, count(*) AS w FROM pp GROUP BY distance), c AS (SELECT distance, sum(w) OVER (ORDER BY distance) AS cum, sum(w) OVER () AS tot FROM v) SELECT round(min(distance), 6) AS median FROM c WHERE cum * 2 >= tot")
def a27(spark, d):
    r = F.row_number().over(W.partitionBy("label").orderBy(F.sha2(F.col("vec_id").cast("string"), 256), "vec_id"))
    ref = _staged(spark, d).where("stage = 'train'").withColumn("r", r).where("r <= 20")
    p = drift.class_pairs(ref, "label", "vec_id", "e").withColumn("distance", F.round("distance", 9)).withColumn("mass", F.lit(1))
    return drift.weighted_median(p, "distance", "mass").select(R("median"))


@query("W02_capped_reference", f"WITH {STAGED}, rk AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY sha256('[\"ref\",\"' || vec_id || '\"]'), vec_id::VARCHAR) AS rank FROM st WHERE stage = 'train') SELECT label, vec_id, rank FROM rk WHERE rank <= 8")
def w02(spark, d):
    s = _staged(spark, d).where("stage = 'train'").withColumn("id", F.col("vec_id").cast("string"))
    return cohort.ranked_by_hash(s, ["label"], ["id"], F.lit('"ref"'), 8).select("label", "vec_id", "rank")


#: The whole reference of W02; W02_capped_reference above keeps 8 rows a class of it.
@query("W02_reference_128", f"WITH {STAGED}, rk AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY sha256('[\"ref\",\"' || vec_id || '\"]'), vec_id::VARCHAR) AS rank FROM st WHERE stage = 'train') SELECT label, vec_id, rank FROM rk WHERE rank <= 128")
def w02_128(spark, d):
    return _reference(spark, d).select("label", "vec_id", "rank")


def _reference(spark, d):
    s = _staged(spark, d).where("stage = 'train'").withColumn("id", F.col("vec_id").cast("string"))
    return cohort.ranked_by_hash(s, ["label"], ["id"], F.lit('"ref"'), 128)


def _reference_z(spark, d, df):
    """z-scores of rows by the equal-class moments of the reference."""
    return drift.z_scores(df, "e", drift.equal_class_moments(_reference(spark, d), "label", "e"))


def _bandwidth(spark, d):
    return drift.train_bandwidth(_reference_z(spark, d, _reference(spark, d)), "label", "vec_id", "e", F.lit('"pair"'))


@query("E19_train_bandwidth")
def e19(spark, d):
    """W02's 128 rows and W03's 128 pairs a class, z-scores of the reference, equal mass a class."""
    return _bandwidth(spark, d)


@query("W03_pair_rank", f"WITH {STAGED}, q AS (SELECT a.label, a.vec_id AS l, b.vec_id AS r, sha256('[\"pair\",\"' || a.vec_id || '\",\"' || b.vec_id || '\"]') AS h FROM st a JOIN st b ON a.label = b.label AND a.vec_id < b.vec_id WHERE a.stage = 'train' AND b.stage = 'train'), z AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, l::VARCHAR, r::VARCHAR) AS k FROM q) SELECT label, l, r FROM z WHERE k <= 128")
def w03(spark, d):
    s = _staged(spark, d).where("stage = 'train'").select("label", "vec_id")
    p = s.withColumnRenamed("vec_id", "l").join(s.withColumnRenamed("vec_id", "r"), "label").where("l < r").select("label", F.col("l").cast("string").alias("ls"), F.col("r").cast("string").alias("rs"), "l", "r")
    return cohort.ranked_by_hash(p, ["label"], ["ls", "rs"], F.lit('"pair"'), 128).select("label", "l", "r")


@query("W04_A29_balanced_cap", f"WITH {STAGED}, x AS (SELECT * FROM st WHERE stage <> 'train'), c AS (SELECT label, stage, count(*) AS n, count(DISTINCT group_id) AS g FROM x GROUP BY 1, 2), k AS (SELECT label, least(min(n), 128) AS cap FROM c GROUP BY label HAVING count(*) = 2), r AS (SELECT x.*, row_number() OVER (PARTITION BY label, stage ORDER BY sha256(vec_id::VARCHAR), vec_id) AS rk FROM x), a AS (SELECT r.label, r.stage, group_id, count(*) AS n FROM r JOIN k ON r.label = k.label WHERE rk <= cap GROUP BY 1, 2, 3) SELECT c.label, c.stage, c.n AS samples_before, sum(a.n)::BIGINT AS samples_after, c.g AS groups_before, count(*) AS groups_after, c.g - count(*) AS groups_lost, max(a.n) AS largest_after FROM c JOIN a ON c.label = a.label AND c.stage = a.stage GROUP BY c.label, c.stage, c.n, c.g")
def w04(spark, d):
    r = F.row_number().over(W.partitionBy("label", "stage").orderBy(F.sha2(F.col("vec_id").cast("string"), 256), "vec_id"))
    s = _staged(spark, d).where("stage <> 'train'").withColumn("r", r)
    return drift.capped_groups(s, ["label"], "stage", "group_id", "r").select("label", "stage", "samples_before", "samples_after", "groups_before", "groups_after", "groups_lost", "largest_after")


@query("E22_bandwidth_factors", f"""WITH {STAGED}, pr AS (SELECT a.label, h, a.stage AS sa, b.stage AS sb, exp(-list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i]))) / 64 / (2 * h)) AS k FROM st a JOIN st b ON a.label = b.label, (SELECT unnest([0.01, 0.02, 0.04]) AS h) WHERE a.stage <> 'train' AND b.stage <> 'train'),
q AS (SELECT label, h, avg(k) FILTER (sa = 'A' AND sb = 'A') + avg(k) FILTER (sa = 'B' AND sb = 'B') - 2 * avg(k) FILTER (sa = 'A' AND sb = 'B') AS m FROM pr GROUP BY 1, 2) SELECT h::DOUBLE AS bandwidth, round(avg(m), 6) AS mmd2 FROM q GROUP BY h""")
def e22(spark, d):
    s = _staged(spark, d)
    out = None
    for h in (0.01, 0.02, 0.04):
        m = drift.class_mmd2(s.where("stage = 'A'"), s.where("stage = 'B'"), "label", "e", h).agg(F.round(F.avg("mmd2"), 6).alias("mmd2")).select(F.lit(h).alias("bandwidth"), "mmd2")
        out = m if out is None else out.unionByName(m)
    return out


@query("A32_distribution")
def a32(spark, d):
    return resample.distribution(_bootstrap(spark, d), "nll", [0.0, 0.001, 0.01, 0.025, 0.25, 0.5, 0.75, 0.975, 0.99, 0.999, 1.0])


@query("A32_histogram", f"WITH {LOGITS}{FUSED}, r AS (SELECT min(nll) AS lo, max(nll) AS hi FROM u), b AS (SELECT least(floor((nll - lo) / (hi - lo) * 40), 39)::INT AS bin, count(*) AS n FROM u, r GROUP BY 1) SELECT i::INT AS bin, coalesce(n, 0) AS n FROM range(40) t(i) LEFT JOIN b ON b.bin = i")
def a32h(spark, d):
    return resample.histogram(fused(spark, d), "nll")


@query("E01_temperatures")
def e01(spark, d):
    return calibration.fit_temperatures(logits(spark, d), ["seed", "view"], "z")


@query("E05_cross_fit")
def e05(spark, d):
    g = logits(spark, d).withColumn("fold", (F.col("group_id") % 5).cast("int"))
    return calibration.cross_fit(g, ["seed", "view"], "fold", logits="z").select("vec_id", "seed", "view", "fold", "temperature")


@query("E11_E12_E14_learned_weights")
def e11(spark, d):
    p = predictions(spark, d).groupBy("seed", "vec_id", "label").agg(F.array(*(F.max(F.when(F.col("view") == v, -F.col("nll"))) for v in range(3))).alias("logs"))
    return calibration.learned_weights(p, ["seed"], "label", "logs")


@query("E29_seed_group_draws")
def e29(spark, d):
    """20,000 replicates draw seeds and groups; the mean over the drawn seeds of the accuracy on the drawn groups."""
    s = resample.group_sums(fused(spark, d).withColumn("correct", F.col("correct").cast("double")), "group_id", ["correct"], ["seed"])
    seeds = [r[0] for r in s.select("seed").distinct().orderBy("seed").collect()]
    draws, drawn = resample.seed_group_draws(spark, _groups(s), seeds)
    x = resample.resampled(draws, s, ["correct"], by=["seed"]).join(drawn, ["replicate", "seed"])
    x = x.groupBy("replicate").agg((F.sum(F.col("multiplicity") * F.col("correct")) / F.sum("multiplicity")).alias("correct"))
    return resample.intervals(x, [], "correct", [0.0025, 0.025, 0.975, 0.9975])
