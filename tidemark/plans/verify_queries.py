"""Evaluators by month and view, images of data sets, and second looks at what other queries give."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import byteviews, calibration, drift, metrics, resample, retention, verification
from tidemark.plans import content_queries as cq
from tidemark.plans import model_queries as mq
from tidemark.plans import study_queries as sq
from tidemark.plans.registry import SQL, query
from tidemark.plans.registry import clean as c
from tidemark.plans.select_queries import COHORT
from tidemark.plans.tables import CLASSES, FUSED, LOGITS, MANIFEST, fused, logits, predictions
from tidemark.functions.keys import clean
from tidemark.session import Scratch, table
from tidemark.sources import images

R = mq.R

#: The summary's SQL over the mixture by month instead of single views.
_POINT = SQL["A16_A17_A18_summary"].replace(f"WITH {LOGITS}", "").replace("FROM p ", "FROM u ").replace("FROM p)", "FROM u)").replace("view", "month")


@query("V06_point_evaluator", f"WITH {LOGITS}{FUSED}{_POINT}")
def v06(spark, d):
    """The mixture's scores of each seed and month."""
    x = metrics.summary(fused(spark, d), ["seed", "month"], CLASSES)
    return x.select("seed", "month", "samples", "supported_classes", *(R(k) for k in ("accuracy", "nll", "brier", "macro_f1_supported", "macro_f1_fixed", "balanced_accuracy", "ece_15")))


@query("V07_single_view_families", f"WITH {LOGITS} SELECT seed, view, CASE WHEN month < 3 THEN 'train' ELSE 'validation' END AS part, label, count(*) AS support, round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0 END), 6) AS recall, round(avg(nll), 6) AS nll, round(avg(brier), 6) AS brier FROM p GROUP BY 1, 2, 3, 4")
def v07(spark, d):
    """Each view by itself, per family, on the train and the validation months."""
    part = F.when(F.col("month") < 3, "train").otherwise("validation").alias("part")
    g = predictions(spark, d).groupBy("seed", "view", part, "label")
    return g.agg(F.count("*").alias("support"), F.round(F.avg("correct"), 6).alias("recall"), F.round(F.avg("nll"), 6).alias("nll"), F.round(F.avg("brier"), 6).alias("brier"))


@query("A19_A20_second_metrics", f"WITH {LOGITS}, b AS (SELECT seed, view, least(floor(confidence * 15), 14) AS bin, count(*) AS n, sum(CASE WHEN label = predicted THEN 1.0::DOUBLE ELSE 0 END) AS hits, sum(confidence) AS mass, sum(nll) AS nll, sum(brier) AS brier FROM p GROUP BY 1, 2, 3) SELECT seed, view, sum(n)::BIGINT AS samples, round(sum(hits) / sum(n), 6) AS accuracy, round(sum(nll) / sum(n), 6) AS nll, round(sum(brier) / sum(n), 6) AS brier, round(sum(abs(hits - mass)) / sum(n), 6) AS ece, (SELECT max(abs(list_sum(list_transform(range(1, 11), lambda i: (exp(logp[i]) - CASE WHEN i = label + 1 THEN 1 ELSE 0 END) * (exp(logp[i]) - CASE WHEN i = label + 1 THEN 1 ELSE 0 END))) - q.brier)) FROM p q WHERE q.seed = b.seed AND q.view = b.view) <= 1e-12 AS forms_agree FROM b GROUP BY seed, view")
def a19(spark, d):
    """The metrics again by other formulas: Brier by norms, bins by their edges."""
    x = verification.second_metrics(predictions(spark, d).select("seed", "view", "label", "logp"), ["seed", "view"], CLASSES)
    return x.select("seed", "view", "samples", *(R(k) for k in ("accuracy", "nll", "brier", "ece")), (F.col("brier_gap") <= 1e-12).alias("forms_agree"))


@query("W09_view_order", f"WITH {LOGITS} SELECT seed, vec_id, string_agg(view::VARCHAR, ',' ORDER BY round(nll, 9), view) AS view_order FROM p GROUP BY 1, 2")
def w09(spark, d):
    return verification.view_order(predictions(spark, d).withColumn("nll", F.round("nll", 9)), ["seed", "vec_id"], "view", "nll")


@query("B08_size_contract", "SELECT doc_id, CASE WHEN n_chars IS NULL THEN 'UNDECLARED' WHEN strlen(text) < n_chars THEN 'SHORT' WHEN strlen(text) > n_chars THEN 'TRAILING' ELSE 'EXACT' END AS status FROM documents WHERE text IS NOT NULL")
def b08_contract(spark, d):
    """Bytes held against a declared size, here the number of characters, which is less where a text is not plain ASCII."""
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", byteviews.size_status(F.encode("text", "UTF-8"), F.col("n_chars")).alias("status"))


def _pngs(spark, d):
    """doc_id, subject, png, sha256: transition images as PNG files."""
    t = table(spark, d, "documents").select("doc_id", clean("subject_sha").alias("subject"), F.encode("text", "UTF-8").alias("content")).where("length(content) > 0")
    p = t.select("doc_id", "subject", images.png_column(byteviews.transition_image(F.col("content"), 4), 16).alias("png"))
    return p.select("*", F.sha2("png", 256).alias("sha256"))


_TRANSITIONS = SQL["B02_transitions"]
#: Only the documents about the data set's records.
_OF_SET = _TRANSITIONS.replace("FROM documents WHERE", f"FROM documents WHERE {c('subject_sha')} IN (SELECT sha FROM m WHERE split = 'test' AND month = '2020-05') AND")
_SUM = "px AS (SELECT doc_id, sum(value)::BIGINT AS total, count(*) AS lit FROM (" + _TRANSITIONS + ") GROUP BY doc_id), dx AS (SELECT doc_id, " + c("subject_sha") + " AS subject FROM documents WHERE strlen(text) > 0)"


def _summed(df, *keep):
    # Whole levels of 255, so the sums are exact.
    levels = F.transform("image", lambda x: F.round(x.cast("double") * 255).cast("long"))
    return df.withColumn("_l", levels).select(*keep, F.aggregate("_l", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.size(F.filter("_l", lambda x: x > 0)).cast("long").alias("lit"))


@query("S10_decoded_images", f"WITH {_SUM} SELECT dx.doc_id, coalesce(total, 0) AS total, coalesce(lit, 0) AS lit FROM dx LEFT JOIN px ON dx.doc_id = px.doc_id")
def s10(spark, d):
    """Images written as PNG and read back with checksum, side and range checks: sum and number of lit pixels."""
    p = _pngs(spark, d)
    return _summed(p.select("doc_id", images.image_column(F.col("png"), F.col("sha256"), 16).alias("image")), "doc_id")


@query("S11_S12_S13_image_dataset", f"WITH {MANIFEST}, {COHORT}, i AS (SELECT family, row_number() OVER (ORDER BY family) - 1 AS class_index FROM k), {_SUM.replace(_TRANSITIONS, _OF_SET)} SELECT DISTINCT dx.doc_id, m.sha, i.class_index, coalesce(total, 0) AS total, coalesce(lit, 0) AS lit FROM m JOIN i ON m.family = i.family JOIN dx ON dx.subject = m.sha LEFT JOIN px ON dx.doc_id = px.doc_id WHERE m.split = 'test' AND m.month = '2020-05'")
def s11_images(spark, d):
    """The records of a month's data set with their decoded images: only images of these records are decoded."""
    records = sq.s11(spark, d).distinct()
    p = _pngs(spark, d).join(records.hint("merge"), F.col("subject") == F.col("sha"))
    return _summed(p.select("doc_id", "sha", "class_index", images.image_column(F.col("png"), F.col("sha256"), 16).alias("image")), "doc_id", "sha", "class_index")


@query("E02_calibrate_seeds")
def e02_seeds(spark, d):
    """Every seed and view: temperature fitted on months 0-2, scores of months 3-5 at it."""
    g = logits(spark, d)
    t = calibration.fit_temperatures(g.where("month < 3"), ["seed", "view"], "z")
    b = g.where("month >= 3").join(F.broadcast(t), ["seed", "view"])  # one row a seed and view
    return metrics.summary(metrics.sample_metrics(b.withColumn("logp", metrics.log_softmax(F.col("z"), F.col("temperature")))), ["seed", "view"], CLASSES)


@query("E08_E10_forecast_seeds", f"WITH {LOGITS}, b AS (SELECT seed, view, label, avg(nll) FILTER (month < 3) AS loss, avg(nll) FILTER (month >= 3) AS seen FROM p GROUP BY 1, 2, 3) SELECT seed, view, label, beta::DOUBLE AS beta, round(loss + beta * (view + 1) / 10, 6) AS forecast, round(loss + beta * (view + 1) / 10 - seen, 6) AS residual FROM b, (SELECT unnest([0.0, 0.5, 1.0]) AS beta) WHERE loss IS NOT NULL AND seen IS NOT NULL")
def e10_seeds(spark, d):
    """Forecasts and residuals of every seed; E08_forecast and E10_residuals keep seed 0."""
    p = predictions(spark, d)
    mean = lambda c, name: p.where(c).groupBy("seed", "view", "label").agg(F.avg("nll").alias(name))
    signal = spark.range(3).select(F.col("id").cast("int").alias("view"), ((F.col("id") + 1) / 10).alias("drift"))
    f = calibration.forecasts(mean("month < 3", "loss"), signal, "view", "loss", "drift").join(mean("month >= 3", "seen"), ["seed", "view", "label"])
    return f.select("seed", "view", "label", "beta", R("forecast"), F.round(F.col("forecast") - F.col("seen"), 6).alias("residual"))


_LOO = ", tt AS (SELECT sum(n) AS n, sum(nll) AS nll, sum(brier) AS brier FROM gs), lo AS (SELECT gs.group_id, gs.n, (tt.nll - gs.nll) / (tt.n - gs.n) - tt.nll / tt.n AS shift_nll, (tt.brier - gs.brier) / (tt.n - gs.n) - tt.brier / tt.n AS shift_brier FROM gs, tt), wy AS (SELECT group_id, 'size' AS why FROM (SELECT group_id FROM lo ORDER BY n DESC, group_id LIMIT 10) UNION ALL SELECT group_id, 'nll' FROM (SELECT group_id FROM lo ORDER BY abs(shift_nll) DESC, group_id LIMIT 1) UNION ALL SELECT group_id, 'brier' FROM (SELECT group_id FROM lo ORDER BY abs(shift_brier) DESC, group_id LIMIT 1))"


@query("E27_T03_influence", f"WITH {LOGITS}{FUSED}{mq.SUMS}{mq.DRAWS}{mq.RES}{_LOO}, co AS (SELECT dr.group_id, CASE WHEN min(weight) < max(weight) THEN corr(weight, rs.nll) END AS c FROM dr JOIN rs ON dr.replicate = rs.replicate GROUP BY 1) SELECT lo.group_id, lo.n, string_agg(why, ',' ORDER BY why) AS why, round(min(shift_nll), 6) AS shift_nll, round(min(shift_brier), 6) AS shift_brier, round(min(co.c), 6) AS corr_nll FROM lo JOIN wy ON lo.group_id = wy.group_id JOIN co ON co.group_id = lo.group_id GROUP BY 1, 2")
def e27_t03(spark, d):
    """The ten largest groups and those of the largest shifts, with the correlation of their multiplicity with the mixture's loss."""
    sums = mq._sums(spark, d)
    w = (F.col("group_id") * 7919 + F.col("replicate") * 104729 + F.col("group_id") * F.col("replicate") * 31) % 4
    draws = resample.hash_draws(spark, sums.select("group_id"), 200, w)
    corr = resample.multiplicity_correlation(draws, resample.resampled(draws, sums, ["nll"]), ["nll"])
    top = resample.influential(resample.leave_one_out(sums, ["nll", "brier"]), ["nll", "brier"])
    return top.join(corr, "group_id").select("group_id", "n", F.array_join("why", ",").alias("why"), R("shift_nll"), R("shift_brier"), R("corr_nll"))


def _fit_rows(spark, d):
    p = predictions(spark, d).groupBy("seed", "vec_id", "label").agg(F.array(*(F.max(F.when(F.col("view") == v, -F.col("nll"))) for v in range(3))).alias("logs"))
    w = calibration.learned_weights(p, ["seed"], "label", "logs").select("seed", "weights")
    return p.join(F.broadcast(w), "seed")  # one row a seed


@query("E13_optimality_60_digits")
def e13(spark, d):
    """The learned weights of each seed meet the conditions of a minimum, computed with 60 digits."""
    return verification.optimality(_fit_rows(spark, d), ["seed"], "label", "logs", "weights")


@query("E15_replay_70_digits")
def e15(spark, d):
    """No small move lowers the objective at the learned weights, judged with 70 digits."""
    return verification.replay(_fit_rows(spark, d), ["seed"], "label", "logs", "weights")


@query("V05_held_forward", f"WITH {LOGITS}, f AS (SELECT view, label, avg(nll) FILTER (month < 2) AS a, avg(nll) FILTER (month IN (2, 3)) AS b, avg(nll) FILTER (month >= 4) AS c FROM p WHERE seed = 0 GROUP BY 1, 2), e AS (SELECT view, label, beta, a + beta * (view + 1) / 10 - b AS e1, b + beta * (view + 1) / 10 - c AS e2 FROM f, (SELECT unnest([0.0, 0.5, 1.0]) AS beta)), m AS (SELECT beta, avg(x) AS mae1, avg(y) AS mae2 FROM (SELECT beta, view, avg(abs(e1)) AS x, avg(abs(e2)) AS y FROM e GROUP BY 1, 2) GROUP BY 1) SELECT beta::DOUBLE AS beta, round(mae1, 6) AS e1_mae, beta = (SELECT min(beta) FROM m WHERE mae1 - (SELECT min(mae1) FROM m) <= 1e-12) AS chosen, CASE WHEN beta = (SELECT min(beta) FROM m WHERE mae1 - (SELECT min(mae1) FROM m) <= 1e-12) THEN round(mae2, 6) END AS e2_mae FROM m")
def v05(spark, d):
    """Episode E1 chooses beta (months 0-1 forecast 2-3); only that beta is scored on E2 (months 2-3 forecast 4-5)."""
    when = F.when(F.col("month") < 2, "a").when(F.col("month") < 4, "b").otherwise("c").alias("stage")
    loss = predictions(spark, d).where("seed = 0").groupBy("view", "label", when).agg(F.avg("nll").alias("loss"))
    at = lambda s, name: loss.where(F.col("stage") == s).select("view", "label", F.col("loss").alias(name))
    signal = spark.range(3).select(F.col("id").cast("int").alias("view"), ((F.col("id") + 1) / 10).alias("drift"))

    def errors(now: str, then: str):
        f = calibration.forecasts(at(now, "loss"), signal, "view", "loss", "drift")
        return f.join(at(then, "seen"), ["view", "label"]).withColumn("residual", F.col("forecast") - F.col("seen"))

    chosen = calibration.select_beta(errors("a", "b"), "view", "residual").select("beta", F.round("mae", 6).alias("e1_mae"), "chosen")
    forward = calibration.select_beta(errors("b", "c").join(F.broadcast(chosen.where("chosen").select("beta")), "beta", "left_semi"), "view", "residual").select("beta", F.round("mae", 6).alias("e2_mae"))
    return chosen.join(F.broadcast(forward), "beta", "left")


#: Cases of month ranges that are compared, as (case, months of A, months of B).
CASES = ((0, (0, 1), (2, 3)), (1, (2, 3), (4, 5)), (2, (0, 1, 2), (3, 4, 5)))
_CASES = " UNION ALL ".join(f"SELECT {k} AS cs, '{side}' AS side, unnest([{', '.join(map(str, m))}]) AS month" for k, a, b in CASES for side, m in (("A", a), ("B", b)))


@query("E21_cases_and_views", f"""WITH cs AS ({_CASES}), st AS (SELECT cs, side, view, label, list_transform(embedding[(20 * view + 1):(20 * view + 20)], lambda x: x::DOUBLE) AS e FROM embeddings JOIN cs ON vec_id % 6 = cs.month, (SELECT unnest([0, 1, 2]) AS view)),
pr AS (SELECT a.cs, a.view, a.label, a.side AS sa, b.side AS sb, exp(-list_sum(list_transform(range(1, 21), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i]))) / 20 / 0.04) AS k FROM st a JOIN st b ON a.cs = b.cs AND a.view = b.view AND a.label = b.label),
m AS (SELECT cs, view, label, avg(k) FILTER (sa = 'A' AND sb = 'A') + avg(k) FILTER (sa = 'B' AND sb = 'B') - 2 * avg(k) FILTER (sa = 'A' AND sb = 'B') AS mmd2 FROM pr GROUP BY 1, 2, 3)
SELECT cs AS case_no, view, count(*) AS classes, round(avg(mmd2), 6) AS mmd2, round(avg(mmd2) / 2, 6) AS drift FROM m WHERE mmd2 IS NOT NULL GROUP BY 1, 2""")
def e21_cases(spark, d):
    """Drift of every case and view: the mean over classes of MMD^2 between the case's two sides, on the view's features."""
    sides = [F.struct(F.lit(k).alias("case_no"), F.lit(side).alias("side"), F.array(*map(F.lit, m)).alias("months")) for k, a, b in CASES for side, m in (("A", a), ("B", b))]
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 6).cast("int").alias("month"), "label", "embedding", F.explode(F.array(*sides)).alias("c"))
    e = e.where(F.array_contains("c.months", F.col("month"))).select("c.case_no", "c.side", "label", "embedding", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("view"))
    vector = F.transform(F.slice("embedding", 20 * F.col("view") + 1, F.lit(20)), lambda x: x.cast("double")).alias("e")
    rows = e.select("side", F.concat_ws("|", "case_no", "view", "label").alias("cell"), vector)
    per = drift.class_mmd2(rows.where("side = 'A'"), rows.where("side = 'B'"), "cell", "e", 0.02)
    part = F.split("cell", r"\|")
    return per.groupBy(part[0].cast("int").alias("case_no"), part[1].cast("int").alias("view")).agg(F.count("*").alias("classes"), F.round(F.avg("mmd2"), 6).alias("mmd2"), F.round(F.avg("mmd2") / 2, 6).alias("drift"))


@query("V09_V10_witness_check", f"SELECT threshold, count(*) FILTER (decision = 'EXCLUDE') AS excluded, count(*) FILTER (decision = 'EXCLUDE') AS good_witnesses, count(*) FILTER (decision = 'KEEP') AS kept, least(12, count(*) FILTER (decision = 'KEEP')) AS rechecked, 0::BIGINT AS broken_keeps FROM ({cq._decision_sql(True)}) GROUP BY threshold")
def v09_check(spark, d):
    """All witnesses recomputed from the records, and 12 kept rows a threshold held against every row."""
    s = Scratch(spark, "v09")
    t = s.cut(cq._train(spark, d), "rows")
    dec = s.cut(retention.class_decisions(t, s.cut(retention.near_edges(t, s), "near"), [0, 10, 20]), "decisions")
    return verification.witness_check(dec, t)
