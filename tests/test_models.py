"""Metrics, calibration, drift and resampling against NumPy and hand-made answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import assertions, calibration, drift, metrics, resample


def test_log_softmax_argmax_mixture(spark):
    t = spark.createDataFrame([([1000.0, 0.0, 1000.0], [math.log(0.2), math.log(0.3), math.log(0.5)])], "z array<double>, b array<double>")
    a = metrics.log_softmax(F.col("z"))
    got = t.select(a.alias("a"), metrics.argmax(F.col("z")).alias("m"), metrics.mixture([a, F.col("b")]).alias("u"), metrics.mixture([a, F.col("b")], [0.0, 1.0]).alias("w")).first()
    assert np.allclose(got["a"], [math.log(0.5), -1000 + math.log(0.5), math.log(0.5)]) and got["m"] == 0
    assert np.allclose(np.exp(got["u"]), [0.35, 0.15, 0.5]) and np.allclose(np.exp(got["w"]), [0.2, 0.3, 0.5])


def known(spark):
    """Logits ln 9 and 0 four times, three of four right: T = 2, and at T = 2 Brier 0.375 and ECE 0."""
    z = [math.log(9.0), 0.0]
    return spark.createDataFrame([("a", z, y) for y in (0, 0, 0, 1)], "seed string, logits array<double>, label int")


def test_known_temperature(spark):
    t = calibration.fit_temperatures(known(spark), ["seed"]).first()
    assert abs(t["temperature"] - 2) < 1e-9 and not t["boundary"]
    p = metrics.sample_metrics(known(spark).withColumn("logp", metrics.log_softmax(F.col("logits"), 2.0)))
    s = metrics.summary(p, ["seed"], 2).first()
    assert abs(s["brier"] - 0.375) < 1e-12 and abs(s["ece_15"]) < 1e-12 and s["accuracy"] == 0.75 and s["supported_classes"] == 2
    sure = spark.createDataFrame([("a", [3.0, 0.0], 0), ("b", [3.0, 0.0], 1)], "seed string, logits array<double>, label int")
    assert {r["seed"]: (r["temperature"], r["boundary"]) for r in calibration.fit_temperatures(sure, ["seed"]).collect()} == {"a": (0.05, True), "b": (20.0, True)}
    assert calibration.fit_temperatures(sure.where("false"), ["seed"]).count() == 0


def test_summary_without_truth_or_prediction(spark):
    rows = [("m", y, p) for y, p in ((0, 0), (0, 1), (1, 1), (3, 0))]
    t = spark.createDataFrame(rows, "by string, label int, predicted int")
    pc = {r["label"]: r for r in metrics.per_class(metrics.confusion(t, ["by"]), ["by"], 4).collect()}
    assert pc[2]["recall"] is None and pc[2]["f1"] == 0 and pc[3]["recall"] == 0 and pc[0]["f1"] == 0.5 and abs(pc[1]["f1"] - 2 / 3) < 1e-12
    support = spark.createDataFrame([(0,), (2,)], "label int")
    assert metrics.fixed_support_f1(t, ["by"], support).first()["f1"] == 0.25


def test_balanced_loss_keeps_its_denominator(spark):
    t = spark.createDataFrame([("v", 0, 1.0), ("v", 0, 3.0), ("v", 1, 4.0)], "view string, label int, nll double")
    assert metrics.balanced_loss(t, ["view"], "label", "nll").first()["class_balanced"] == 3.0
    assert metrics.balanced_loss(t, ["view"], "label", "nll", spark.createDataFrame([(0,), (5,)], "label int")).first()["class_balanced"] is None


def test_worst_month_is_taken_within_a_seed(spark):
    t = spark.createDataFrame([(0, "m", 1, 0.2), (0, "m", 2, 0.9), (1, "m", 1, 0.8), (1, "m", 2, 0.1)], "seed int, method string, month int, f double")
    s = metrics.spread(metrics.mean_and_worst(t, ["seed", "method"], "f"), ["method"], "worst_month").first()
    assert abs(s["mean"] - 0.15) < 1e-12


def test_weights_shift_and_beta_ties(spark):
    t = spark.createDataFrame([("a", v, x) for v, x in enumerate((1.0, 2.0, 0.5))], "seed string, view int, loss double")
    w = lambda c: [r["weight"] for r in metrics.softmax_weights(t, ["seed"], -F.col("loss") + c).orderBy("view").collect()]
    assert np.allclose(w(0), w(100)) and abs(sum(w(0)) - 1) < 1e-12
    e = spark.createDataFrame([(b, v, 0.5) for b in (0.0, 0.5, 1.0) for v in range(3)], "beta double, view int, e double")
    assert [r["beta"] for r in calibration.select_beta(e, "view", "e").where("chosen").collect()] == [0.0]


def test_mixture_solver_meets_its_conditions():
    rng = np.random.default_rng(3)
    for scale in (0.3, 1, 3):
        logs = np.log(rng.dirichlet(np.ones(3) * scale, 400) + 1e-9)
        alpha = rng.dirichlet(np.ones(400))
        w, _, residual = calibration.solve_mixture(logs, alpha)
        g = (alpha / (np.exp(logs) @ w)) @ np.exp(logs)
        assert residual <= 1e-10 and abs(w.sum() - 1) < 1e-12 and g.max() < 1 + 1e-8
    one = np.log(np.array([[0.9, 0.1, 0.1]] * 5))
    assert np.allclose(calibration.solve_mixture(one, np.full(5, 0.2))[0], [1, 0, 0])
    z = np.array([1e-9, -1e-6, 1e-4, 0.5])
    assert np.allclose(calibration.log_remainder(z), [5e-19, 5.0000033e-13, 4.99966669e-9, 0.5 - math.log(1.5)], rtol=1e-6)
    assert np.allclose(calibration.simplex_projection([2, 0, 0]), [1, 0, 0])


def test_learned_weights_and_cross_fit(spark):
    rng = np.random.default_rng(4)
    rows = [("s", int(i % 3), [float(x) for x in np.log(rng.dirichlet(np.ones(3)))], int(i % 5), [float(x) + (i % 3 == k) for k, x in enumerate(rng.normal(size=3))]) for i in range(200)]
    t = spark.createDataFrame(rows, "seed string, label int, logs array<double>, fold int, logits array<double>")
    w = calibration.learned_weights(t, ["seed"], "label", "logs").first()
    assert abs(sum(w["weights"]) - 1) < 1e-9 and w["residual"] <= 1e-10
    x = calibration.cross_fit(t, ["seed"], "fold")
    assert x.count() == 200 and x.select("temperature").distinct().count() == 5


def test_moments_and_mmd(spark):
    rng = np.random.default_rng(5)
    rows = [(f"c{i % 3 if i < 90 else 0}", i, "AB"[i % 2], [float(v) for v in rng.normal(size=4)]) for i in range(120)]
    t = spark.createDataFrame(rows, "c string, i int, s string, e array<double>")
    x, c = np.array([r[3] for r in rows]), np.array([r[0] for r in rows])
    mean = np.mean([x[c == k].mean(0) for k in np.unique(c)], 0)
    std = np.sqrt(np.mean([np.square(x[c == k] - mean).mean(0) for k in np.unique(c)], 0))
    m = drift.equal_class_moments(t, "c", "e").orderBy("dim").collect()
    assert np.allclose([r["mean"] for r in m], mean) and np.allclose([r["std"] for r in m], std)
    k = lambda a, b: np.exp(-np.square(a[:, None] - b[None]).mean(2) / (2 * 0.7)).mean()
    s = np.array([r[2] for r in rows])
    got = {r["c"]: r["mmd2"] for r in drift.class_mmd2(t.where("s = 'A'"), t.where("s = 'B'"), "c", "e", 0.7).collect()}
    for n in np.unique(c):
        a, b = x[(c == n) & (s == "A")], x[(c == n) & (s == "B")]
        assert abs(got[n] - (k(a, a) + k(b, b) - 2 * k(a, b))) < 1e-12
    same = drift.class_mmd2(t, t, "c", "e", 0.7).collect()
    assert all(0 <= r["mmd2"] < 1e-12 for r in same)
    z = drift.z_scores(t, "e", drift.equal_class_moments(t, "c", "e")).withColumn("w", F.lit(1.0))
    rank, cond = drift.rank_and_condition(z, "e", "w")
    sv = np.linalg.svd((x - mean) / std, compute_uv=False)
    assert rank == 4 and abs(cond - sv[0] / sv[-1]) < 1e-6
    with pytest.raises(ValueError):
        drift.class_mmd2(t, t, "c", "e", 0.0)


def test_group_mass_does_not_see_repeated_groups(spark):
    t = spark.createDataFrame([("c", "g1", [0.0]), ("c", "g2", [1.0]), ("c", "g2", [1.0])], "c string, g string, e array<double>")
    u = spark.createDataFrame([("c", "h1", [0.0]), ("c", "h2", [1.0])], "c string, g string, e array<double>")
    w = lambda d: drift.group_mass(d, ["c"], "g")
    assert drift.class_mmd2(w(t), w(u), "c", "e", 1.0, "weight").first()["mmd2"] < 1e-12


def test_weighted_median(spark):
    t = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 2), (9.0, 10**15)], "v double, w long")
    assert drift.weighted_median(t, "v", "w").first()["median"] == 9.0
    assert drift.weighted_median(t.where("v < 9"), "v", "w").first()["median"] == 2.0


def test_resampling_uses_sufficient_statistics(spark):
    rng = np.random.default_rng(6)
    rows = [(f"g{i % 7}", float(v)) for i, v in enumerate(rng.normal(size=100))]
    t = spark.createDataFrame(rows, "group_id string, v double")
    sums = resample.group_sums(t, "group_id", ["v"])
    groups = sorted({r[0] for r in rows})
    draws = resample.multinomial_draws(spark, groups, 40).withColumnRenamed("multiplicity", "weight")
    got = {r["replicate"]: r["v"] for r in resample.resampled(draws, sums, ["v"]).collect()}
    d = np.random.default_rng(42).multinomial(7, np.full(7, 1 / 7), size=40)
    tot = np.array([[sum(v for g, v in rows if g == k), sum(g == k for g, _ in rows)] for k in groups])
    want = (d @ tot[:, 0]) / (d @ tot[:, 1])
    assert all(abs(got[i] - want[i]) < 1e-12 for i in range(40))
    loo = {r["group_id"]: r["loo_v"] for r in resample.leave_one_out(sums, ["v"]).collect()}
    assert abs(loo["g0"] - np.mean([v for g, v in rows if g != "g0"])) < 1e-12
    q = [r["quantile"] for r in resample.intervals(resample.resampled(draws, sums, ["v"]), [], "v", [0.025, 0.975]).orderBy("level").collect()]
    assert np.allclose(q, np.quantile(want, [0.025, 0.975]))
    h = [r["n"] for r in resample.histogram(t, "v").orderBy("bin").collect()]
    assert h == np.histogram([r[1] for r in rows], bins=40)[0].tolist()
    e = resample.exponential_draws(spark, groups, 30)
    assert e.count() == 210 and resample.resampled(e, sums, ["v"]).count() == 30


def test_package_rules():
    views = lambda s: {v: {"temperature": 1.0, "checkpoint_sha256": f"{s}{v}"} for v in "xyz"}
    soft = lambda x: [math.exp(v) / sum(math.exp(u) for u in x) for v in x]
    L, d = [1.0, 0.5, 0.2], [0.1, 0.2, 0.3]
    entry = lambda s: {"views": views(s), "L": L, "d": d, "weights": {"Q": soft([-a for a in L]), "QD": soft([-a - 0.5 * b for a, b in zip(L, d)])}}
    spec = {"seeds": [1, 2, 3, 4, 5], "class_to_idx": {f"c{i}": i for i in range(51)}, "beta": 0.5, "entries": {str(s): entry(s) for s in range(1, 6)}}
    assert assertions.package(spec) is spec
    spec["entries"]["3"]["weights"]["Q"][0] += 1e-6
    with pytest.raises(assertions.DataError):
        assertions.package(spec)


def test_simulation(spark):
    from tidemark.operators import simulation

    x = simulation.run(spark, [1, 4, 7], 20, 200)
    s = {(r["layout"], r["view"]): r for r in simulation.summary(x).collect()}
    assert x.count() == 180 and len(s) == 9
    rows = np.array([(r["point"], r["uncertainty"]) for r in x.where("layout = 4 AND view = 1").collect()])
    stat = lambda a: a[:, 1].mean() / a[:, 0].std(ddof=1)
    drop = np.array([stat(np.delete(rows, i, 0)) for i in range(20)])
    assert abs(s[4, 1]["ratio"] - stat(rows)) < 1e-9 and abs(s[4, 1]["jackknife_se"] - np.sqrt(19 / 20 * np.square(drop - drop.mean()).sum())) < 1e-9
