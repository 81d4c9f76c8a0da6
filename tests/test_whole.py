"""The registered queries do the whole job of their operator: caps, draws and seeds of the reference, against NumPy."""

import hashlib
import json
import os
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.operators import drift

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
QUERIES = __spark_entry__.queries()


def embeddings():
    return pd.read_parquet(f"{FOLDER}/embeddings.parquet")


def ranked(rows, *prefix):
    return sorted(rows, key=lambda ids: (hashlib.sha256(json.dumps([*prefix, *map(str, ids)], separators=(",", ":")).encode()).hexdigest(), *map(str, ids)))


def bandwidth(label, ids, x):
    """The reference's E19 by plain loops: (median, pairs a class)."""
    ref = {c: sorted(i for (i,) in ranked([(i,) for i in ids[label == c]], "ref")[:128]) for c in np.unique(label)}
    at = {i: k for k, i in enumerate(ids)}
    rows = {c: x[[at[i] for i in ref[c]]] for c in ref}
    mean = np.mean([r.mean(0) for r in rows.values()], 0)
    std = np.sqrt(np.mean([np.square(r - mean).mean(0) for r in rows.values()], 0))
    z = (x - mean) / std
    found = []
    for c in ref:
        pairs = ranked(combinations(ref[c], 2), "pair")[:128]
        found += [(np.square(z[at[a]] - z[at[b]]).mean(), 5_765_760 // len(pairs)) for a, b in pairs]
    total, run = sum(w for _, w in found), 0
    for value, w in sorted(found):
        run += w
        if 2 * run >= total:
            return value


@tables
def test_bandwidth_of_128_rows_and_128_pairs_a_class(spark):
    t = embeddings()
    t = t[t.vec_id % 3 == 0]
    want = bandwidth(t.label.to_numpy(), t.vec_id.to_numpy(), np.stack(t.embedding.to_numpy()).astype(float))
    assert abs(QUERIES["E19_train_bandwidth"](spark, FOLDER).first()["median"] - want) < 1e-9
    assert abs(QUERIES["E21_drift_measurement"](spark, FOLDER).first()["bandwidth"] - want) < 1e-9
    assert QUERIES["W02_reference_128"](spark, FOLDER).count() == len(t)


def test_bandwidth_gives_classes_equal_mass(spark):
    rng = np.random.default_rng(7)
    label = np.repeat([0, 1, 2], [2, 9, 40])  # 1, 36 and 128 of 780 pairs
    x = rng.normal(size=(51, 3)) * (1 + 3 * label[:, None])
    ids = np.arange(51)
    rows = spark.createDataFrame([(int(c), int(i), v.tolist()) for c, i, v in zip(label, ids, x)], "label int, vec_id long, e array<double>")
    z = drift.z_scores(rows, "e", drift.equal_class_moments(rows, "label", "e"))
    pairs = drift.reference_pairs(z, "label", "vec_id", F.lit('"pair"'))
    assert {r["label"]: r["count"] for r in pairs.groupBy("label").count().collect()} == {0: 1, 1: 36, 2: 128}
    assert abs(drift.train_bandwidth(z, "label", "vec_id", "e", F.lit('"pair"')).first()["median"] - bandwidth(label, ids, x)) < 1e-9
    with pytest.raises(Exception, match="fewer than 2"):
        drift.train_bandwidth(z.where("vec_id > 0"), "label", "vec_id", "e", F.lit('"pair"')).collect()


def sums_of(spark, view=None):
    """(groups, n, total nll) of seed 0: of one view by class, or of the mixture."""
    from tidemark.plans.tables import fused, predictions

    t = (predictions(spark, FOLDER).where(f"seed = 0 AND view = {view}") if view is not None else fused(spark, FOLDER).where("seed = 0")).select("group_id", "label", "nll").toPandas()
    groups = np.sort(t.group_id.unique())
    return groups, t.assign(g=np.searchsorted(groups, t.group_id))


@tables
def test_2000_exponential_draws(spark):
    losses = []
    for view in range(3):
        groups, t = sums_of(spark, view)
        w = np.random.default_rng(42).exponential(size=(2000, len(groups)))
        cls = []
        for _, x in t.groupby("label"):
            n, v = (np.bincount(x.g, k, len(groups)) for k in (None, x.nll))
            cls.append((w @ v) / (w @ n))
        losses.append(np.mean(cls, 0))
    cov = np.cov(losses, ddof=1)
    got = {r["view"]: r for r in QUERIES["E24_A33_exponential_draws"](spark, FOLDER).collect()}
    for v, x in enumerate(losses):
        assert abs(got[v]["mean"] - x.mean()) < 1e-9 and abs(got[v]["uncertainty"] - x.std(ddof=1)) < 1e-9
        assert np.allclose([got[v][f"q_{q}"] for q in ("0_025", "0_5", "0_975")], np.quantile(x, [0.025, 0.5, 0.975]))
        assert np.allclose([got[v][f"covariance_{u}"] for u in range(3)], cov[v])


@tables
def test_2000_multinomial_draws(spark):
    groups, t = sums_of(spark)
    g = len(groups)
    n, v = (np.bincount(t.g, k, g) for k in (None, t.nll))
    d = np.random.default_rng(42).multinomial(g, np.full(g, 1 / g), size=2000)
    want = (d @ v) / (d @ n)
    got = {r["replicate"]: r["nll"] for r in QUERIES["E25_multinomial_draws"](spark, FOLDER).collect()}
    assert len(got) == 2000 and np.allclose([got[i] for i in range(2000)], want)
    x = QUERIES["A32_distribution"](spark, FOLDER).first()
    assert abs(x["sd"] - want.std(ddof=1)) < 1e-9 and abs(x["q_0_5"] - np.quantile(want, 0.5)) < 1e-9
    q = {r["level"]: r["quantile"] for r in QUERIES["E26_multinomial_intervals"](spark, FOLDER).collect()}
    assert np.allclose([q[0.025], q[0.975]], np.quantile(want, [0.025, 0.975]))
    m = embeddings()
    hit = np.array([[(d[r, np.unique(np.searchsorted(groups, x // 3))] > 0).any() for r in range(500)] for _, x in m.groupby("label").vec_id])
    p = {r["class"]: r["missed_share"] for r in QUERIES["E30_multinomial_pilot"](spark, FOLDER).collect()}
    assert np.allclose([p[c] for c in sorted(p)], 1 - hit.mean(1))


@tables
def test_20000_seed_and_group_draws(spark):
    from tidemark.plans.tables import fused

    t = fused(spark, FOLDER).select("seed", "group_id", "correct").toPandas()
    groups = np.sort(t.group_id.unique())
    g = len(groups)
    at = np.searchsorted(groups, t.group_id)
    k = np.array([np.bincount(at[t.seed == s], t.correct[t.seed == s].astype(float), g) for s in range(5)])
    n = np.bincount(at[t.seed == 0], minlength=g)
    rng, want = np.random.Generator(np.random.PCG64(42)), []
    for _ in range(20_000):
        ss, gg = rng.integers(0, 5, size=5), rng.integers(0, g, size=g)
        want.append((k[ss][:, gg].sum(1) / n[gg].sum()).mean())
    levels = [0.0025, 0.025, 0.975, 0.9975]
    got = {r["level"]: r["quantile"] for r in QUERIES["E29_seed_group_draws"](spark, FOLDER).collect()}
    assert np.allclose([got[x] for x in levels], np.quantile(want, levels), atol=1e-9)


@tables
def test_whole_counts_of_flags_and_simulation(spark, monkeypatch):
    from tidemark.operators import resample, simulation

    made, simulated = [], []
    draws, run = resample.multinomial_draws, simulation.run
    monkeypatch.setattr(resample, "multinomial_draws", lambda *a: made.append(draws(*a)) or made[-1])
    monkeypatch.setattr(simulation, "run", lambda *a: simulated.append(run(*a)) or simulated[-1])
    QUERIES["E28_bootstrap_flags"](spark, FOLDER)
    assert made[0].agg(F.count_distinct("replicate")).first()[0] == 2000
    QUERIES["E31_uncertainty_simulation"](spark, FOLDER)
    assert simulated[0].select("layout", "dataset").distinct().count() == 2100
    x = simulated[0].where("layout = 3 AND dataset = 299").orderBy("view").toPandas()
    assert np.allclose(x.uncertainty, simulation.one_dataset(3, 299, 2000)[1])


@tables
@pytest.mark.parametrize("name, rows", [("B16_log_softmax_seeds", 30), ("E03_uniform_fusion_seeds", 10), ("E04_weighted_fusion_seeds", 10), ("E05_cross_fit", 3)])
def test_all_seeds_come_out(spark, name, rows):
    n = len(embeddings()) * rows
    assert {r["seed"]: r["count"] for r in QUERIES[name](spark, FOLDER).groupBy("seed").count().collect()} == dict.fromkeys(range(5), n)


@tables
def test_distribution_has_11_quantiles(spark):
    x = QUERIES["A32_distribution"](spark, FOLDER).first()
    v = [r["nll"] for r in QUERIES["E25_multinomial_draws"](spark, FOLDER).select("nll").collect()]
    levels = [0.0, 0.001, 0.01, 0.025, 0.25, 0.5, 0.75, 0.975, 0.99, 0.999, 1.0]
    assert np.allclose([x[f"q_{str(q).replace('.', '_')}"] for q in levels], np.quantile(v, levels))


def test_comparison_searches_64_anchors_of_4096_bytes(spark, tmp_path):
    text = "".join(np.random.default_rng(8).choice(list("abcdefghijklmnop"), 8000))
    rows = [("long", text, "c"), ("cut", text[:5000], "c"), ("short", text[:4095], "c")]
    spark.createDataFrame(rows, "doc_id string, text string, campaign_id string").write.parquet(f"{tmp_path}/documents.parquet")
    r = {x[0]: x[-1] for x in QUERIES["B11_B12_compare"](spark, str(tmp_path)).collect()}
    assert r == {"cut": 64, "short": 0}
