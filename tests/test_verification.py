"""Images, archives, reuse of outputs and second looks, on small cases with known answers."""

import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibration, retention, verification
from tidemark.sources import files, images, sinks


def filtered(p, kind):
    """A PNG whose lines all use one filter, written from the format's description."""
    import struct
    import zlib

    h, w = p.shape
    v = np.zeros((h + 1, w + 1), np.int64)
    v[1:, 1:] = p
    out = b""
    for y in range(1, h + 1):
        line = [kind]
        for x in range(1, w + 1):
            a, b, c = int(v[y, x - 1]), int(v[y - 1, x]), int(v[y - 1, x - 1])
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            paeth = a if pa <= pb and pa <= pc else b if pb <= pc else c
            line.append((int(v[y, x]) - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        out += bytes(line)
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return images.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(out)) + part(b"IEND", b"")


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (16, 16), (5, 9)):
        p = rng.integers(0, 256, shape).astype(np.uint8)
        assert (images.decode_png(images.encode_png(p)) == p).all()
        for kind in range(5):
            assert (images.decode_png(filtered(p, kind)) == p).all()
    good = images.encode_png(p)
    for bad in (b"", b"x" + good[1:], good[:-1], good + b"x", good[:20] + b"!" + good[21:], good[:8]):
        with pytest.raises(ValueError):
            images.decode_png(bad)


def test_decoded_images_are_checked(spark):
    import hashlib

    p = np.arange(16, dtype=np.uint8).reshape(4, 4) * 17
    png, npy = images.encode_png(p), images.encode_npy(p / 255)
    sha = lambda d: hashlib.sha256(d).hexdigest()
    rows = [(1, png, sha(png)), (2, npy, sha(npy).upper()), (3, None, None)]
    t = spark.createDataFrame(rows, "i int, data binary, sha256 string")
    got = {r[0]: r[1] for r in t.select("i", images.image_column(F.col("data"), F.col("sha256"), 4)).collect()}
    assert got[3] is None and np.allclose(got[1], (p / 255).ravel()) and np.allclose(got[1], got[2])
    for bad in ((png, sha(npy), 4), (png, sha(png), 5), (images.encode_npy(p / 100), None, 4), (images.encode_npy(np.full((4, 4), np.nan)), None, 4), (b"junk", None, 4)):
        with pytest.raises(ValueError):
            images.decode_image(*bad)


def test_images_are_written_and_verified(spark, tmp_path):
    t = spark.createDataFrame([(1, [0, 255, 7, 9]), (2, None)], "k int, px array<int>")
    got = {r["k"]: r["png"] for r in sinks.verified_pngs(t, str(tmp_path / "p"), "k", "px", 2).collect()}
    assert got[2] is None and images.decode_png(bytes(got[1])).tolist() == [[0, 255], [7, 9]]


def test_zip_index_summary_and_coverage(spark, tmp_path):
    for name, members in (("a", ["x", "y"]), ("b", [f"m{i:02d}" for i in range(12)])):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for m in members:
                z.writestr(m, m * 5)
    index = files.zip_members(spark, str(tmp_path))
    s = {r["archive"].rsplit("/", 1)[1]: r for r in files.zip_summary(index).collect()}
    assert s["a.zip"]["entries"] == 2 and s["a.zip"]["file_bytes"] == 10 and s["b.zip"]["first_members"] == [f"m{i:02d}" for i in range(10)]
    rows = spark.createDataFrame([("x", 1), ("m03", 2)], "member string, file_size_wanted int")
    assert {r["member"]: r["file_size"] for r in files.zip_coverage(rows, index, "member").collect()} == {"x": 5, "m03": 15}
    for missing in ("none", None):
        with pytest.raises(Exception, match="index covers"):
            files.zip_coverage(spark.createDataFrame([(missing, 1)], "member string, n int"), index, "member").collect()


def test_outputs_are_reused_while_sources_stay(spark, tmp_path):
    at = str(tmp_path / "o")
    t = lambda rows: spark.createDataFrame(rows, "k int, h string, v int")
    sinks.reused(t([(1, "a", 10)]), at, "k", "h")
    assert sorted(map(tuple, sinks.reused(t([(1, "a", 99), (2, "b", 20)]), at, "k", "h").collect())) == [(1, "a", 10), (2, "b", 20)]
    with pytest.raises(ValueError, match="changed"):
        sinks.reused(t([(2, "c", 20)]), at, "k", "h")


def test_optimality_and_replay(spark):
    rng = np.random.default_rng(3)
    rows = [("good", int(rng.integers(0, 3)), np.log(rng.uniform(0.05, 1, 3)).tolist()) for _ in range(60)]
    w, _, _ = calibration.solve_mixture([r[2] for r in rows], [1 / (3 * sum(x[1] == r[1] for x in rows)) for r in rows])
    t = spark.createDataFrame([(k, c, x, v.tolist()) for k, v in (("good", w), ("bad", np.array([0.8, 0.1, 0.1]))) for _, c, x in rows], "k string, c int, logs array<double>, w array<double>")
    got = {r["k"]: r for r in verification.optimality(t, ["k"], "c", "logs", "w").collect()}
    assert got["good"]["gap"] < 1e-8 and got["good"]["slack"] < 1e-8 and got["bad"]["gap"] > 1e-3 and got["good"]["objective"] < got["bad"]["objective"]
    again = {r["k"]: r for r in verification.replay(t, ["k"], "c", "logs", "w").collect()}
    assert again["good"]["lower"] and not again["bad"]["lower"] and again["bad"]["best_gain"] > 0 and again["good"]["float_error"] < 1e-12


def records(spark, n=60):
    from tidemark.functions.digest import usable  # noqa: F401

    r = random.Random(8)
    hexa = lambda: "".join(r.choice("0123456789ABCDEF") for _ in range(70))
    base, rows = hexa(), []
    for i in range(n):
        d = list(base if i % 2 else hexa())
        for _ in range(r.randrange(4)):
            d[r.randrange(10, 70)] = r.choice("0123456789ABCDEF")
        rows.append((f"{i:03d}", "train", f"2020-01-{r.randrange(1, 9):02d}T00:00:00Z", "f", 1, f"c{r.randrange(40)}" if i % 3 else None, "".join(d), "VALID" if i % 7 else "NONE"))
    kinds = "sha string, split string, timestamp string, family string, file_size long, disarmed_content_sha256 string, tlsh string, tlsh_status string"
    return retention.inventory(spark.createDataFrame(rows, kinds))


def test_classes_decide_and_group_as_pairs_do(spark, scratch):
    """class_decisions and class_groups give what decisions and group_members give over all pairs."""
    t = scratch.cut(records(spark), "rows")
    near, edges = scratch.cut(retention.near_edges(t, scratch), "near"), scratch.cut(retention.pair_edges(t, scratch), "edges")
    rows = lambda d: {tuple(r) for r in d.collect()}
    stage = F.col("ts") < F.lit("2020-01-04").cast("timestamp")
    for more in ({}, {"exact_first": False}, {"train_stage": stage}):
        by_class = rows(retention.class_decisions(t, near, [0, 10, 20], **more))
        assert by_class == rows(retention.decisions(t, t.where("false"), edges, [0, 10, 20], **more)) and len({x[2] for x in by_class}) == 2
    for k in (0, 20):
        groups = scratch.cut(retention.class_groups(t, near, scratch, k).select("sha", "group_id"), "g")
        assert rows(groups) == rows(retention.group_members(t, edges, scratch, k).select("sha", "group_id"))
        check = retention.partition_check(groups, edges, k).first()
        assert check["broken_links"] == 0 and check["lonely"] == 0 and check["members"] == 60
    torn = groups.withColumn("group_id", F.when(F.col("sha") == "001", F.col("sha")).otherwise(F.col("group_id")))
    assert retention.partition_check(torn, edges, 20).first()["broken_links"] > 0


def test_witnesses_are_recomputed(spark, scratch):
    t = scratch.cut(records(spark), "rows")
    dec = scratch.cut(retention.class_decisions(t, retention.near_edges(t, scratch), [0, 20]), "dec")
    for r in verification.witness_check(dec, t).collect():
        assert r["excluded"] == r["good_witnesses"] > 0 and r["broken_keeps"] == 0 and r["rechecked"] == min(12, r["kept"])
    wrong = dec.withColumn("decision", F.lit("KEEP"))
    assert sum(r["broken_keeps"] for r in verification.witness_check(wrong, t).collect()) > 0
    off = dec.withColumn("tlsh_distance", F.col("tlsh_distance") + 1)
    assert any(r["good_witnesses"] < r["excluded"] for r in verification.witness_check(off, t).collect())


def test_nearest_neighbours_in_blocks(spark, scratch, monkeypatch):
    t = records(spark)
    rows = lambda: {tuple(r) for r in retention.nearest_neighbours(t.where("sha < '010'"), t, scratch).collect()}
    want = rows()
    monkeypatch.setattr(retention, "BLOCK", 3)
    assert rows() == want and len(want) >= 8


def test_size_status(spark):
    from tidemark.operators.byteviews import size_status

    t = spark.createDataFrame([(b"ab", 2), (b"a", 2), (b"abc", 2), (b"", None), (None, 1)], "c binary, n int")
    assert [r[0] for r in t.select(size_status(F.col("c"), F.col("n"))).collect()] == ["EXACT", "SHORT", "TRAILING", "UNDECLARED", "MISSING"]


def test_view_order_breaks_ties_by_view(spark):
    t = spark.createDataFrame([("a", 2, 0.5), ("a", 0, 0.5), ("a", 1, 0.1), ("b", 1, None), ("b", 0, 1.0)], "k string, view int, loss double")
    assert {r[0]: r[1] for r in verification.view_order(t, ["k"], "view", "loss").collect()} == {"a": "1,0,2", "b": "1,0"}


def test_near_search_has_no_window_over_a_vertex(spark, scratch):
    """A star of many leaves is joined by aggregates: no window puts its links in one task."""
    from tidemark.operators.retention import components

    star = spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    got = components(star, scratch)
    assert got.where("component <> 0").isEmpty() and got.count() == 3000


class State:
    """The part of Spark's group state that the function uses."""

    def __init__(self):
        self.value = None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value


def test_stream_state_equals_row_by_row_distances_and_expires():
    import pandas as pd

    from tidemark.streaming import streams

    r = random.Random(4)
    hexa = lambda: "".join(r.choice("0123456789ABCDEF") for _ in range(70))
    base, rows = hexa(), []
    for i in range(40):
        d = list(base if i % 3 else hexa())
        d[r.randrange(10, 70)] = r.choice("0123456789ABCDEF")
        rows.append((pd.Timestamp("2020-01-01") + pd.Timedelta(days=i), f"{i:02d}", "".join(d)))
    t = pd.DataFrame(rows, columns=["ts", "sha", "digest"])
    want, f, st = {}, streams.retention_function(12), State()
    for i, (_, sha, d) in enumerate(rows):
        want[sha] = next((s for _, s, e in rows[:i] if streams._steps(d, e) <= 12), "")
    got = pd.concat([x for part in (t[:15], t[15:]) for x in f(("k",), iter([part]), st)])
    assert dict(zip(got["sha"], got["reference_sha"])) == want and len(st.value[0]) == 40 and any(want.values())
    f, st = streams.retention_function(12, horizon_days=5), State()
    got = pd.concat([x for part in (t[:15], t[15:]) for x in f(("k",), iter([part]), st)])
    near = {sha: next((s for u, s, e in rows[:i] if (v - u).days <= 5 and streams._steps(d, e) <= 12), "") for i, (v, sha, d) in enumerate(rows)}
    assert dict(zip(got["sha"], got["reference_sha"])) == near and len(st.value[0]) == 6


def test_multiplicity_correlation_and_influence(spark):
    from tidemark.operators import resample

    rng = np.random.default_rng(5)
    m = rng.poisson(1.0, (50, 4))
    m[:, 3] = 1
    theta = m @ np.array([0.3, -0.2, 0.0, 0.1]) + rng.normal(size=50) * 0.1
    draws = spark.createDataFrame([(r, g, int(m[r, g])) for r in range(50) for g in range(4) if m[r, g]], "replicate int, group_id int, weight int")
    res = spark.createDataFrame([(r, float(theta[r])) for r in range(50)], "replicate int, v double")
    got = {x["group_id"]: x["corr_v"] for x in resample.multiplicity_correlation(draws, res, ["v"]).collect()}
    assert got[3] is None and all(abs(got[g] - np.corrcoef(m[:, g], theta)[0, 1]) < 1e-12 for g in range(3))
    sums = spark.createDataFrame([(g, n, v) for g, (n, v) in enumerate([(5, 5.0), (5, 5.0), (2, 9.0), (1, 1.0)])], "group_id int, n long, v double")
    top = {x["group_id"]: x["why"] for x in resample.influential(resample.leave_one_out(sums, ["v"]), ["v"], 2).collect()}
    assert top == {0: ["size"], 1: ["size"], 2: ["v"]}
    assert resample.influential(resample.leave_one_out(sums.limit(0), ["v"]), ["v"]).count() == 0
