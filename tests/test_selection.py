"""Selection, retention, folds, skew, assertions on small tables with known answers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.digest import PARTS, distance, pack, usable
from tidemark.functions.keys import clean, instant, spread_ids
from tidemark.operators import assertions, cohort, retention, skew
from tidemark.streaming.streams import _steps

HEX = "0123456789ABCDEF"


def test_normal_forms(spark):
    rows = [(" AbC\t", "2019-09-29 12:31:36+05:30"), ("x\n", "2019-09-29T12:31:36Z"), (None, None), ("", "2019-09-29 12:31:36.250000"), ("y", "soon"), ("z", "2019-09-29")]
    got = spark.createDataFrame(rows, "k string, t string").select(clean("k"), instant("t")).collect()
    assert [r[0] for r in got] == ["abc", "x", None, "", "y", "z"]
    at = lambda *a: dt.datetime(2019, 9, 29, *a)
    assert [r[1] for r in got] == [at(7, 1, 36), at(12, 31, 36), None, at(12, 31, 36, 250000), None, at(0)]


def test_dense_ids(spark):
    d = spark.createDataFrame([(f"t{i % 700}",) for i in range(2000)] + [(None,)], "t string")
    ids = {r["t"]: r["i"] for r in spread_ids(d, "t", "i", 16).collect()}
    assert len(ids) == 700 and sorted(ids.values()) == list(range(700))


def test_published_digest_pair_and_random_ones(spark):
    r = random.Random(1)
    digests = ["".join(r.choice(HEX) for _ in range(70)) for _ in range(30)]
    digests += ["".join(c if r.random() < 0.9 else r.choice(HEX) for c in digests[0]) for _ in range(20)] + ["0" * 70, "F" * 70]
    d = spark.createDataFrame([(x,) for x in digests], "d string").select("d", *pack(F.col("d")))
    a, b = (d.select(*(F.col(c).alias(f"{s}_{c}") for c in d.columns)) for s in "ab")
    j = a.crossJoin(b).select("a_d", "b_d", distance({p: F.col(f"a_{p}") for p in PARTS}, {p: F.col(f"b_{p}") for p in PARTS}).alias("x"))
    assert all(x["x"] == _steps(x["a_d"], x["b_d"]) for x in j.collect())


def test_usable_digests(spark):
    d = "AB" * 35
    rows = [(f"T1{d}", "VALID", d), (d.lower(), " valid ", d), (f" t1{d}\n", "Valid", d), (d, "TNULL", None), (d[:-1], "VALID", None), (d + "\n0", "VALID", None), (None, "VALID", None), (d, None, None), ("T2" + d, "VALID", None)]
    t = spark.createDataFrame(rows, "tlsh string, tlsh_status string, want string")
    assert all(r[0] == r[1] for r in t.select(usable("tlsh", "tlsh_status"), "want").collect())


def test_periods_stages_buckets(spark):
    t = spark.createDataFrame([("2019-07-31 23:59:59", 1.0), ("2019-08-01 00:00:00", 2.0), ("2020-01-31 23:59:59", 2.5), ("2020-02-01 00:00:00", 4.0)], "t string, s double").select(F.col("t").cast("timestamp").alias("t"), "s")
    p = cohort.period(F.col("t"), [("train", "2019-08-01", "2020-02-01"), ("validation", "2020-02-01", "2020-04-01")])
    assert [r[0] for r in t.select(p).collect()] == [None, "train", "train", "validation"]
    assert [r[0] for r in t.select(cohort.size_bucket(F.col("s"), [1, 2, 3])).collect()] == [0, 1, 2, 3]
    m = cohort.stage(cohort.utc_month(F.col("t")), "2019-08", "2020-01", {"A": "2020-01", "B": "2020-02"})
    assert [r[0] for r in t.select(m).collect()] == [None, "train", "A", "B"]


def test_confidence_and_simplex(spark):
    t = spark.createDataFrame([(0.0, [1.0, 0.0, 0.0]), (1.0, [0.5, 0.5, 1e-9]), (0.2, [0.2, 0.3]), (0.9999, [1.5, -0.5, 0.0]), (0.5, None)], "c double, w array<double>")
    got = t.select(cohort.confidence_bin(F.col("c")), cohort.simplex(F.col("w"))).collect()
    assert [r[0] for r in got] == [0, 14, 3, 14, 7] and [r[1] for r in got] == [True, False, False, False, False]


def test_equal_side_capacity(spark):
    sizes = {"a": [3, 3, 3], "b": [10, 1, 1], "c": [2, 3, 5], "d": [7]}
    t = spark.createDataFrame([(k, s) for k, v in sizes.items() for s in v], "k string, s long")
    assert {r["k"]: r["capacity"] for r in cohort.equal_side_capacity(t, ["k"], "s").collect()} == {"a": 3, "b": 2, "c": 5, "d": 0}


def inventory(spark, rows):
    """rows of (sha, day, content, digest)."""
    t = spark.createDataFrame([(s, f"2020-02-{d:02d} 00:00:00", "f", c, x) for s, d, c, x in rows], "sha string, t string, cls string, content string, digest string")
    return t.select("sha", F.col("t").cast("timestamp").alias("ts"), "cls", "content", "digest", *pack(F.col("digest")))


def steps(d, n):
    """A digest n away: n values of the body moved by one."""
    out = list(d)
    for i in range(n):
        v = int(out[6 + i], 16)
        out[6 + i] = HEX[v ^ 1]
    return "".join(out)


BASE = "00" * 35


def decide(spark, scratch, rows, **more):
    t = inventory(spark, rows)
    e = scratch.cut(retention.pair_edges(t, scratch), "edges")
    return {(r["sha"], r["threshold"]): r for r in retention.decisions(t, t.where("false"), e, [0, 10, 20], **more).collect()}, t, e


def test_excluded_rows_stay_references(spark, scratch):
    got, _, _ = decide(spark, scratch, [("a", 1, "1", BASE), ("b", 2, "2", steps(BASE, 15)), ("c", 3, "3", steps(BASE, 30))])
    assert got["b", 20]["decision"] == "EXCLUDE" and got["b", 10]["decision"] == "KEEP"
    assert got["c", 20]["decision"] == "EXCLUDE" and got["c", 20]["reference_sha"] == "b" and got["c", 20]["tlsh_distance"] == 15


def test_later_bridge_changes_nothing_and_ties_go_by_sha(spark, scratch):
    got, _, _ = decide(spark, scratch, [("b", 2, "2", steps(BASE, 18)), ("a", 1, "1", BASE), ("c", 2, "3", steps(BASE, 9))])
    assert got["b", 10]["decision"] == "KEEP" and got["c", 10]["reference_sha"] == "a" and got["c", 20]["reference_sha"] == "a"
    tie, _, _ = decide(spark, scratch, [("z", 1, "1", BASE), ("y", 1, "2", BASE)])
    assert tie["y", 0]["decision"] == "KEEP" and tie["z", 0]["reference_sha"] == "y"


def test_exact_copies_come_first_or_in_order(spark, scratch):
    rows = [("a", 1, "1", steps(BASE, 5)), ("b", 2, "2", None), ("c", 3, "2", BASE)]
    got, t, e = decide(spark, scratch, rows)
    assert got["c", 20]["reason"] == "exact_sha256" and got["c", 20]["reference_sha"] == "b" and got["c", 20]["tlsh_distance"] is None
    order, _, _ = decide(spark, scratch, rows, exact_first=False)
    assert order["c", 20]["reason"] == "tlsh" and order["c", 20]["reference_sha"] == "a" and order["c", 0]["reference_sha"] == "b"
    train, _, _ = decide(spark, scratch, [("a", 1, "1", BASE), ("b", 2, "2", BASE), ("c", 3, "1", None)], train_stage=F.lit(True))
    assert train["b", 20]["decision"] == "KEEP" and train["c", 20]["decision"] == "EXCLUDE"


def test_groups_are_transitive_and_outsiders_do_not_bridge(spark, scratch):
    t = inventory(spark, [("a", 1, "1", BASE), ("b", 2, "2", steps(BASE, 15)), ("c", 3, "3", steps(BASE, 30)), ("d", 4, "4", None)])
    e = scratch.cut(retention.pair_edges(t, scratch), "edges")
    groups = lambda rows: {r["sha"]: r["group_id"] for r in retention.group_members(rows, e, scratch, 20).collect()}
    assert groups(t) == {"a": "a", "b": "a", "c": "a", "d": "d"}
    assert groups(t.where("sha <> 'b'")) == {"a": "a", "c": "c", "d": "d"}


def test_blocks_equal_exhaustive(spark, scratch):
    r = random.Random(4)
    base = ["".join(r.choice(HEX) for _ in range(70)) for _ in range(25)]
    digests = sorted({"".join(c if r.random() < 0.93 else HEX[int(c, 16) ^ r.choice([1, 4])] for c in b) for b in base for _ in range(5)})
    t = spark.createDataFrame([(x,) for x in digests], "digest string").select("digest", *pack(F.col("digest")))
    got = {tuple(x) for x in retention.near_edges(t, scratch).collect()}
    want = {(a, b, _steps(a, b)) for a in digests for b in digests if a < b and _steps(a, b) <= 20}
    assert got == want and want


def test_folds_and_sides(spark):
    r = random.Random(5)
    rows = [(f"g{min(int(r.paretovariate(1)), 60)}", f"c{r.randrange(4)}", r.choice(["m1", "m2"])) for _ in range(800)]
    t = spark.createDataFrame(rows, "g string, c string, m string")
    folds = {x["g"]: x["fold"] for x in retention.assign_folds(t, "g", "c").collect()}
    assert set(folds) == {x[0] for x in rows} and set(folds.values()) == set(range(5))
    assert folds == {x["g"]: x["fold"] for x in retention.assign_folds(t, "g", "c").collect()}
    sides = retention.two_sides(t, "m", "g", "c").collect()
    assert {(x["m"], x["g"]) for x in sides} == {(x[2], x[0]) for x in rows} and {x["side"] for x in sides} == {0, 1}


def test_skewed_keys(spark):
    rows = [(f"s{i}", "2020-01-01T00:00:00Z", " HOT", "g") for i in range(80)] + [("s1", "2019-01-01T00:00:00Z", "hot", None), (None, None, "rare", "g"), ("x", "?", None, None)]
    t = spark.createDataFrame(rows, "sha string, timestamp string, family string, group_id string").withColumn("n", F.lit(1)).withColumn("k_0", F.lit("clash"))
    got = {(r["field"], r["key_value"]): r for r in skew.key_states(t, ["family", "group_id"]).collect()}
    hot = got["family", "hot"]
    assert (hot["row_count"], hot["record_count"], hot["first_seen"].year) == (81, 80, 2019)
    assert (got["family", "rare"]["row_count"], got["family", "rare"]["record_count"]) == (1, 0) and got["family", None]["row_count"] == 1
    assert {(r["field"], r["key_value"]) for r in skew.hot_keys(t, ["family", "group_id"]).collect()} == {("family", "hot"), ("group_id", "g")}
    # Exactly a twentieth, by rows of which most are null, is hot; one row less is not.
    tie = spark.createDataFrame([("k",)] * 3 + [("few",)] * 2 + [(None,)] * 55, "family string")
    hot = skew.hot_keys(tie, ["family"]).collect()
    assert [(r["key_value"], int(r["pairs"]), r["share"]) for r in hot] == [("k", 180, 0.05)]
    assert skew.key_states(t.where("false"), ["family"]).count() == 0 and skew.hot_keys(t.where("false"), ["family"]).count() == 0


def test_eager_join_equals_the_join(spark):
    r = random.Random(6)
    a = spark.createDataFrame([(r.choice(["h"] * 5 + ["x", "y", None]), r.randrange(3), r.randrange(9)) for _ in range(300)], "k string, p int, v int")
    b = spark.createDataFrame([(r.choice(["h", "h", "x", "z", None]), r.randrange(2), r.randrange(9)) for _ in range(60)], "k string, q int, w int")
    got = skew.eager_join(a, b, ["k"], ["p"], ["q"], {"vs": F.col("v")}, {"ws": F.col("w")})
    want = a.join(b, "k").groupBy("p", "q").agg(F.count("*").alias("joined_rows"), F.sum("v").alias("vs"), F.sum("w").alias("ws"))
    rows = lambda d: {(x["p"], x["q"], x["joined_rows"], x["vs"], x["ws"]) for x in d.collect()}
    assert rows(got) == rows(want)


def test_assertions_fail_closed(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z")], "k int, v string")
    assert assertions.exact_join(a, a, "k", ["v"]).count() == 2
    for bad in (lambda: assertions.exact_join(a, b, "k", ["v"]), lambda: assertions.exact_join(a, a.limit(1), "k"), lambda: assertions.unique(a.union(a), "k"), lambda: assertions.disjoint(a, b, "k"), lambda: assertions.nested(a, a.limit(1), "k"), lambda: assertions.rule(a, F.col("k") > 1, "small"), lambda: assertions.isolated(a.union(a.withColumn("v", F.lit("w"))), "v", "k")):
        with pytest.raises(assertions.DataError):
            bad()
    views = [a.withColumnRenamed("v", "label").withColumn(f"z{i}", F.lit(i)) for i in range(3)]
    assert assertions.aligned(views, ["k"], "label").columns == ["k", "label", "z0", "z1", "z2"]
    with pytest.raises(assertions.DataError):
        assertions.aligned([views[0], views[1].limit(1)], ["k"], "label")
    row = ("a" * 64, "train", "2019-09-01T00:00:00Z", "f", "b" * 64, "T1" + "0" * 70, "VALID")
    names = "sha string, split string, timestamp string, family string, disarmed_content_sha256 string, tlsh string, tlsh_status string"
    assert assertions.inventory(spark.createDataFrame([row], names), "train", "2019-08-01", "2020-02-01").count() == 1
    for i, v in ((0, "A" * 64), (1, "test"), (2, "2019-09-01 00:00:00"), (3, " "), (4, None), (5, "TNULL")):
        with pytest.raises(assertions.DataError):
            assertions.inventory(spark.createDataFrame([(*row[:i], v, *row[i + 1 :])], names), "train", "2019-08-01", "2020-02-01")


def test_global_rank(spark, scratch):
    from tidemark.operators.ranking import global_rank

    r = random.Random(9)
    values = [(r.randrange(300), i) for i in range(1000)]
    t = spark.createDataFrame(values, "v int, i int")
    got = {(x["v"], x["i"]): x["rank_index"] for x in global_rank(t.repartition(5), ["v", "i"], scratch).collect()}
    assert got == {x: k for k, x in enumerate(sorted(values))}
    assert global_rank(t.where("false"), ["v", "i"], scratch).count() == 0
