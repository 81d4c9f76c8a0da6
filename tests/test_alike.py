"""Groups, decisions, links, folds and searches where many rows are alike, at sizes that once failed."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import nearby
from tidemark.operators import retention

HEX = "0123456789ABCDEF"


def packed(n: int, seed: int, bodies: int):
    """head and planes of n digests about a few bodies, as in functions.digest.pack."""
    r = np.random.default_rng(seed)
    base = r.integers(0, 4, (bodies, 128))
    v = base[r.integers(0, bodies, n)]
    v = np.where(r.random(v.shape) < 0.06, v ^ 1, v)
    head = (r.integers(0, 2, n) << 16 | r.integers(0, 3, n) << 8 | r.integers(0, 3, n) << 4).astype(np.int32)
    pack = lambda bits: [np.packbits(bits[:, a : a + 64], axis=1).view(">u8").ravel().astype(np.uint64) for a in (0, 64)]
    return head, pack(v >> 1) + pack(v & 1)


def all_pairs(head, planes, within):
    i, j = np.triu_indices(len(head), 1)
    d = nearby.head_distance(head[i], head[j]) + nearby.plane_distance([p[i] for p in planes], [p[j] for p in planes])
    return {(int(a), int(b)): int(x) for a, b, x in zip(i, j, d) if x <= within}


def inventory(spark, n: int = 160):
    """Rows about a few digests and contents, some without either."""
    r = random.Random(3)
    base = ["".join(r.choice(HEX) for _ in range(70)) for _ in range(4)]
    digest = lambda: "".join(c if r.random() < 0.95 else HEX[int(c, 16) ^ r.choice([1, 4])] for c in r.choice(base))
    some = [digest() for _ in range(n // 2)]
    rows = [(f"{i:03d}", f"20{r.randrange(19, 21)}-0{r.randrange(1, 9)}-01", "f", r.choice([None, *(f"c{x}" for x in range(60))]), "T1" + d, r.choice(["VALID"] * 9 + ["TNULL"])) for i, d in enumerate(r.choice(some) for _ in range(n))]
    return retention.inventory(spark.createDataFrame(rows, "sha string, timestamp string, family string, disarmed_content_sha256 string, tlsh string, tlsh_status string"))


def test_sets_of_near_digests_are_those_of_all_pairs():
    head, planes = packed(400, 1, 12)
    for within in (20, 10):
        pairs = np.array(list(all_pairs(head, planes, within)))
        want = nearby._joined(np.arange(400), pairs[:, 0], pairs[:, 1])
        assert (nearby.near_sets(head, planes, within) == want).all() and len(set(want)) < 400


def test_scopes_in_one_round_are_class_groups_of_each(spark, scratch):
    t = scratch.cut(inventory(spark), "rows")
    near = scratch.cut(retention.near_edges(t, scratch), "near")
    early = F.col("ts") < F.lit("2020-01-01").cast("timestamp")
    scopes = [("early", early, 10), ("all", F.lit(True), 0), ("all", F.lit(True), 20)]
    got = {tuple(r) for r in retention.scoped_groups(t, scratch, scopes).select("scope", "sha", "group_id").collect()}
    want = {(n, *r) for n, (_, which, k) in enumerate(scopes) for r in retention.class_groups(t.where(which), near, scratch, k).select("sha", "group_id").collect()}
    assert got == want


def test_links_are_counted_as_partition_check_does(spark, scratch):
    t = scratch.cut(inventory(spark), "rows")
    edges = scratch.cut(retention.pair_edges(t, scratch), "edges")
    g = scratch.cut(retention.grouped_rows(t, scratch, [("all", F.lit(True), k) for k in (0, 10, 20)]), "grouped")
    torn = g.withColumn("g2", F.when(retention.unshort(F.col("sha")) < "080", F.col("g2")).otherwise(F.col("sha")))
    for rows in (g, torn):
        got = [tuple(r) for r in retention.grouped_check(rows, [0, 10, 20], scratch).orderBy("threshold").collect()]
        want = [tuple(retention.partition_check(rows.select(retention.unshort(F.col("sha")).alias("sha"), F.col(f"g{x}").alias("group_id")), edges, k).first()) for x, k in enumerate((0, 10, 20))]
        assert got == want
    assert got[2][5] > 0


def test_the_first_near_digest_is_that_of_all_pairs():
    head, planes = packed(400, 2, 12)
    rank = np.random.default_rng(4).permutation(400)
    for within in (20, 10):
        want = rank.copy()
        for i, j in all_pairs(head, planes, within):
            want[i], want[j] = min(want[i], rank[j]), min(want[j], rank[i])
        assert (rank[nearby.near_first(head, planes, rank, within)] == want).all()


def test_decisions_from_first_digests_are_those_from_all(spark, scratch):
    t = scratch.cut(inventory(spark), "rows")
    firsts, near = (scratch.cut(x, "near") for x in (retention.near_firsts(t, [0, 10, 20]), retention.near_edges(t, scratch)))
    rows = lambda x: {tuple(r) for r in retention.class_decisions(t, x, [0, 10, 20]).collect()}
    assert rows(firsts) == rows(near) and firsts.count() < near.count()


def test_pairs_without_a_time_go_by_sha(spark, scratch):
    r = random.Random(8)
    a = "".join(r.choice(HEX) for _ in range(70))
    b, c = a[:-1] + HEX[int(a[-1], 16) ^ 1], a[:-2] + HEX[int(a[-2], 16) ^ 1] + a[-1]
    rows = [("a" * 64, None, "f", "x", max(b, a), "VALID"), ("b" * 64, "2020-01-01", "f", "y", min(b, a), "VALID"), ("c", "2019-01-01", "f", "y", c, "VALID"), ("d", "2019-01-01", "f", "y", None, None)]
    t = retention.inventory(spark.createDataFrame(rows, "sha string, timestamp string, family string, disarmed_content_sha256 string, tlsh string, tlsh_status string"))
    got = {tuple(x) for x in retention.pair_edges(t, scratch).collect()}
    # A row without a time is earlier by its sha, whichever digest is less.
    assert {x[:2] for x in got} == {("a" * 64, "b" * 64), ("a" * 64, "c"), ("c", "b" * 64), ("c", "d"), ("d", "b" * 64)}
    assert {x[2:] for x in got if x[1] == "d"} == {(None, True)} and all(x[2] <= 2 for x in got if x[1] != "d" and x[0] != "d")


def test_pairs_in_a_task_come_once():
    head, planes = packed(400, 3, 12)
    own = np.random.default_rng(5).random(400) < 0.7
    got = [(min(i, j), max(i, j), d) for block in nearby.near_pairs(head, planes, own, 20) for i, j, d in zip(*(x.tolist() for x in block))]
    assert len(got) == len(set(got)) and set(got) == {(i, j, d) for (i, j), d in all_pairs(head, planes, 20).items() if own[i] or own[j]}


def test_nearest_rows_are_those_of_all():
    head, planes = packed(300, 6, 20)
    head = head + (np.arange(300) % 7 * 8 << 8).astype(np.int32)
    q, rest = slice(0, 40), slice(20, 300)  # twenty queries are among the rows
    i, d, near = nearby.nearest(head[q], [p[q] for p in planes], head[rest], [p[rest] for p in planes], {x: x - 20 for x in range(20, 40)})
    assert i == list(range(40))
    for x, least, rows in zip(i, d, near):
        others = np.array([y for y in range(20, 300) if y != x])
        want = nearby.head_distance(head[others], head[x]) + nearby.plane_distance([p[others] for p in planes], [p[x] for p in planes])
        assert least == want.min() and set(rows + 20) == set(others[want == least])


def test_nearest_on_the_ring_of_length_values(monkeypatch):
    """Lengths from all of the ring, few rows each; a bound leaves the same answers, and most values uncompared."""
    r = np.random.default_rng(9)
    for n, bodies in ((3, 3), (40, 40), (3000, 300)):
        head, planes = packed(n + 60, n, bodies)
        head = (r.integers(0, 256, n + 60) << 16 | r.integers(0, 256, n + 60) << 8 | r.integers(0, 256, n + 60)).astype(np.int32)
        copies = slice(60, 60 + min(n, 30))  # these have a row near them, at any distance of the heads up to 26
        at = np.arange(n + 60)[copies] - 60
        head[at] = head[copies] ^ (r.integers(0, 2, len(at)) << 16) ^ (r.integers(0, 2, len(at)) << 8)
        for p in planes:
            p[at] = p[copies] ^ r.integers(0, 2, len(at)).astype(np.uint64)
        q, rest = slice(0, 60), slice(60, n + 60)
        want = {}
        for x in range(60):
            d = nearby.head_distance(head[rest], head[x]) + nearby.plane_distance([p[rest] for p in planes], [p[x] for p in planes])
            want[x] = int(d.min()), set(np.flatnonzero(d == d.min()))
        assert {d for d, _ in want.values() if d > 50} and {d for d, _ in want.values() if d <= 50}
        search = lambda within: {x: (d, set(rows)) for x, d, rows in zip(*nearby.nearest(head[q], [p[q] for p in planes], head[rest], [p[rest] for p in planes], {}, within))}
        assert search(None) == want
        compared, count = [], np.bitwise_count
        monkeypatch.setattr(np, "bitwise_count", lambda x: compared.append(np.size(x)) or count(x))
        for within in (0, 1, 10, 24, 50, 200):
            compared.clear()
            assert search(within) == {x: y for x, y in want.items() if y[0] <= within}
            assert within > 50 or n < 3000 or sum(compared) < 60 * n * 6 / 20  # six counts a pair
        monkeypatch.undo()


def test_digests_are_packed_alike(spark):
    import pyarrow as pa

    from tidemark.functions.digest import PARTS, pack

    r = random.Random(12)
    d = ["".join(r.choice(HEX) for _ in range(70)) for _ in range(200)] + ["0" * 70, "F" * 70, "8" * 70]
    t = spark.createDataFrame([(x,) for x in d], "digest string").select("digest", *pack(F.col("digest"))).toArrow()
    head, planes = nearby.pack(t["digest"])
    assert head.tolist() == t["head"].to_pylist() and [p.view(np.int64).tolist() for p in planes] == [t[p].to_pylist() for p in PARTS[1:]]
    assert len(nearby.pack(pa.array([], pa.string()))[0]) == 0


def test_cutoffs_need_no_search_beyond_the_last(spark, scratch):
    r = random.Random(13)
    base = "".join(r.choice(HEX) for _ in range(70))
    far = ["".join(r.choice(HEX) for _ in range(70)) for _ in range(20)]
    near = [base[:10] + "".join(r.choice(HEX) if r.random() < k / 40 else x for x in base[10:]) for k in range(40)]
    t = spark.createDataFrame([(f"{i:03d}", "f", x) for i, x in enumerate(far + near)], "sha string, cls string, digest string")
    q, none = t.where("sha % 2 = 0"), t.where("sha < '000'")
    whole = {tuple(x) for x in retention.nearest_neighbours(q, t, scratch).collect()}
    found = {tuple(x) for x in retention.nearest_neighbours(q, t, scratch, 50).collect()}
    assert found == {x for x in whole if x[1] <= 50} and 5 < len(found) < len(whole) == 30
    counts = retention.cumulative_cutoffs(retention.nearest_neighbours(q, t, scratch, 50), [0, 10, 20, 30, 50]).collect()
    assert [tuple(x) for x in counts] == [(c, sum(x[1] <= c for x in whole)) for c in (0, 10, 20, 30, 50)]
    assert retention.nearest_neighbours(none, t, scratch, 50).collect() == retention.nearest_neighbours(q, none, scratch, 50).collect() == []


def test_least_distances_are_those_of_all(monkeypatch):
    """Heads from all of the ring and from few values, copies at small distances; with small groups and tiles too."""
    r = np.random.default_rng(21)
    for n, values in ((1, 2), (300, 3), (2000, 256)):
        head, planes = packed(n + 200, n, max(1, n // 3))
        head = (r.integers(0, 256, n + 200) << 16 | r.integers(0, values, n + 200) - 1 << 8 & 0xFF00 | r.integers(0, 256, n + 200)).astype(np.int32)
        at, of = np.arange(min(n, 100)), 200 + np.arange(min(n, 100))
        head[at] = head[of] ^ (r.integers(0, 2, len(at)) << 8)
        for p in planes:
            p[at] = p[of] ^ r.integers(0, 4, len(at)).astype(np.uint64)
        q, rest = slice(0, 200), slice(200, n + 200)
        skip = np.where(r.random(200) < 0.3, np.arange(200) % n, -1)
        all_d = np.array([nearby.head_distance(head[rest], head[x]) + nearby.plane_distance([p[rest] for p in planes], [p[x] for p in planes]) for x in range(200)])
        all_d[np.flatnonzero(skip >= 0), skip[skip >= 0]] = nearby.FAR
        assert n == 1 or len({d for d in all_d.min(axis=1) if d <= 50}) > 3
        for tile, together in ((nearby.TILE, nearby.TOGETHER), (64, 8), (7, 1)):
            monkeypatch.setattr(nearby, "TILE", tile)
            monkeypatch.setattr(nearby, "TOGETHER", together)
            for within in (0, 10, 50, 300):
                got = nearby.least(head[q], [p[q] for p in planes], head[rest], [p[rest] for p in planes], skip, within)
                assert got.tolist() == np.minimum(all_d.min(axis=1), within + 1).tolist()
        monkeypatch.undo()


def test_bytes_are_packed_like_digits():
    import pyarrow as pa

    r = random.Random(14)
    d = ["".join(r.choice(HEX) for _ in range(70)) for _ in range(50)]
    a, b = nearby.pack(pa.array(d)), nearby.pack_bytes(pa.array([bytes.fromhex(x) for x in d]))
    assert a[0].tolist() == b[0].tolist() and [p.tolist() for p in a[1]] == [p.tolist() for p in b[1]]


def test_least_distances_in_many_tasks(spark, scratch, monkeypatch):
    """Samples that are queries and rows at once; a digest of another sample too is an answer, one's own is none."""
    r = random.Random(15)
    base = ["".join(r.choice(HEX) for _ in range(70)) for _ in range(3)]
    some = [b[:10] + "".join(r.choice(HEX) if r.random() < k / 60 else x for x in b[10:]) for b in base for k in range(20)]
    far = ["".join(r.choice(HEX) for _ in range(70)) for _ in range(20)]
    t = spark.createDataFrame([(f"{i:03d}", "f", x) for i, x in enumerate(some + far + some[:5] + [None])], "sha string, cls string, digest string")
    other = t.where("sha % 3 = 0 OR sha >= '05'").withColumn("sha", F.concat(F.lit("v"), "sha"))
    for q in (t, other, t.where("sha % 2 = 0").unionByName(other)):
        want = sorted(x["distance"] for x in retention.nearest_neighbours(q, t, scratch, 50).collect())
        for held, shares in ((1 << 17, 64), (2, 1 << 20)):
            monkeypatch.setattr(retention, "HELD", held)
            monkeypatch.setattr(retention, "SHARES", shares)
            got = retention.least_distances(q, t, scratch, 50)
            assert sorted(x["distance"] for x in got.collect() for _ in range(x["n"])) == want and len(want) > 30
            assert [tuple(x) for x in retention.cumulative_cutoffs(got, [0, 10, 50], "n").collect()] == [(c, sum(d <= c for d in want)) for c in (0, 10, 50)]
    none = t.where("sha < '000'")
    assert retention.least_distances(none, t, scratch, 50).collect() == retention.least_distances(t, none, scratch, 50).collect() == []


def test_cutoffs_count_every_query(spark, tmp_path):
    """No query's id is divisible by 100: a count over those that are would be 0."""
    import duckdb

    import __spark_entry__

    r = random.Random(16)
    digest = lambda: "".join(r.choice(HEX) for _ in range(70))
    train = [digest() for _ in range(30)]
    queries = [x if n % 3 == 0 else x[:-2] + "00" if n % 3 == 1 else digest() for n, x in enumerate(train)]
    for name, digests, kind in (("train_tlsh", train, "a"), ("validation_tlsh", queries, "b")):
        rows = [(f"{kind * 56}{100 * n + 1 + n % 99:08x}", "2020-01-01T00:00:00Z", "f", 5, "c", "T1" + x, "VALID") for n, x in enumerate(digests)]
        spark.createDataFrame(rows, "sha string, timestamp string, family string, file_size long, disarmed_content_sha256 string, tlsh string, tlsh_status string").write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted(tuple(x) for x in __spark_entry__.queries()["A36_nearest_cutoffs"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    for name in ("train_tlsh", "validation_tlsh"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(con.execute(__spark_entry__.oracle_sql()["A36_nearest_cutoffs"]).fetchall())
    assert got[0] == (0, 10) and got[-1] == (50, 20)


def test_folds_need_no_matrix(spark):
    """40,000 groups and 5,000 classes: as a matrix 1.6 GB, and some copies of it."""
    t = spark.range(80_000).select(F.concat(F.lit("g"), F.col("id") % 40_000).alias("g"), F.concat(F.lit("c"), (F.col("id") * 7919) % 5_000).alias("c"))
    out = retention.assign_folds(t, "g", "c")
    per = {r["fold"]: r["count"] for r in out.groupBy("fold").count().collect()}
    assert sum(per.values()) == 40_000 and max(per.values()) - min(per.values()) < 400
