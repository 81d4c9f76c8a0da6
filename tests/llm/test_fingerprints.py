"""Problems 1, 4 and 5 against plain pairwise distances."""

import random

import numpy as np
import pytest
from helpers import INVENTORY, distance, edited, pairs, random_digest, row
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import history, neardup, overlap, winnow

MANIFEST = "sha string, split string, timestamp string, family string, source string, seeds int"


def family(n, r, most):
    """Records in clusters of near digests, some equal, all lower-case or marked."""
    out = []
    for k in range(n):
        base = random_digest(r)
        for j in range(4):
            d = edited(base, r.randrange(0, most), r)
            out.append((f"{k:03d}{j}", r.choice(["T1" + d, d.lower(), f" {d} "])))
    return out


def bare(d):
    return d.strip().upper()[-70:]


def test_cross_split(spark, scratch):
    r = random.Random(1)
    recs = family(60, r, 16)
    split = {s: r.choice(["train", " Train", "validation", "TEST", None]) for s, _ in recs}
    rows = [row(s.upper() if i % 3 == 0 else s, d, content=f"C{int(s[:3]) % 50 if i % 5 == 0 else s}") for i, (s, d) in enumerate(recs)]
    rows += rows[:7] + [row("n1", "junk", None), row(None, recs[0][1], "C1"), row("n2", None, None, status="TNULL")]
    man = [(s, v, None, None, "src", 1) for s, v in split.items()] * 2 + [("n1", "test", None, None, None, 1), ("n2", "train", None, None, None, 1)]
    got = pairs(overlap.found([spark.createDataFrame(rows, INVENTORY)], spark.createDataFrame(man, MANIFEST), scratch))
    side = {s: (v or "").strip().lower() for s, v in split.items()}
    content = {(x[0] or "").lower(): x[5].lower() for x in rows if x[0] and x[5]}
    digest = dict(recs)
    want = set()
    for a in side:
        for b in side:
            if side[a] == "train" and side[b] in ("validation", "test") and (content[a] == content[b] or distance(bare(digest[a]), bare(digest[b])) <= 20):
                want.add((min(a, b), max(a, b)))
    assert got == want and want


def test_cross_split_empty_and_report(spark, scratch):
    empty = spark.createDataFrame([], INVENTORY)
    man = spark.createDataFrame([("a", "train", None, None, "s", 1), ("b", "test", None, None, None, 1)], MANIFEST)
    assert overlap.found([empty], man, scratch).count() == 0
    r = random.Random(2)
    d = random_digest(r)
    rows = spark.createDataFrame([row("a", d, "c"), row("b", edited(d, 3, r), "c"), row("b", edited(d, 3, r), "c")], INVENTORY)
    rep = [x.asDict() for x in overlap.report([rows], man, scratch).collect()]
    assert len(rep) == 1 and rep[0]["records"] == 1 and rep[0]["source"] is None and rep[0]["exact_pairs"] == 1
    with pytest.raises(ValueError):
        overlap.cross_split_pairs([rows], man, scratch, within=21)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**9), st.integers(0, 20))
def test_windows_miss_nothing(seed, steps):
    """Two digests within 20 share an asked and a kept window, by the rule stated in winnow, whatever was edited."""
    r = random.Random(seed)
    a = random_digest(r)
    b = edited(a, steps, r)
    values = lambda d: [int(x, 16) >> s & 3 for x in d[6:] for s in (2, 0)]
    x, y = values(a), values(b)
    at, near = 0, []
    for n in winnow.SIZES:
        near.append(sum(6 if abs(p - q) == 3 else abs(p - q) for p, q in zip(x[at : at + n], y[at : at + n])))
        at += n
    assert at == 128 and distance(a, b) <= 20 and (min(near[:-1]) <= 1 or near[-1] == 0)


def batches(spark, rows):
    kinds = INVENTORY + ", batch_no int, ingested_at timestamp"
    return spark.createDataFrame(rows, kinds)


def test_history(spark, scratch):
    r = random.Random(3)
    train = family(15, r, 8)
    old = spark.createDataFrame([row(s, d, f"c{i}") for i, (s, d) in enumerate(train)], INVENTORY)
    rows, first = [], {}
    for i, (s, d) in enumerate(family(25, r, 8) + [(f"9{i:03d}", "T1" + edited(bare(d), r.randrange(0, 14), r)) for i, (s, d) in enumerate(train[:20])]):
        s, b, t = f"v{s}", r.choice([1, 2, 3]), f"2020-03-{r.randrange(1, 28):02d}T00:00:00Z"
        c = r.choice([f"c{r.randrange(400)}", None, f"k{r.randrange(30)}"])
        rows.append((*row(s, d, c, "test", t), b, None))
        first[s] = (b, t, s, c, bare(d))
        if i % 6 == 0:
            rows.append((*row(s.upper(), d, c, "test", t), b + 1, None))
    rows += [(*row(None, train[0][1], "c1"), 1, None), (*row("vz", "junk", None, ts="never"), None, None)]
    got = {x[0] for x in history.run_batches(old, batches(spark, rows), scratch).select("sha").collect()}
    want, seen = set(), []
    for b, t, s, c, d in sorted(first.values(), key=lambda x: x[:3]):
        past = [(f"c{i}", bare(x)) for i, (_, x) in enumerate(train)] + seen
        if any((c is not None and c == pc) or distance(d, pd) <= 10 for pc, pd in past):
            want.add(s)
        seen.append((c, d))
    assert got == want and want


def test_history_empty(spark, scratch):
    none = spark.createDataFrame([], INVENTORY)
    r = random.Random(4)
    d = random_digest(r)
    assert history.run_batches(none, batches(spark, []), scratch).count() == 0
    twice = [(*row("a", d, "c", ts="2020-01-01T00:00:00Z"), 1, None), (*row("b", d, None, ts="2020-01-01T00:00:00Z"), 1, None), (*row("a", d, "c"), 2, None)]
    assert {x["sha"] for x in history.run_batches(none, batches(spark, twice), scratch).collect()} == {"b"}


def stores(spark, scratch, name, per_bucket):
    return lambda: history.HistoryStore(spark, f"{scratch.path}/{name}", per_bucket)


def shas(df):
    return {x["sha"] for x in df.collect()}


def test_history_lasts(spark, scratch):
    """A store opened again, and merged on the way, gives what one call over all batches gives."""
    r = random.Random(14)
    train = family(12, r, 8)
    old = spark.createDataFrame([row(s, d, f"c{i}") for i, (s, d) in enumerate(train)], INVENTORY)
    new = [(f"v{s}", d, f"c{r.randrange(90)}", b) for b in (1, 2, 3) for s, d in [(f"{b}{k}", edited(bare(r.choice(train)[1]), r.randrange(0, 14), r)) for k in range(30)]]
    rows = [(*row(s, d, c, "test", f"2020-0{b}-01T00:00:00Z"), b, None) for s, d, c, b in new]
    again = [(*row(s.upper(), train[0][1], "c0", "test", "2020-09-01T00:00:00Z"), 4, None) for s, _, _, _ in new[:5]]
    at = stores(spark, scratch, "lasting", 64)
    got = shas(history.run_batches(old, batches(spark, rows[:30]), scratch, store=at()))
    for part in (rows[30:60], rows[60:], again):
        store = at()
        assert store.about["entries"] and store.about["batches"]
        got |= shas(history.run_batches(None, batches(spark, part), scratch, store=store))
    want = shas(history.run_batches(old, batches(spark, rows + again), scratch))
    assert got == want and want and not {f"v{x}" for x in ("none",)} & got
    assert shas(history.run_batches(None, batches(spark, again), scratch, store=at())) == set()
    # Entries have more than doubled since the first update, so generations were merged into more buckets.
    end = at()
    assert len(end.about["generations"]) < 5 and end.about["buckets"] >= 32
    assert end.entries(history.RECORD).count() == len(train) + len(new)


def test_history_reads_what_the_batch_needs(spark, scratch):
    """The buckets read for a batch of three do not grow with the history; an update that was cut short does not count."""
    r = random.Random(15)
    recs = [(f"{i:04d}", random_digest(r)) for i in range(1200)]
    read = []
    for n in (150, 1200):
        store = stores(spark, scratch, f"reads{n}", 64)()
        history.ingest(store, spark.createDataFrame([row(s, d, f"c{s}") for s, d in recs[:n]], INVENTORY), scratch)
        rows = [(*row(f"v{k}", edited(recs[k][1], 3, r) if k else random_digest(r), None, "test", "2020-01-01T00:00:00Z"), 1, None) for k in range(3)]
        assert shas(history.run_batches(None, batches(spark, rows), scratch, store=store)) == {"v1", "v2"}
        read.append({k: len(v) for k, v in store.read.items()})
    small, large = store.about["buckets"], read[1]
    assert small >= 256 and large[history.WORD] <= 36 and large[history.FINGERPRINT] <= 36 and large[history.DIGEST] <= 8 and large[history.FINGERPRINT] <= read[0][history.FINGERPRINT] + 12
    torn = stores(spark, scratch, "reads1200", 64)()
    torn._fs.mkdirs(torn._jvm_path(f"{torn.path}/gen=99999-torn/kind=0/bucket=0"))
    assert len(stores(spark, scratch, "reads1200", 64)().about["generations"]) == 2


def test_digests_with_one_hash_stay_apart(spark, scratch, monkeypatch):
    """With ids that nearly all clash the results are the same: ids only find candidates."""
    from pyspark.sql import functions as F

    from tidemark.llm import records

    r = random.Random(16)
    recs = family(12, r, 9)
    rows = [row(s, d, f"c{s}", "train" if i % 2 else "test") for i, (s, d) in enumerate(recs)]
    t, man = spark.createDataFrame(rows, INVENTORY), spark.createDataFrame([(x[0], x[1], None, None, "f", 1) for x in rows], MANIFEST)
    b = batches(spark, [(*x[:2], f"2020-01-{i % 28 + 1:02d}T00:00:00Z", *x[3:], 1 + i % 2, None) for i, x in enumerate(rows)])
    runs = lambda: (pairs(overlap.found([t], man, scratch)), pairs(neardup.found(t, scratch)), shas(history.run_batches(t.limit(0), b, scratch)))
    want = runs()
    plain = records.fingerprints
    clash = lambda df, *x: plain(df, *x).withColumn("id", F.col("id") % 3)
    for m in (overlap, neardup, history):
        monkeypatch.setattr(m, "fingerprints", clash)
    assert runs() == want and all(want)


def test_near_duplicates(spark, scratch):
    r = random.Random(5)
    recs = family(60, r, 22)
    recs += [("same1", recs[0][1]), ("same2", recs[0][1])]
    rows = [row(s, d) for s, d in recs] + [row("bad", "T1" + "Z" * 70), row("off", recs[3][1], status="TNULL"), row(recs[5][0], recs[5][1].strip())]
    t = spark.createDataFrame(rows, INVENTORY)
    got = pairs(neardup.found(t, scratch))
    want = {(min(a, b), max(a, b)) for a, x in recs for b, y in recs if a < b and distance(bare(x), bare(y)) <= 30}
    assert got == want and want
    per = {x["sha"]: x for x in neardup.grouped(t, scratch).collect()}
    # Class pairs and members give the pairs back.
    cls: dict = {}
    for x in per.values():
        cls.setdefault(x["class_sha"], []).append(x["sha"])
    back = {(min(a, b), max(a, b)) for x in neardup.class_pairs(t, scratch).collect() for a in cls[x["class_a"]] for b in cls[x["class_b"]]}
    assert back | {(a, b) for m in cls.values() for a in m for b in m if a < b} == want
    assert set(per) == {s for s, _ in recs} and per["same2"]["class_sha"] == recs[0][0]
    assert neardup.found(spark.createDataFrame([], INVENTORY), scratch).count() == 0


def test_sketch_estimates_similarity_and_fills():
    lists = neardup.bin_lists(400)
    rng = np.random.default_rng(1)
    a = rng.integers(0, 4, (200, 128))
    b = a.copy()
    b[:, :30] = (b[:, :30] + 1) % 4
    present = np.zeros((2, 200, 512), bool)
    for k, x in enumerate((a, b)):
        np.put_along_axis(present[k], x + 4 * np.arange(128), True, axis=1)
    s, t = (neardup.sketch(present[k], lists) for k in (0, 1))
    assert (s >= 0).all() and (t >= 0).all()
    share = (s == t).mean(1)
    assert abs(share.mean() - 98 / 158) < 0.01 and share.std() < 1.3 * np.sqrt(0.62 * 0.38 / 400)


def test_sketch_equals_its_definition():
    """Round by round as the method says, and in passes as one."""
    size = 60
    lists = neardup.bin_lists(size)
    rng = np.random.default_rng(2)
    present = np.zeros((6, 512), bool)
    np.put_along_axis(present, rng.integers(0, 4, (6, 128)) + 4 * np.arange(128), True, axis=1)
    present[5] = False
    present[5, 17] = True  # a set of one token fills the bins it never reaches in their own round
    t = np.arange(512, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row, got in zip(present, neardup.sketch(present, lists)):
        best: list = [None] * size
        for r in range(2 * size):
            h = neardup.mix(t + np.uint64((neardup.SEED << 32) + r + 1))
            for k in np.flatnonzero(row):
                b = int(h[k] % np.uint64(size)) if r < size else r - size
                v = (r, int(h[k] >> np.uint64(20)), int(k))
                best[b] = v if best[b] is None else min(best[b], v)
        assert [r * 512 + k for r, _, k in best] == list(got)
    part = neardup.bin_lists(size, 20, 40)
    assert (neardup.sketch(present, part) == neardup.sketch(present, lists)[:, 20:40]).all()


def test_layout_keeps_the_miss_bound():
    longest = 0
    for n in (0, 10, 10**4, 10**6, 10**8, 10**10):
        bands, rows = neardup.layout(n, 0.1)
        assert (1 - neardup.ALIKE**rows) ** bands <= neardup.MISS and rows >= longest
        longest = rows
