"""Byte views, digests, files, sinks and streams."""

import io
import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import byteviews as bv
from tidemark.plans.content_queries import PERMUTATION
from tidemark.sources import files, sinks
from tidemark.streaming import streams


def test_states_with_known_answers():
    assert bv.states(b"\x00\x10\x83").tolist() == [0, 1, 2, 3]
    assert bv.states(b"\xab\x10", 4).tolist() == [10, 11, 1, 0]
    assert bv.states(b"\xff").tolist() == [63, 3] and bv.states(b"\xff\xff").tolist() == [63, 63, 15]
    with pytest.raises(ValueError):
        bv.states(b"a", 9)


def test_transitions_are_floored_shares():
    # States 0, 1, 0, 1, 0, 2, 0, 0 of two bits.
    m = bv.transitions(bytes([0b00010001, 0b00100000]), 2)
    assert m[0].tolist() == [63, 127, 63, 0] and m[1].tolist() == [255, 0, 0, 0] and m[3].tolist() == [0, 0, 0, 0]
    with pytest.raises(ValueError):
        bv.transitions(b"a", 8)


def plain_entropy(data, window, stride):
    total, cover = [0.0] * len(data), [0] * len(data)
    for start in range(0, len(data), stride):
        part = data[start : start + window]
        e = -sum(part.count(b) / len(part) * math.log2(part.count(b) / len(part)) for b in set(part)) / 8
        for i in range(start, start + len(part)):
            total[i] += e
            cover[i] += 1
        if start + window >= len(data):
            break
    return [t / c for t, c in zip(total, cover)]


@pytest.mark.parametrize("n", [1, 5, 255, 256, 257, 384, 385, 1000])
def test_local_entropy(n):
    data = np.random.default_rng(n).integers(0, 40, n).astype(np.uint8).tobytes()
    assert np.allclose(bv.local_entropy(data), plain_entropy(data, 256, 128), atol=1e-12)
    assert np.allclose(bv.local_entropy(data, 7, 3), plain_entropy(data, 7, 3), atol=1e-12)


def test_entropy_extremes():
    assert np.allclose(bv.local_entropy(bytes(range(256))), 1) and np.allclose(bv.local_entropy(b"a" * 900), 0)


def test_masked_resize_is_exact():
    m, ok = np.arange(12.0).reshape(3, 4), np.ones((3, 4), bool)
    assert np.allclose(bv.masked_resize(m, ok, 1), m.mean())
    ok[0] = False
    assert np.allclose(bv.masked_resize(m, ok, 1), m[1:].mean())
    assert np.allclose(bv.masked_resize(np.ones((3, 4)), np.zeros((3, 4), bool), 2), 0)
    two = bv.masked_resize(m, np.ones((3, 4), bool), 2)
    assert np.allclose(two[0, 0], (2 * (0 + 1) + 4 + 5) / 6)


def test_images(spark):
    data = [bytes(range(256)) * 3, b"ab", None, b"z" * 70000]
    t = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in enumerate(data)], "i int, c binary")
    got = t.select("i", bv.raw_byte_image(F.col("c")).alias("r"), bv.local_entropy_image(F.col("c")).alias("e")).orderBy("i").collect()
    assert len(got[0]["r"]) == 4096 and got[2]["r"] is None and np.allclose(got[3]["r"][:4000], ord("z") / 255, atol=1e-6)
    assert np.allclose(got[3]["e"], 0) and np.allclose(got[0]["r"], bv.raw_image(data[0]).ravel())
    with pytest.raises(Exception, match="declared size"):
        t.where("i = 1").select(bv.declared_size(F.col("c"), F.lit(3))).collect()


def test_digest(spark):
    table = np.array(bv.permutation(PERMUTATION))
    rng = np.random.default_rng(7)
    data = rng.integers(0, 256, 3000).astype(np.uint8).tobytes()
    near = data[:1500] + b"xx" + data[1502:]
    a, b = bv.digest(data, table), bv.digest(near, table)
    assert len(a) == 72 and a.startswith("T1") and 0 < streams._steps(a[2:], b[2:]) < 40
    assert bv.digest(b"\0" * 5000, table) == "TNULL" and bv.digest(data[:49], table) == "TNULL"
    t = spark.createDataFrame([(bytearray(data),), (None,)], "c binary").select(bv.digest_column(F.col("c"), table.tolist())).collect()
    assert [r[0] for r in t] == [a, None]


def test_copies_within_files(spark):
    base = bytes(np.random.default_rng(8).integers(0, 256, 4000).astype(np.uint8))
    longer = base[:1000] + b"INSERTED" + base[1000:]
    r = bv.compare(base, longer, 16, 64)
    assert r["prefix"] >= 1000 and r["one_insertion"] and {x["shift"] for x in r["anchors"] if x["status"] == "UNIQUE_MATCH"} == {0, 8}
    assert bv.compare(b"aaaa" * 40, b"aaaa" * 50, 4, 8)["anchors"][0]["status"] == "AMBIGUOUS_SOURCE"
    t = spark.createDataFrame([(bytearray(base), bytearray(longer)), (None, bytearray(base))], "a binary, b binary")
    got = t.select(bv.compare_columns(F.col("a"), F.col("b"), 16, 64).alias("r")).collect()
    assert got[0]["r"]["one_insertion"] and got[1]["r"] is None


def test_strict_readers(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("﻿sha,n\nx,1\ny,2\n", encoding="utf-8")
    assert [tuple(r) for r in files.strict_csv(spark, str(p), "sha string, n int").collect()] == [("x", 1), ("y", 2)]
    for text in ("sha,sha\nx,1\n", "n,sha\n1,x\n", "sha,n,m\nx,1,2\n"):
        p.write_text(text)
        with pytest.raises(ValueError):
            files.strict_csv(spark, str(p), "sha string, n int")
    p.write_text("sha,n\nx,1,9\n")
    with pytest.raises(Exception):
        files.strict_csv(spark, str(p), "sha string, n int").collect()
    assert files.strict_json('{"a": [1, {"b": 2}]}') == {"a": [1, {"b": 2}]}
    for text in ('{"a": 1, "a": 2}', '{"a": NaN}'):
        with pytest.raises(ValueError):
            files.strict_json(text)


def test_guards(tmp_path):
    (tmp_path / "x").write_bytes(b"hello")
    sha = "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    assert files.pinned(str(tmp_path), "x", sha) == b"hello"
    for path, digest in (("x", "0" * 64), ("../x", sha)):
        with pytest.raises(ValueError):
            files.pinned(str(tmp_path), path, digest)
    assert files.only(["a"]) == "a"
    with pytest.raises(ValueError):
        files.only(["a", "b"])


def test_archives_and_bundles(spark, tmp_path):
    files.register(spark)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.exe", b"12345")
        z.writestr("dir/two.exe", b"")
    got = {r["zip_member"]: r for r in spark.read.format("zip_index").load(str(tmp_path / "*.zip")).collect()}
    assert set(got) == {"one.exe", "dir/two.exe"} and got["one.exe"]["file_size"] == 5 and got["one.exe"]["zip_crc32"] == "cbf53a1c"
    np.savez(tmp_path / "b.npz", ids=np.array(["x", "y"]), classes=np.array(["p", "q"]), labels=np.array([0, 1]), logits=np.array([[1.0, 2.0], [3.0, 4.0]]))
    rows = spark.read.format("npz_bundle").load(str(tmp_path / "b.npz")).orderBy("position").collect()
    assert [(r["id"], r["label"], r["logits"]) for r in rows] == [("x", 0, [1.0, 2.0]), ("y", 1, [3.0, 4.0])]
    with pytest.raises(Exception):
        spark.read.format("npz_bundle").option("sha256", "0").load(str(tmp_path / "b.npz")).collect()
    f = io.BytesIO()
    np.save(f, np.zeros((3, 2), "<f4"))
    assert files.npy_header(f.getvalue()) == {"version": 1, "dtype": "<f4", "fortran_order": False, "shape": (3, 2)}
    for bad in (b"nothing", f.getvalue()[:20]):
        with pytest.raises(ValueError):
            files.npy_header(bad)


def test_contents_and_checksums(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.bin").write_bytes(b"12345")
    (tmp_path / "d" / "checksums.json").write_bytes(b"{}")
    r = files.contents(spark, str(tmp_path / "d" / "x.bin")).first()
    assert r["file_size"] == 5 and r["crc32"] == "cbf53a1c"
    assert sinks.checksums(spark, str(tmp_path / "d")).count() == 1


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    sinks.ordered_csv(d, str(tmp_path / "csv"), "k")
    assert [r[0] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == ["1", "2"]
    with pytest.raises(Exception):
        sinks.ordered_csv(d, str(tmp_path / "csv"), "k")
    assert sinks.canonical_json({"b": 1, "a": "é"}) == b'{"a":"\\u00e9","b":1}' and len(sinks.config_id({})) == 64
    with pytest.raises(ValueError):
        sinks.canonical_json({"a": math.nan})
    sinks.write_json(str(tmp_path / "j"), {"a": 1})
    assert json.loads((tmp_path / "j").read_text()) == {"a": 1}
    with pytest.raises(FileExistsError):
        sinks.write_json(str(tmp_path / "j"), {})
    assert sinks.verified_parquet(d, str(tmp_path / "p")).count() == 2
    for _ in range(2):
        assert sinks.append_new(d, str(tmp_path / "q"), "k").count() == 2
    assert sinks.append_new(spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string"), str(tmp_path / "q"), "k").count() == 3
    assert sinks.long_table(d.withColumn("x", F.lit(1)), ["v"], ["k", "x"]).count() == 4


def test_streams(spark, scratch, tmp_path):
    rows = [(f"2020-01-{d:02d} 00:00:00", "a", 1.0) for d in (1, 1, 2, 9)]
    t = spark.createDataFrame(rows, "t string, k string, v double").select(F.col("t").cast("timestamp").alias("t"), "k", "v")
    t.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    w = {r["window_start"].day: r["n"] for r in streams.run_available(streams.windowed_counts(s, "t", ["k"], "v"), scratch, "w").collect()}
    assert w == {1: 2, 2: 1}
    assert streams.run_available(streams.first_arrivals(s, "k").select("k"), scratch, "f").count() == 1


def test_stateful_retention():
    import pandas as pd

    class State:
        exists, value = False, None

        @property
        def get(self):
            return self.value

        def update(self, v):
            self.exists, self.value = True, v

    f, st = streams.retention_function(10), State()
    d = "00" * 35
    near = d[:6] + "1" + d[7:]
    one = pd.DataFrame({"ts": ["2020-01-01", "2020-01-02"], "sha": ["a", "b"], "digest": [d, near]})
    two = pd.DataFrame({"ts": ["2020-01-03"], "sha": ["c"], "digest": ["FF" * 35]})
    assert pd.concat(f(("k",), [one], st))["decision"].tolist() == ["KEEP", "EXCLUDE"]
    assert pd.concat(f(("k",), [two], st))["decision"].tolist() == ["KEEP"]
    with pytest.raises(ValueError):
        list(f(("k",), [one], st))


def test_resize_of_tall_layouts():
    r = np.random.default_rng(11)
    m, ok = r.random((5000, 8)), r.random((5000, 8)) < 0.7
    down, across = bv.overlaps(5000, 4).astype(float), bv.overlaps(8, 4).T.astype(float)
    assert np.allclose(bv.masked_resize(m, ok, 4), (down @ (m * ok) @ across) / (down @ ok @ across))
