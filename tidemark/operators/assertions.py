"""Data assertions that fail closed. Each runs one aggregate and raises; a plan without them stays lazy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DataError(ValueError):
    """Data break a rule the caller stated."""


def _raise(df: DataFrame, what: str) -> None:
    bad = df.limit(3).collect()
    if bad:
        raise DataError(f"{what}: {[tuple(r) for r in bad]}")


def unique(df: DataFrame, *key: str) -> DataFrame:
    """df, if no key occurs twice."""
    _raise(df.groupBy(*key).count().where("count > 1"), f"repeated {key}")
    return df


def rule(df: DataFrame, condition: Column, what: str) -> DataFrame:
    """df, if the condition is true (not null) on every row."""
    _raise(df.where(~F.coalesce(condition, F.lit(False))), what)
    return df


def hex_id(c: Column) -> Column:
    return c.rlike(r"^[0-9a-f]{64}\z")


def same_keys(a: DataFrame, b: DataFrame, key: str) -> None:
    """Both tables have the same set of keys."""
    _raise(a.select(key).join(b.select(key), key, "left_anti"), f"{key} missing on the right")
    _raise(b.select(key).join(a.select(key), key, "left_anti"), f"{key} missing on the left")


def disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    _raise(a.select(key).join(b.select(key), key, "left_semi"), f"{key} on both sides")


def nested(inner: DataFrame, outer: DataFrame, key: str) -> None:
    _raise(inner.select(key).join(outer.select(key), key, "left_anti"), f"{key} not in the outer set")


def exact_join(a: DataFrame, b: DataFrame, key: str, equal: list[str] = ()) -> DataFrame:
    """Inner join on a key unique on both sides whose key sets agree, with equal values in the named common columns."""
    unique(a, key), unique(b, key), same_keys(a, b, key)
    r = b.select(key, *(F.col(c).alias(f"_{c}") for c in equal), *(c for c in b.columns if c != key and c not in equal and c not in a.columns))
    j = a.join(r, key)
    if equal:
        rule(j, F.forall(F.array(*(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in equal)), lambda x: x), f"{equal} differ")
    return j.drop(*(f"_{c}" for c in equal))


def aligned(views: list[DataFrame], key: list[str], label: str) -> DataFrame:
    """Views joined on their full keys, if each has the same rows and labels; value columns must have distinct names."""
    out = views[0]
    for v in views[1:]:
        j = out.join(v.withColumnRenamed(label, "_label").withColumn("_r", F.lit(True)), key, "full_outer")
        rule(j, F.col("_r") & F.col(label).eqNullSafe(F.col("_label")), "views are not aligned")
        out = j.drop("_r", "_label")
    return out


def isolated(df: DataFrame, fold: str, *keys: str) -> DataFrame:
    """df, if no value of a key occurs in two folds; null keys are not compared."""
    for k in keys:
        _raise(df.where(F.col(k).isNotNull()).groupBy(k).agg(F.count_distinct(fold).alias("n")).where("n > 1"), f"{k} crosses folds")
    return df


def inventory(df: DataFrame, split: str, start: str, end: str) -> DataFrame:
    """df in the order (timestamp, sha), if every row is a valid record of the split: ids, period, hashes, digest with its status."""
    ts = F.col("timestamp").try_cast("timestamp")
    null_digest = F.col("tlsh_status") == "TNULL"
    digest = F.when(null_digest, F.col("tlsh") == "TNULL").otherwise((F.col("tlsh_status") == "VALID") & F.col("tlsh").rlike(r"^T1[0-9A-F]{70}\z"))
    ok = hex_id(F.col("sha")) & (F.col("split") == split) & (F.trim("family") != "") & F.col("timestamp").rlike(r"(Z|[+-]\d\d:\d\d)$") & (ts >= F.lit(start).cast("timestamp")) & (ts < F.lit(end).cast("timestamp")) & hex_id(F.col("disarmed_content_sha256")) & digest
    return unique(rule(df, ok, "invalid inventory row"), "sha").orderBy(ts, "sha")


def package(spec: dict, classes: int = 51, seeds: int = 5, views: int = 3, tol: float = 1e-12) -> dict:
    """spec, if every seed holds every view once, with temperatures in range, distinct checkpoints and weights that follow its signals."""
    import math

    if len(spec["seeds"]) != seeds or len(set(spec["seeds"])) != seeds or len(spec["class_to_idx"]) != classes:
        raise DataError("seeds or classes")
    if sorted(spec["class_to_idx"].values()) != list(range(classes)):
        raise DataError("class indices")
    seen = set()
    for s in spec["seeds"]:
        e = spec["entries"][str(s)]
        if len(e["views"]) != views:
            raise DataError("views")
        for v in e["views"].values():
            if not 0.05 <= v["temperature"] <= 20 or v["checkpoint_sha256"] in seen:
                raise DataError("temperature or repeated checkpoint")
            seen.add(v["checkpoint_sha256"])
        for name, beta in (("Q", 0.0), ("QD", spec["beta"])):
            x = [-a - beta * b for a, b in zip(e["L"], e["d"])]
            t = [math.exp(v - max(x)) for v in x]
            if any(abs(w - v / sum(t)) > tol for w, v in zip(e["weights"][name], t)):
                raise DataError(f"{name} weights do not follow from the stored signals")
    return spec
