"""Fingerprint tables in one normal form, and pairs of records from pairs of classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.digest import PARTS, pack, usable
from tidemark.functions.keys import clean

#: What tells digests apart: the hash first, for joins, and the whole packed digest.
CLASS = ("id", *PARTS)


def fingerprints(df: DataFrame, *extra: Column) -> DataFrame:
    """sha, content, id and the packed digest of each row of a fingerprint table, and extra columns.

    id is a 64-bit hash of the packed digest, null where there is no usable digest; it is a key of joins and no
    identity: digests that differ may share it (among 10^10 some will), so classes are told apart, and joined back, by
    CLASS, which holds the digest itself. Rows without a sha are no records and are left out.
    """
    d = df.select(clean("sha").alias("sha"), clean("disarmed_content_sha256").alias("content"), usable("tlsh", "tlsh_status").alias("_d"), *extra)
    d = d.where(F.col("sha").isNotNull() & (F.col("sha") != ""))
    names = [c for c in d.columns if c != "_d"]
    d = d.select(*names, *pack(F.col("_d")))
    return d.select(*names, F.when(F.col("head").isNotNull(), F.xxhash64(*PARTS)).alias("id"), *PARTS)


def of_class(df: DataFrame, side: str, *extra: str) -> DataFrame:
    """The columns of CLASS as side_id, side_head and so on, and the extra ones."""
    return df.select(*(F.col(c).alias(f"{side}_{c}") for c in CLASS), *extra)


def whole(side: str) -> list[str]:
    """The names that of_class gives."""
    return [f"{side}_{c}" for c in CLASS]


def sides(a: str, b: str) -> tuple[dict[str, Column], dict[str, Column]]:
    """The packed digests of two sides, as distance() takes them."""
    return tuple({p: F.col(f"{s}_{p}") for p in PARTS} for s in (a, b))


def ordered_pairs(df: DataFrame, a: str, b: str, out_a: str, out_b: str) -> DataFrame:
    """Distinct pairs with the smaller key first; a key with itself is no pair."""
    return df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias(out_a), F.greatest(a, b).alias(out_b)).distinct()
