"""Problem 1: same or nearly the same records across splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.digest import distance, equal_values
from tidemark.functions.keys import clean
from tidemark.llm import winnow
from tidemark.llm.records import CLASS, fingerprints, of_class, ordered_pairs, sides, whole
from tidemark.session import Scratch

WITHIN = 20


def split_sides(manifest: DataFrame) -> DataFrame:
    """sha, side: a record is on the train side if a row says train, on the eval side if one says validation or test."""
    split = clean("split")
    side = F.when(split == "train", "train").when(split.isin("validation", "test"), "eval")
    return manifest.select(clean("sha").alias("sha"), side.alias("side")).where(F.col("sha").isNotNull() & F.col("side").isNotNull()).distinct()


def cross_split_pairs(tables: list[DataFrame], manifest: DataFrame, scratch: Scratch, within: int = WITHIN) -> DataFrame:
    """Pairs of an evaluation record and a train record whose fingerprints agree exactly or nearly.

    Gives eval_sha, train_sha, exact (equal content), distance, seeds (windows in which a seed hit) and coverage
    (share of the 128 digest values that agree); the last three are null for pairs found by content only.

    Classes of equal digests are joined, not records: each digest keeps winnowed fingerprints (see winnow), the
    evaluation side asks for its neighbourhood seeds, the seeds that hit are chained per pair of digests (digests
    are aligned, so all lie on one diagonal), and the chain is extended to the whole digest, which gives the
    distance and the coverage. Pairs of classes are then expanded to their records. All joins are sort-merge joins by hint:
    either side grows with the tables, so none may be built on the driver, and AQE splits hot keys of such joins.

    Nulls: rows without sha or split take no part; a null content equals nothing; without a usable digest only
    content counts. Repeated rows count once. Empty tables give an empty result. within: at most 20, as far
    as the windows find every pair.
    """
    if within > WITHIN:
        raise ValueError(f"the windows find all pairs up to distance {WITHIN}")
    every = reduce(DataFrame.unionByName, [fingerprints(t) for t in tables])
    records = scratch.cut(every.join(split_sides(manifest).hint("merge"), "sha").distinct(), "records")
    side = {s: records.where(F.col("side") == s) for s in ("eval", "train")}

    held = lambda s: side[s].where("content IS NOT NULL").select("content", F.col("sha").alias(f"{s}_sha"))
    exact = held("eval").join(held("train").hint("merge"), "content").select("eval_sha", "train_sha", F.lit(True).alias("exact"), *(F.lit(None).cast("int").alias(c) for c in ("distance", "seeds", "equal")))

    # One row a distinct digest and side.
    digests = {s: scratch.cut(d.where("id IS NOT NULL").select(*CLASS).distinct(), f"{s}-digests") for s, d in side.items()}
    ask = winnow.banded(winnow.asked(digests["eval"], ["id", "head"]), "head", 1, False).select("key", F.col("id").alias("eval_id"), "window")
    keep = winnow.banded(winnow.kept(digests["train"], ["id", "head"]), "head", 1, True).select("key", F.col("id").alias("train_id"))
    chains = ask.join(keep.hint("merge"), "key").groupBy("eval_id", "train_id").agg(F.expr("bit_count(bit_or(shiftleft(1, window)))").alias("seeds"))

    # Digests that share a hash all come back here and are told apart by the alignment.
    both = chains.join(of_class(digests["eval"], "eval").hint("merge"), "eval_id").join(of_class(digests["train"], "train").hint("merge"), "train_id")
    a, b = sides("eval", "train")
    near = scratch.cut(both.select(*whole("eval"), *whole("train"), "seeds", distance(a, b).alias("distance"), equal_values(a, b).alias("equal")).where(F.col("distance") <= within), "near")
    for s in ("eval", "train"):
        near = near.join(of_class(side[s].where("id IS NOT NULL"), s, F.col("sha").alias(f"{s}_sha")).hint("merge"), whole(s))
    near = near.select("eval_sha", "train_sha", F.lit(False).alias("exact"), "distance", "seeds", "equal")

    out = exact.unionByName(near).where(F.col("eval_sha") != F.col("train_sha"))
    return out.groupBy("eval_sha", "train_sha").agg(F.max("exact").alias("exact"), F.min("distance").alias("distance"), F.max("seeds").alias("seeds"), (F.max("equal") / F.lit(128.0)).alias("coverage"))


def found(tables: list[DataFrame], manifest: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs as sha_a, sha_b."""
    return ordered_pairs(cross_split_pairs(tables, manifest, scratch), "eval_sha", "train_sha", "sha_a", "sha_b")


def report(tables: list[DataFrame], manifest: DataFrame, scratch: Scratch) -> DataFrame:
    """Per evaluation split and manifest source: overlapping records, pairs, exact pairs, least distance, mean coverage.

    A record listed with several sources or splits counts in each; a null source is its own group.
    """
    pairs = cross_split_pairs(tables, manifest, scratch)
    per = pairs.groupBy("eval_sha").agg(F.count("*").alias("pairs"), F.sum(F.col("exact").cast("int")).alias("exact_pairs"), F.min("distance").alias("least_distance"), F.max("coverage").alias("coverage"))
    m = manifest.select(clean("sha").alias("eval_sha"), clean("split").alias("split"), "source").where(F.col("split").isin("validation", "test")).distinct()
    return m.join(per.hint("merge"), "eval_sha").groupBy("split", "source").agg(F.count("*").alias("records"), F.sum("pairs").alias("pairs"), F.sum("exact_pairs").alias("exact_pairs"), F.min("least_distance").alias("least_distance"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))
