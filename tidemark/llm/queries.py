"""The registered queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import clean
from tidemark.llm import bpe, canonical, dictionary, groups, history, mixture, neardup, oracle, overlap, splits
from tidemark.session import Scratch, table


def _fingerprint_tables(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, "train_tlsh"), table(spark, d, "validation_tlsh")]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found(_fingerprint_tables(spark, d), table(spark, d, "train_validation_manifest"), Scratch(spark, "p1"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(_fingerprint_tables(spark, d), table(spark, d, "train_validation_manifest"), Scratch(spark, "p1"))


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    f = dictionary.frequencies(table(spark, d, "trainingsample"), "sha", "family", [table(spark, d, "class_support").select("family")], scratch=Scratch(spark, "p2"))
    return f.withColumnRenamed("term", "family")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_terms(spark, d).where("mark IS NOT NULL").select("family", "mark")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.found(table(spark, d, "edges"), table(spark, d, "trainingsample"), Scratch(spark, "p3"))


def p4_cases(spark: SparkSession, d: str) -> DataFrame:
    return history.run_batches(table(spark, d, "train_tlsh"), table(spark, d, "validation_tlsh"), Scratch(spark, "p4"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_cases(spark, d).select("sha").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.found(table(spark, d, "validation_tlsh"), Scratch(spark, "p5"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardup.grouped(table(spark, d, "validation_tlsh"), Scratch(spark, "p5"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return neardup.class_pairs(table(spark, d, "validation_tlsh"), Scratch(spark, "p5"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.leaks(table(spark, d, "trainingsample"), table(spark, d, "manifest"), Scratch(spark, "p6"))


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign(table(spark, d, "trainingsample"), table(spark, d, "split_target"), Scratch(spark, "p6")).select("sha", "split_name")


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    s, t = table(spark, d, "trainingsample"), table(spark, d, "split_target")
    return splits.shares_report(splits.assign(s, t, Scratch(spark, "p6")), s, t)


def p6_group_splits(spark: SparkSession, d: str) -> DataFrame:
    """Records and splits of every group: the rule that p6_splits keeps, read off its result."""
    s = table(spark, d, "trainingsample")
    groups = s.select(clean("sha").alias("sha"), clean("group_id").alias("group_id")).dropna().distinct()
    assigned = p6_splits(spark, d)
    return groups.join(assigned.hint("merge"), "sha").groupBy("group_id").agg(F.count("*").alias("records"), F.count_distinct("split_name").alias("splits"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", bpe.encoded(spark, docs["text"]).alias("ids"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "p9")
    sized = mixture.sizes(table(spark, d, "documents"), scratch)
    return mixture.mixture(sized, mixture.plan(sized, table(spark, d, "mix_target")), scratch)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "p9")
    sized = mixture.sizes(table(spark, d, "documents"), scratch)
    sources = mixture.plan(sized, table(spark, d, "mix_target"))
    return mixture.report(mixture.mixture(sized, sources, scratch), sources)


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """Per source with a target: the share it should have, documents used more often than allowed, whether its share is met within 0.02."""
    scratch = Scratch(spark, "p9")
    sized = mixture.sizes(table(spark, d, "documents"), scratch)
    sources = mixture.plan(sized, table(spark, d, "mix_target"))
    whole = sum(x["demand"] for x in sources) or 1.0
    want = spark.createDataFrame([(x["source"], x["demand"] / whole, x["max_repeat"]) for x in sources if x["target_share"] > 0] or [("", 0.0, 0)], "source string, expected_share double, most int")
    mixed = scratch.cut(mixture.mixture(sized, sources, scratch), "mixed")
    got = mixture.report(mixed, sources).select("source", "actual_share")
    uses = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses")).join(F.broadcast(want), "source").where("uses > most").groupBy("source").agg(F.count("*").alias("over_cap"))
    at = want.join(got, "source").join(uses, "source", "left")  # one row a source
    return at.select("source", F.round("expected_share", 6).alias("expected_share"), F.coalesce("over_cap", F.lit(0)).alias("over_cap"), (F.abs(F.col("actual_share") - F.col("expected_share")) <= 0.02).alias("share_met"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.found(table(spark, d, "documents"), Scratch(spark, "p10"))


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    return canonical.forms(table(spark, d, "documents"))


def queries() -> dict:
    return {k: f for k, f in sorted(globals().items()) if k[0] == "p" and k[1].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
