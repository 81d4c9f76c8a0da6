"""The registered queries of the core, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import clean
from tidemark.operators import skew
from tidemark.plans import content_queries, model_queries, select_queries, study_queries, verify_queries  # noqa: F401
from tidemark.plans.registry import QUERIES, SQL, query, typed
from tidemark.plans.registry import clean as c
from tidemark.plans.tables import SAMPLES
from tidemark.session import table


@query("p7_found", f"WITH {SAMPLES} SELECT 'family' AS field, family AS key_value FROM s WHERE family IS NOT NULL GROUP BY family HAVING count(*) >= 0.05 * (SELECT count(*) FROM s) UNION ALL SELECT 'group_id', group_id FROM s WHERE group_id IS NOT NULL GROUP BY group_id HAVING count(*) >= 0.05 * (SELECT count(*) FROM s)")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.hot_keys(table(spark, d, "trainingsample"), ["family", "group_id"]).select("field", "key_value")


@query("p7_keys", f"WITH {SAMPLES} SELECT 'family' AS field, family AS key_value, count(*) AS row_count, count(DISTINCT sha) AS record_count, min(ts) AS first_seen, max(ts) AS last_seen FROM s GROUP BY family UNION ALL SELECT 'group_id', group_id, count(*), count(DISTINCT sha), min(ts), max(ts) FROM s GROUP BY group_id")
def p7_keys(spark: SparkSession, d: str) -> DataFrame:
    k = skew.key_states(table(spark, d, "trainingsample"), ["family", "group_id"])
    return k.withColumn("first_seen", F.col("first_seen").cast("timestamp_ntz")).withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


@query("p7_support", f"SELECT a.family, b.in_support, count(*) AS joined_rows, sum(a.target)::BIGINT AS target_sum, sum(b.samples)::BIGINT AS samples_sum FROM (SELECT {c('family')} AS family, target FROM trainingsample) a JOIN (SELECT {c('family')} AS family, samples, in_support FROM class_support) b ON a.family = b.family GROUP BY 1, 2")
def p7_support(spark: SparkSession, d: str) -> DataFrame:
    """Sample rows per family joined with the audit's rows of that family, which may be several."""
    left = table(spark, d, "trainingsample").select(clean("family").alias("family"), "target")
    right = table(spark, d, "class_support").select(clean("family").alias("family"), "samples", "in_support")
    return skew.eager_join(left, right, ["family"], ["family"], ["in_support"], {"target_sum": F.col("target").cast("long")}, {"samples_sum": F.col("samples").cast("long")})


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Families whose training samples suffice for a study: here 10 distinct samples over 3 months, as the tables are small."""
    from tidemark.operators.cohort import eligible
    from tidemark.plans.tables import manifest

    return eligible(manifest(spark, d).where("split = 'train' AND family IS NOT NULL"), "family", "sha", "month", 10, 3).orderBy("family")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: typed(name) for name in SQL}
