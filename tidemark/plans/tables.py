"""The project's tables in normal form, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import clean, instant
from tidemark.operators import metrics
from tidemark.operators.cohort import utc_month
from tidemark.plans.registry import clean as c
from tidemark.plans.registry import instant as i
from tidemark.session import table

#: Folder-independent SQL of each normal form, to put behind WITH.
MANIFEST = f"m AS (SELECT {c('sha')} AS sha, {c('split')} AS split, ({i('timestamp')}) AT TIME ZONE 'UTC' AS ts, strftime(({i('timestamp')}) AT TIME ZONE 'UTC', '%Y-%m') AS month, {c('family')} AS family, source FROM train_validation_manifest)"
SAMPLES = f"s AS (SELECT {c('sha')} AS sha, ({i('timestamp')}) AT TIME ZONE 'UTC' AS ts, strftime(({i('timestamp')}) AT TIME ZONE 'UTC', '%Y-%m') AS month, {c('family')} AS family, target, {c('content_sha256')} AS content, {c('group_id')} AS group_id, episode FROM trainingsample)"
FOLDS = f"f AS (SELECT {c('sha')} AS sha, {c('family')} AS family, fold, ({i('timestamp')}) AT TIME ZONE 'UTC' AS ts, strftime(({i('timestamp')}) AT TIME ZONE 'UTC', '%Y-%m') AS month, retained, {c('group_id')} AS group_id, {c('disarmed_content_sha256')} AS content FROM manifest)"


def prints(name: str, alias: str) -> str:
    d = f"upper(trim(tlsh, ' ' || chr(9) || chr(10) || chr(13)))"
    return f"{alias} AS (SELECT {c('sha')} AS sha, ({i('timestamp')}) AT TIME ZONE 'UTC' AS ts, strftime(({i('timestamp')}) AT TIME ZONE 'UTC', '%Y-%m') AS month, {c('family')} AS family, file_size, {c('disarmed_content_sha256')} AS content, CASE WHEN {c('tlsh_status')} = 'valid' AND regexp_full_match({d}, '(T1)?[0-9A-F]{{70}}') THEN right({d}, 70) END AS digest FROM {name})"


TRAIN, VALIDATION = prints("train_tlsh", "t"), prints("validation_tlsh", "v")
EDGES = f"e AS (SELECT {c('sha_a')} AS sha_a, {c('sha_b')} AS sha_b, content_equal, tlsh_distance, run_no FROM edges)"


def _low(kind: str) -> str:
    return f"CAST(6148914691236517205 AS {kind})"


def packed(cte: str, src: str, keep: str) -> str:
    """SQL: keep, header fields and four words of the digests of a CTE."""
    words = ", ".join(f"('0x' || substr(digest, {7 + 16 * k}, 16))::UBIGINT AS w{k}" for k in range(4))
    head = "('0x' || substr(digest, 1, 2))::INT AS ck, ('0x' || substr(digest, 4, 1) || substr(digest, 3, 1))::INT AS lv, ('0x' || substr(digest, 5, 1))::INT AS q1, ('0x' || substr(digest, 6, 1))::INT AS q2"
    return f"{cte} AS (SELECT DISTINCT {keep}, {head}, {words} FROM {src} WHERE digest IS NOT NULL)"


def distance_sql(a: str, b: str) -> str:
    """SQL: distance of two rows of packed()."""
    ring = lambda x, m: f"least(abs({a}.{x} - {b}.{x}), {m} - abs({a}.{x} - {b}.{x}))"
    low = _low("UBIGINT")
    out = f"(CASE WHEN {a}.ck = {b}.ck THEN 0 ELSE 1 END) + (CASE WHEN {ring('lv', 256)} <= 1 THEN {ring('lv', 256)} ELSE 12 * {ring('lv', 256)} END)"
    for q in ("q1", "q2"):
        out += f" + (CASE WHEN {ring(q, 16)} <= 1 THEN {ring(q, 16)} ELSE 12 * ({ring(q, 16)} - 1) END)"
    for k in range(4):
        x = f"xor({a}.w{k}, {b}.w{k})"
        h, l = f"(({x} >> 1) & {low})", f"({x} & {low})"
        three = f"((({a}.w{k} >> 1) & {a}.w{k}) | (({b}.w{k} >> 1) & {b}.w{k}))"
        out += f" + bit_count({l}) + 2 * bit_count({h} & ~{l}) + 5 * bit_count({h} & {l} & {three})"
    return out


def manifest(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "train_validation_manifest")
    n = t.select(clean("sha").alias("sha"), clean("split").alias("split"), instant("timestamp").alias("ts"), clean("family").alias("family"), "source")
    return n.withColumn("month", utc_month(F.col("ts")))


def samples(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "trainingsample")
    n = t.select(clean("sha").alias("sha"), instant("timestamp").alias("ts"), clean("family").alias("family"), "target", clean("content_sha256").alias("content"), clean("group_id").alias("group_id"), "episode")
    return n.withColumn("month", utc_month(F.col("ts")))


def folds(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "manifest")
    n = t.select(clean("sha").alias("sha"), clean("family").alias("family"), "fold", instant("timestamp").alias("ts"), "retained", clean("group_id").alias("group_id"), clean("disarmed_content_sha256").alias("content"))
    return n.withColumn("month", utc_month(F.col("ts")))


def inventory(spark: SparkSession, d: str, name: str) -> DataFrame:
    from tidemark.functions.digest import usable

    t = table(spark, d, name)
    n = t.select(clean("sha").alias("sha"), instant("timestamp").alias("ts"), clean("family").alias("family"), "file_size", clean("disarmed_content_sha256").alias("content"), usable("tlsh", "tlsh_status").alias("digest"))
    return n.withColumn("month", utc_month(F.col("ts")))


#: embeddings as predictions: three views of ten logits, five pseudo-seeds that rotate them, six months, groups of three.
SEEDS, VIEWS, CLASSES = 5, 3, 10
LOGITS = f"""g AS (SELECT vec_id, label, vec_id % 6 AS month, vec_id // 3 AS group_id, 1 + (vec_id * 37) % 1000 AS size, sd.seed, vw.view,
  list_transform(embedding[(10 * vw.view + 3 * sd.seed + 1):(10 * vw.view + 3 * sd.seed + 10)], lambda x: 10 * x::DOUBLE) AS z
  FROM embeddings, (SELECT unnest(range({SEEDS})) AS seed) sd, (SELECT unnest(range({VIEWS})) AS view) vw),
l AS (SELECT *, list_transform(z, lambda x: x - (list_max(z) + ln(list_sum(list_transform(z, lambda y: exp(y - list_max(z))))))) AS logp FROM g),
p AS (SELECT *, list_position(logp, list_max(logp)) - 1 AS predicted, -logp[label + 1] AS nll,
  list_sum(list_transform(logp, lambda x: exp(2 * x))) - 2 * exp(logp[label + 1]) + 1 AS brier, exp(list_max(logp)) AS confidence FROM l)"""
#: The uniform mixture of the three views.
FUSED = """, x AS (SELECT a.vec_id, a.label, a.month, a.group_id, a.size, a.seed, list_transform(range(1, 11), lambda i: ln((exp(a.logp[i]) + exp(b.logp[i]) + exp(c.logp[i])) / 3)) AS logp
  FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.seed = b.seed AND b.view = 1 JOIN l c ON a.vec_id = c.vec_id AND a.seed = c.seed AND c.view = 2 WHERE a.view = 0),
u AS (SELECT *, list_position(logp, list_max(logp)) - 1 AS predicted, -logp[label + 1] AS nll,
  list_sum(list_transform(logp, lambda x: exp(2 * x))) - 2 * exp(logp[label + 1]) + 1 AS brier, exp(list_max(logp)) AS confidence FROM x)"""


def logits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    grid = e.select(
        "vec_id", F.col("label").cast("int").alias("label"), (F.col("vec_id") % 6).alias("month"), F.expr("vec_id div 3").alias("group_id"), (1 + (F.col("vec_id") * 37) % 1000).alias("size"), "embedding",
        F.explode(F.array(*(F.lit(i) for i in range(SEEDS)))).alias("seed"),
    ).select("*", F.explode(F.array(*(F.lit(i) for i in range(VIEWS)))).alias("view"))
    z = F.transform(F.slice("embedding", F.col("view") * 10 + F.col("seed") * 3 + 1, F.lit(10)), lambda x: x.cast("double") * 10)
    return grid.select("vec_id", "label", "month", "group_id", "size", "seed", "view", z.alias("z"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Per seed, view and sample: logp, predicted, nll, brier, confidence, correct."""
    return metrics.sample_metrics(logits(spark, d).withColumn("logp", metrics.log_softmax(F.col("z"))))


def fused(spark: SparkSession, d: str, weights: list | None = None) -> DataFrame:
    """Per seed and sample the mixture of the three views: one aggregate a sample, no join."""
    g = logits(spark, d).withColumn("logp", metrics.log_softmax(F.col("z")))
    by = g.groupBy("vec_id", "label", "month", "group_id", "size", "seed").agg(*(F.first(F.when(F.col("view") == v, F.col("logp")), ignorenulls=True).alias(f"v{v}") for v in range(VIEWS)))
    mixed = by.select("vec_id", "label", "month", "group_id", "size", "seed", metrics.mixture([F.col(f"v{v}") for v in range(VIEWS)], weights).alias("logp"))
    return metrics.sample_metrics(mixed)
