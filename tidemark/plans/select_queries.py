"""Scans, projections, joins, aggregates, ranks and set operations over the project's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators import cohort
from tidemark.plans.registry import query
from tidemark.plans.tables import EDGES, FOLDS, MANIFEST, SAMPLES, TRAIN, VALIDATION, folds, inventory, manifest, samples
from tidemark.functions.keys import clean
from tidemark.session import Scratch, table

TRAIN_FROM, TRAIN_END = "2019-08", "2020-02"
COHORT = f"k AS (SELECT family FROM m WHERE split = 'train' AND family IS NOT NULL GROUP BY family HAVING count(DISTINCT sha) >= 50 AND count(DISTINCT month) >= 3)"


def _cohort(spark, d):
    m = manifest(spark, d).where("split = 'train' AND family IS NOT NULL")
    return cohort.eligible(m, "family", "sha", "month")


@query("A01_cohort", f"WITH {MANIFEST} SELECT family, count(DISTINCT sha) AS samples, count(DISTINCT month) AS months FROM m WHERE split = 'train' AND family IS NOT NULL GROUP BY family HAVING count(DISTINCT sha) >= 50 AND count(DISTINCT month) >= 3")
def a01(spark, d):
    return _cohort(spark, d)


@query("S01_metadata_scan", f"WITH {MANIFEST} SELECT sha, ts, family FROM m WHERE ts >= TIMESTAMP '2019-08-01' AND ts < TIMESTAMP '2020-04-01'")
def s01(spark, d):
    return manifest(spark, d).where("ts >= TIMESTAMP '2019-08-01' AND ts < TIMESTAMP '2020-04-01'").select("sha", F.col("ts").cast("timestamp_ntz").alias("ts"), "family")


@query("S16_month_scan", f"WITH {TRAIN} SELECT sha, family, file_size FROM t WHERE month = '2019-11'")
def s16(spark, d):
    return inventory(spark, d, "train_tlsh").where("month = '2019-11'").select("sha", "family", "file_size")


@query("S14_retained_subset", f"WITH {TRAIN}, {FOLDS} SELECT sha, family, digest FROM t WHERE sha IN (SELECT sha FROM f WHERE retained AND fold = 0)")
def s14(spark, d):
    keep = folds(spark, d).where("retained AND fold = 0").select("sha")
    return inventory(spark, d, "train_tlsh").join(keep, "sha", "left_semi").select("sha", "family", "digest")


@query("P01_month", f"WITH {MANIFEST} SELECT month, count(*) AS n FROM m GROUP BY month")
def p_month(spark, d):
    return manifest(spark, d).groupBy("month").agg(F.count("*").alias("n"))


@query("P02_period", f"WITH {MANIFEST} SELECT sha, CASE WHEN ts >= TIMESTAMP '2019-08-01' AND ts < TIMESTAMP '2020-02-01' THEN 'train' ELSE 'validation' END AS period FROM m WHERE ts >= TIMESTAMP '2019-08-01' AND ts < TIMESTAMP '2020-04-01'")
def p_period(spark, d):
    p = cohort.period(F.col("ts"), [("train", "2019-08-01", "2020-02-01"), ("validation", "2020-02-01", "2020-04-01")])
    return manifest(spark, d).select("sha", p.alias("period")).where("period IS NOT NULL")


@query("P03_normal_form", f"WITH {MANIFEST} SELECT DISTINCT family, split FROM m")
def p_normal(spark, d):
    return manifest(spark, d).select("family", "split").distinct()


STAGE = "CASE WHEN month >= '2019-08' AND month < '2019-12' THEN 'train' WHEN month = '2019-12' THEN 'A' WHEN month = '2020-01' THEN 'B' WHEN month = '2020-02' THEN 'C' END"


def _staged(df):
    return df.withColumn("stage", cohort.stage(F.col("month"), "2019-08", "2019-12", {"A": "2019-12", "B": "2020-01", "C": "2020-02"}))


@query("P04_stage", f"WITH {MANIFEST} SELECT {STAGE} AS stage, month, count(*) AS n FROM m GROUP BY 1, 2")
def p_stage(spark, d):
    return _staged(manifest(spark, d)).groupBy("stage", "month").agg(F.count("*").alias("n"))


@query("P08_kind", f"WITH {MANIFEST}, {COHORT} SELECT month, CASE WHEN family IS NULL OR trim(family) = '' THEN 'benign' WHEN family IN (SELECT family FROM k) THEN 'known_class' ELSE 'unknown_class' END AS kind, count(*) AS n FROM m WHERE split = 'test' GROUP BY 1, 2")
def p_kind(spark, d):
    m = manifest(spark, d).where("split = 'test'")
    return cohort.kind("family", _cohort(spark, d), m).groupBy("month", "kind").agg(F.count("*").alias("n"))


@query("P09_size_bucket", f"WITH {TRAIN} SELECT (CASE WHEN file_size > 40000 THEN 1 ELSE 0 END) + (CASE WHEN file_size > 100000 THEN 1 ELSE 0 END) + (CASE WHEN file_size > 400000 THEN 1 ELSE 0 END) AS bucket, count(*) AS n FROM t GROUP BY 1")
def p_bucket(spark, d):
    return inventory(spark, d, "train_tlsh").groupBy(cohort.size_bucket(F.col("file_size"), [40000, 100000, 400000]).alias("bucket")).agg(F.count("*").alias("n"))


@query("P12_size_filter", f"WITH {TRAIN} SELECT sha, file_size FROM t WHERE file_size > 0 AND file_size <= 5242880")
def p_size(spark, d):
    return inventory(spark, d, "train_tlsh").where("file_size > 0 AND file_size <= 5 * 1024 * 1024").select("sha", "file_size")


@query("P05_row_rules", "WITH x AS (SELECT sha, tlsh, tlsh_status, disarmed_content_sha256 AS c FROM train_tlsh) SELECT sha, coalesce(regexp_full_match(sha, '[0-9a-f]{64}'), false) AS id_ok, coalesce(regexp_full_match(c, '[0-9a-f]{64}'), false) AS content_ok, coalesce((tlsh_status = 'TNULL' AND tlsh = 'TNULL') OR (tlsh_status = 'VALID' AND regexp_full_match(tlsh, 'T1[0-9A-F]{70}')), false) AS digest_ok FROM x")
def p_rules(spark, d):
    t = table(spark, d, "train_tlsh")
    digest = ((F.col("tlsh_status") == "TNULL") & (F.col("tlsh") == "TNULL")) | ((F.col("tlsh_status") == "VALID") & F.col("tlsh").rlike(r"^T1[0-9A-F]{70}\z"))
    no = F.lit(False)
    return t.select("sha", F.coalesce(F.col("sha").rlike(r"^[0-9a-f]{64}\z"), no).alias("id_ok"), F.coalesce(F.col("disarmed_content_sha256").rlike(r"^[0-9a-f]{64}\z"), no).alias("content_ok"), F.coalesce(digest, no).alias("digest_ok"))


@query("J01_exact_coverage", f"WITH {MANIFEST}, {TRAIN}, a AS (SELECT DISTINCT sha FROM m WHERE split = 'train'), b AS (SELECT DISTINCT sha FROM t) SELECT coalesce(a.sha, b.sha) AS sha, CASE WHEN b.sha IS NULL THEN 'manifest_only' ELSE 'fingerprint_only' END AS side FROM a FULL JOIN b ON a.sha = b.sha WHERE a.sha IS NULL OR b.sha IS NULL")
def j01(spark, d):
    a = manifest(spark, d).where("split = 'train'").select("sha").distinct().withColumn("a", F.lit(1))
    b = inventory(spark, d, "train_tlsh").select("sha").distinct().withColumn("b", F.lit(1))
    return a.join(b, "sha", "full").where("a IS NULL OR b IS NULL").select("sha", F.when(F.col("b").isNull(), "manifest_only").otherwise("fingerprint_only").alias("side"))


@query("J02_cohort_rows", f"WITH {MANIFEST}, {COHORT} SELECT sha, split, family FROM m WHERE family IN (SELECT family FROM k)")
def j02(spark, d):
    return manifest(spark, d).join(_cohort(spark, d).select("family"), "family", "left_semi").select("sha", "split", "family")


@query("J03_canonical_order", f"WITH {SAMPLES}, {FOLDS}, o AS (SELECT sha, min(ts) AS ts FROM s WHERE episode = 'E1' GROUP BY sha), r AS (SELECT sha, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m') ORDER BY ts, sha) AS ordinal FROM o) SELECT DISTINCT r.sha, r.ordinal, f.fold FROM r JOIN f ON r.sha = f.sha")
def j03(spark, d):
    o = samples(spark, d).where("episode = 'E1'").groupBy("sha").agg(F.min("ts").alias("ts"))
    r = o.withColumn("ordinal", F.row_number().over(W.partitionBy(cohort.utc_month(F.col("ts"))).orderBy("ts", "sha")))
    return r.join(folds(spark, d).select("sha", "fold"), "sha").select("sha", "ordinal", "fold").distinct()


@query("J05_fold_isolation", f"WITH {FOLDS} SELECT 'group' AS kind, group_id AS key, count(DISTINCT fold) AS folds FROM f WHERE retained AND fold BETWEEN 0 AND 4 AND group_id IS NOT NULL GROUP BY group_id HAVING count(DISTINCT fold) > 1 UNION ALL SELECT 'content', content, count(DISTINCT fold) FROM f WHERE retained AND fold BETWEEN 0 AND 4 AND content IS NOT NULL GROUP BY content HAVING count(DISTINCT fold) > 1")
def j05(spark, d):
    f = folds(spark, d).where("retained AND fold BETWEEN 0 AND 4")
    long = f.select("fold", F.inline(F.array(F.struct(F.lit("group").alias("kind"), F.col("group_id").alias("key")), F.struct(F.lit("content").alias("kind"), F.col("content").alias("key")))))
    return long.where("key IS NOT NULL").groupBy("kind", "key").agg(F.count_distinct("fold").alias("folds")).where("folds > 1")


@query("J12_first_copies", f"WITH {TRAIN}, o AS (SELECT sha, min(ts) AS ts, min(content) AS content FROM t GROUP BY sha) SELECT sha, content, first_value(sha) OVER (PARTITION BY content ORDER BY ts, sha) AS first_sample FROM o WHERE content IS NOT NULL")
def j12(spark, d):
    o = inventory(spark, d, "train_tlsh").groupBy("sha").agg(F.min("ts").alias("ts"), F.min("content").alias("content")).where("content IS NOT NULL")
    return cohort.first_copies(o, "content", "ts", "sha").select("sha", "content", "first_sample")


@query("J14_inner_edges", f"WITH {EDGES}, {FOLDS} SELECT DISTINCT least(sha_a, sha_b) AS a, greatest(sha_a, sha_b) AS b FROM e WHERE sha_a <> sha_b AND sha_a IN (SELECT sha FROM f WHERE retained) AND sha_b IN (SELECT sha FROM f WHERE retained) AND (content_equal OR tlsh_distance <= 20)")
def j14(spark, d):
    e = table(spark, d, "edges").where("content_equal OR tlsh_distance <= 20").select(clean("sha_a").alias("sha_a"), clean("sha_b").alias("sha_b")).where("sha_a <> sha_b")
    k = folds(spark, d).where("retained").select("sha").distinct()
    e = e.join(k.withColumnRenamed("sha", "sha_a"), "sha_a", "left_semi").join(k.withColumnRenamed("sha", "sha_b"), "sha_b", "left_semi")
    return e.select(F.least("sha_a", "sha_b").alias("a"), F.greatest("sha_a", "sha_b").alias("b")).distinct()


@query("J15_metadata_equal", f"WITH {FOLDS}, {TRAIN} SELECT DISTINCT f.sha, f.family IS NOT DISTINCT FROM t.family AS same_family, f.ts IS NOT DISTINCT FROM t.ts AS same_time, f.content IS NOT DISTINCT FROM t.content AS same_content FROM f JOIN t ON f.sha = t.sha")
def j15(spark, d):
    t = inventory(spark, d, "train_tlsh").select("sha", F.col("family").alias("tf"), F.col("ts").alias("tt"), F.col("content").alias("tc"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    return folds(spark, d).join(t, "sha").select("sha", same("family", "tf").alias("same_family"), same("ts", "tt").alias("same_time"), same("content", "tc").alias("same_content")).distinct()


@query("J18_overlap_checks", f"WITH {MANIFEST} SELECT a.split AS split_a, b.split AS split_b, count(DISTINCT a.sha) AS n FROM m a JOIN m b ON a.sha = b.sha AND a.split < b.split GROUP BY 1, 2")
def j18(spark, d):
    m = manifest(spark, d).where("split IS NOT NULL").select("sha", "split").distinct()
    return m.withColumnRenamed("split", "split_a").join(m.withColumnRenamed("split", "split_b"), "sha").where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count("*").alias("n"))


@query("A02_prefix_cohort", f"WITH {SAMPLES} SELECT family, count(DISTINCT CASE WHEN month >= '2019-08' AND month < '2019-12' THEN sha END) AS samples, count(DISTINCT CASE WHEN month >= '2019-08' AND month < '2019-12' THEN month END) AS months, count(DISTINCT CASE WHEN month >= '2019-08' AND month < '2019-12' THEN sha END) >= 50 AND count(DISTINCT CASE WHEN month >= '2019-08' AND month < '2019-12' THEN month END) >= 3 AS eligible FROM s WHERE family IS NOT NULL GROUP BY family")
def a02(spark, d):
    return cohort.eligible(samples(spark, d).where("family IS NOT NULL"), "family", "sha", "month", when=F.col("month").between("2019-08", "2019-11"), keep_all=True)


@query("A03_validation_audit", f"WITH {MANIFEST}, {COHORT}, e AS (SELECT * FROM m WHERE split = 'validation') SELECT 'rows' AS what, count(*) AS n FROM e UNION ALL SELECT 'labelled', count(family) FROM e UNION ALL SELECT 'in_cohort', count(*) FROM e WHERE family IN (SELECT family FROM k) UNION ALL SELECT 'distinct_in_cohort', count(DISTINCT sha) FROM e WHERE family IN (SELECT family FROM k) UNION ALL SELECT 'absent_families', count(*) FROM k WHERE family NOT IN (SELECT family FROM e WHERE family IS NOT NULL)")
def a03(spark, d):
    k = _cohort(spark, d).select("family")
    e = manifest(spark, d).where("split = 'validation'")
    known = e.join(k.withColumn("known", F.lit(True)), "family", "left")
    one = known.agg(F.count("*").alias("rows"), F.count("family").alias("labelled"), F.count("known").alias("in_cohort"), F.count_distinct(F.when(F.col("known"), F.col("sha"))).alias("distinct_in_cohort"))
    long = one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in one.columns))))
    return long.unionByName(k.join(e.select("family"), "family", "left_anti").agg(F.count("*").alias("n")).select(F.lit("absent_families").alias("what"), "n"))


@query("A04_zero_filled", f"WITH {MANIFEST}, c AS (SELECT month, family, count(*) AS n FROM m WHERE split = 'test' GROUP BY 1, 2) SELECT a.month, b.family, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT month FROM m WHERE split = 'test') a CROSS JOIN (SELECT DISTINCT family FROM m WHERE family IS NOT NULL) b LEFT JOIN c ON a.month = c.month AND b.family = c.family")
def a04(spark, d):
    m = manifest(spark, d)
    t = m.where("split = 'test'")
    return cohort.zero_filled(t.groupBy("month", "family").agg(F.count("*").alias("n")), {"month": t.select("month"), "family": m.where("family IS NOT NULL").select("family")}, "n")


@query("A05_group_summary", f"WITH {FOLDS} SELECT group_id, count(*) AS all_samples, count(*) FILTER (retained) AS retained_samples, count(*) FILTER (NOT retained) AS excluded_samples, count(DISTINCT family) AS class_count_all, count(DISTINCT family) FILTER (retained) AS class_count_retained, coalesce(string_agg(DISTINCT family, '|' ORDER BY family), '') AS classes FROM f WHERE group_id IS NOT NULL GROUP BY group_id")
def a05(spark, d):
    return cohort.group_summary(folds(spark, d).where("group_id IS NOT NULL"), "group_id", "family", F.col("retained"))


@query("A06_identical_digests", f"WITH {TRAIN}, o AS (SELECT DISTINCT sha, digest, content, family, month FROM t WHERE digest IS NOT NULL) SELECT digest, count(DISTINCT sha) AS samples, count(DISTINCT content) AS unique_contents, count(DISTINCT family) AS class_count, count(DISTINCT month) AS month_count, count(DISTINCT sha) * (count(DISTINCT sha) - 1) // 2 AS pairs FROM o GROUP BY digest HAVING count(DISTINCT sha) >= 2")
def a06(spark, d):
    t = inventory(spark, d, "train_tlsh").where("digest IS NOT NULL")
    g = t.groupBy("digest").agg(F.count_distinct("sha").alias("samples"), F.count_distinct("content").alias("unique_contents"), F.count_distinct("family").alias("class_count"), F.count_distinct("month").alias("month_count"))
    return g.where("samples >= 2").withColumn("pairs", F.expr("samples * (samples - 1) div 2"))


MEMBERS = f"w AS (SELECT sha, family, {STAGE} AS stage, group_id, retained FROM f WHERE group_id IS NOT NULL)"


def _members(spark, d):
    return _staged(folds(spark, d).where("group_id IS NOT NULL")).select("sha", "family", "stage", "group_id", "retained")


@query("A07_graph_summary", f"WITH {FOLDS}, {MEMBERS}, g AS (SELECT group_id, count(*) FILTER (retained) AS s, count(DISTINCT family) FILTER (retained) AS c, count(DISTINCT stage) FILTER (retained) AS t FROM w GROUP BY group_id) SELECT count(*) AS all_groups, count(*) FILTER (s > 0) AS active_groups, max(s) AS largest_retained_group, count(*) FILTER (s > 0 AND c > 1) AS multi_label_active_groups, count(*) FILTER (s > 0 AND t > 1) AS cross_stage_active_groups, coalesce(sum(s) FILTER (t > 1), 0)::BIGINT AS samples_in_cross_stage_groups, round(sum(s) * sum(s) / sum(s * s), 6)::DOUBLE AS size_concentration FROM g")
def a07(spark, d):
    return cohort.graph_summary(_members(spark, d), "group_id", "family", "stage", "retained")


@query("A07_size_histogram", f"WITH {FOLDS}, {MEMBERS}, g AS (SELECT group_id, count(*) AS size FROM w WHERE retained GROUP BY group_id) SELECT size, count(*) AS groups FROM g GROUP BY size")
def a07h(spark, d):
    return cohort.size_histogram(_members(spark, d), "group_id", "retained")


def _stage_sql(s: str) -> str:
    return f"coalesce(sum(n) FILTER (stage = '{s}'), 0)::BIGINT AS {s}_samples, count(*) FILTER (stage = '{s}') AS {s}_groups, coalesce(max(n) FILTER (stage = '{s}'), 0) AS {s}_largest_group"


@query("A08_support_table", f"""WITH {FOLDS}, {MEMBERS}, g AS (SELECT family, stage, group_id, count(*) AS n FROM w WHERE retained GROUP BY 1, 2, 3),
q AS (SELECT k.family, {_stage_sql('A')}, {_stage_sql('B')} FROM (SELECT DISTINCT family FROM w WHERE family IS NOT NULL) k LEFT JOIN g ON k.family = g.family GROUP BY k.family),
o AS (SELECT family, count(*) AS n FROM f WHERE month = '2020-01' AND family IS NOT NULL GROUP BY family),
r AS (SELECT q.*, coalesce(o.n, 0) AS C_samples, A_samples >= 20 AND A_groups >= 5 AND B_samples >= 20 AND B_groups >= 5 AS eligible_S,
concat_ws('|', CASE WHEN A_samples < 20 THEN 'A:samples<20' END, CASE WHEN A_groups < 5 THEN 'A:groups<5' END, CASE WHEN B_samples < 20 THEN 'B:samples<20' END, CASE WHEN B_groups < 5 THEN 'B:groups<5' END) AS failure_reasons FROM q LEFT JOIN o ON q.family = o.family)
SELECT *, eligible_S AND C_samples > 0 AS S_eval FROM r""")
def a08(spark, d):
    m = _members(spark, d)
    o = folds(spark, d).where("month = '2020-01' AND family IS NOT NULL").groupBy("family").agg(F.count("*").alias("n"))
    return cohort.support_table(m, m.where("family IS NOT NULL"), "family", "stage", "group_id", "retained", o)


@query("A09_two_month_support", f"""WITH {FOLDS}, g AS (SELECT family, month, group_id, count(*) AS n FROM f WHERE retained AND group_id IS NOT NULL AND family IS NOT NULL AND month IN ('2019-12', '2020-01') GROUP BY 1, 2, 3),
x AS (SELECT group_id, count(DISTINCT month) AS months FROM g GROUP BY group_id)
SELECT family, month, sum(n)::BIGINT AS samples, count(*) AS groups, max(n) AS largest, round(sum(n) * sum(n) / sum(n * n), 6)::DOUBLE AS concentration, coalesce(sum(n) FILTER (months = 2), 0)::BIGINT AS cross_month_samples FROM g JOIN x ON g.group_id = x.group_id GROUP BY 1, 2""")
def a09(spark, d):
    f = folds(spark, d).where("retained AND group_id IS NOT NULL AND family IS NOT NULL AND month IN ('2019-12', '2020-01')")
    g = f.groupBy("family", "month", "group_id").agg(F.count("*").alias("n"))
    x = g.groupBy("group_id").agg(F.count_distinct("month").alias("months"))
    return g.join(x, "group_id").groupBy("family", "month").agg(
        F.sum("n").alias("samples"), F.count("*").alias("groups"), F.max("n").alias("largest"), F.round(F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n")), 6).alias("concentration"), F.coalesce(F.sum(F.when(F.col("months") == 2, F.col("n"))), F.lit(0)).alias("cross_month_samples")
    )


INFOLD = "r AS (SELECT * FROM f WHERE retained AND fold BETWEEN 0 AND 4 AND family IS NOT NULL AND group_id IS NOT NULL)"


def _infold(spark, d):
    return folds(spark, d).where("retained AND fold BETWEEN 0 AND 4 AND family IS NOT NULL AND group_id IS NOT NULL")


@query("A10_fold_support", f"WITH {FOLDS}, {INFOLD}, q AS (SELECT family, count(*) AS samples, count(DISTINCT group_id) AS groups, " + ", ".join(f"count(*) FILTER (fold = {k}) AS fold_{k}_score" for k in range(5)) + " FROM r GROUP BY family) SELECT *, samples >= 20 AND groups >= 5 AS in_support, samples - greatest(fold_0_score, fold_1_score, fold_2_score, fold_3_score, fold_4_score) AS minimum_fit_samples FROM q")
def a10(spark, d):
    return cohort.fold_support(_infold(spark, d), "family", "group_id", "fold")


@query("A10_fold_summary", f"WITH {FOLDS}, {INFOLD} SELECT fold, count(*) AS score_samples, count(DISTINCT group_id) AS score_groups, count(DISTINCT family) AS score_classes, (SELECT count(*) FROM r) - count(*) AS fit_samples FROM r GROUP BY fold")
def a10s(spark, d):
    return cohort.fold_summary(_infold(spark, d), "family", "group_id", "fold")


@query("A11_support_matrix", f"WITH {FOLDS}, {INFOLD} SELECT group_id, family, count(*) AS n FROM r GROUP BY 1, 2")
def a11(spark, d):
    return cohort.support_matrix(_infold(spark, d), "group_id", "family")


@query("A12_incidence", f"WITH {FOLDS}, {INFOLD}, g AS (SELECT group_id, count(*) AS n, count(DISTINCT family) AS c FROM r GROUP BY 1) SELECT count(*) AS groups, count(*) FILTER (c > 1) AS multi_class_groups, coalesce(sum(n) FILTER (c > 1), 0)::BIGINT AS samples_in_multi_class_groups, max(n) AS largest_group FROM g")
def a12(spark, d):
    return cohort.incidence(_infold(spark, d), "group_id", "family")


@query("A13_equal_side_capacity")
def a13(spark, d):
    g = _infold(spark, d).groupBy("family", "month", "group_id").agg(F.count("*").alias("n"))
    return cohort.equal_side_capacity(g, ["family", "month"], "n")


@query("A26_size_quartiles", f"WITH {TRAIN} SELECT round(quantile_cont(file_size, 0.25), 6) AS q25, round(quantile_cont(file_size, 0.5), 6) AS q50, round(quantile_cont(file_size, 0.75), 6) AS q75 FROM t")
def a26(spark, d):
    return inventory(spark, d, "train_tlsh").agg(*(F.round(F.percentile("file_size", F.lit(q / 100)), 6).alias(f"q{q}") for q in (25, 50, 75)))


@query("A37_size_five_numbers", f"WITH {TRAIN} SELECT family, min(file_size) AS least, round(quantile_cont(file_size, 0.25), 6) AS q25, round(quantile_cont(file_size, 0.5), 6) AS q50, round(quantile_cont(file_size, 0.75), 6) AS q75, max(file_size) AS most FROM t GROUP BY family")
def a37(spark, d):
    q = [F.round(F.percentile("file_size", F.lit(q / 100)), 6).alias(f"q{q}") for q in (25, 50, 75)]
    return inventory(spark, d, "train_tlsh").groupBy("family").agg(F.min("file_size").alias("least"), *q, F.max("file_size").alias("most"))


@query("A35_coverage", f"WITH {MANIFEST} SELECT month, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test FROM m GROUP BY month")
def a35(spark, d):
    return manifest(spark, d).groupBy("month").agg(*(F.count_if(F.col("split") == s).alias(s) for s in ("train", "validation", "test")))


@query("W01_hash_rank", f"WITH {MANIFEST}, o AS (SELECT DISTINCT family, sha FROM m WHERE split = 'train' AND family IS NOT NULL), h AS (SELECT *, sha256('[\"study\",42,\"train-reference\",\"E1\",\"' || family || '\",\"' || sha || '\"]') AS rank_hash FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY rank_hash, sha) AS rank FROM h) SELECT * FROM r WHERE rank <= 128")
def w01(spark, d):
    o = manifest(spark, d).where("split = 'train' AND family IS NOT NULL").select("family", "sha").distinct()
    return cohort.ranked_by_hash(o, ["family"], ["sha"], F.concat(F.lit('"study",42,"train-reference","E1","'), F.col("family"), F.lit('"')), 128)


@query("W05_evenly_spaced", f"WITH {TRAIN}, o AS (SELECT DISTINCT sha, file_size FROM t WHERE file_size > 0 AND file_size <= 5242880), r AS (SELECT *, row_number() OVER (ORDER BY file_size, sha) - 1 AS rank_index, count(*) OVER () AS n FROM o) SELECT sha, file_size, rank_index FROM r WHERE rank_index IN (SELECT i * (n - 1) // 9 FROM range(10) t(i))")
def w05(spark, d):
    o = inventory(spark, d, "train_tlsh").where("file_size > 0 AND file_size <= 5242880").select("sha", "file_size").distinct()
    return cohort.evenly_spaced(o, ["file_size", "sha"], Scratch(spark, "w05"))


@query("W06_group_numbers", f"WITH {FOLDS}, g AS (SELECT DISTINCT group_id FROM f WHERE group_id IS NOT NULL AND month = '2019-12') SELECT group_id, 'F' || lpad(row_number() OVER (ORDER BY group_id)::VARCHAR, 6, '0') AS group_no FROM g")
def w06(spark, d):
    from tidemark.operators.retention import numbered

    return numbered(folds(spark, d).where("group_id IS NOT NULL AND month = '2019-12'").select("group_id").distinct(), "group_id", "F", Scratch(spark, "w06"))


@query("T01_canonical_order", f"WITH {VALIDATION} SELECT sha, ts FROM v ORDER BY ts, sha")
def t01(spark, d):
    return inventory(spark, d, "validation_tlsh").select("sha", F.col("ts").cast("timestamp_ntz").alias("ts")).orderBy("ts", "sha")


@query("T02_manifest_order", "SELECT sha, split, timestamp FROM train_validation_manifest ORDER BY CASE WHEN split = 'train' THEN 0 ELSE 1 END, timestamp, sha")
def t02(spark, d):
    return table(spark, d, "train_validation_manifest").select("sha", "split", "timestamp").orderBy(F.when(F.col("split") == "train", 0).otherwise(1), "timestamp", "sha")


@query("T03_largest_groups", f"WITH {FOLDS} SELECT group_id, count(*) AS n FROM f WHERE group_id IS NOT NULL GROUP BY group_id ORDER BY n DESC, group_id LIMIT 10")
def t03(spark, d):
    return folds(spark, d).where("group_id IS NOT NULL").groupBy("group_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "group_id").limit(10)


@query("T04_largest_families", f"WITH {MANIFEST} SELECT family, count(*) AS n FROM m WHERE family IS NOT NULL GROUP BY family ORDER BY n DESC, family LIMIT 10")
def t04(spark, d):
    return manifest(spark, d).where("family IS NOT NULL").groupBy("family").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "family").limit(10)


@query("T05_work_list", f"WITH {TRAIN} SELECT DISTINCT sha, file_size FROM t ORDER BY file_size DESC, sha LIMIT 25")
def t05(spark, d):
    return inventory(spark, d, "train_tlsh").select("sha", "file_size").distinct().orderBy(F.desc("file_size"), "sha").limit(25)


@query("U01_same_ids", f"WITH {MANIFEST}, {TRAIN} SELECT sha FROM (SELECT sha FROM m WHERE split = 'train') EXCEPT SELECT sha FROM t")
def u01(spark, d):
    return manifest(spark, d).where("split = 'train'").select("sha").exceptAll(inventory(spark, d, "train_tlsh").select("sha")).join(inventory(spark, d, "train_tlsh").select("sha"), "sha", "left_anti").distinct()


@query("U02_both_tables", f"WITH {TRAIN}, {VALIDATION} SELECT content FROM t WHERE content IS NOT NULL INTERSECT SELECT content FROM v WHERE content IS NOT NULL")
def u02(spark, d):
    pick = lambda n: inventory(spark, d, n).where("content IS NOT NULL").select("content")
    return pick("train_tlsh").intersect(pick("validation_tlsh"))


@query("U03_not_nested", f"WITH {FOLDS}, {TRAIN} SELECT sha FROM f WHERE retained EXCEPT SELECT sha FROM t WHERE digest IS NOT NULL")
def u03(spark, d):
    return folds(spark, d).where("retained").select("sha").subtract(inventory(spark, d, "train_tlsh").where("digest IS NOT NULL").select("sha"))


@query("U04_all_rows", f"WITH {TRAIN}, {VALIDATION} SELECT 'train' AS origin, sha, family FROM t UNION ALL SELECT 'validation', sha, family FROM v")
def u04(spark, d):
    pick = lambda n, o: inventory(spark, d, n).select(F.lit(o).alias("origin"), "sha", "family")
    return pick("train_tlsh", "train").unionByName(pick("validation_tlsh", "validation"))


@query("U05_evaluated_classes", f"WITH {MANIFEST}, {COHORT}, n AS (SELECT DISTINCT family FROM m WHERE month = '2020-05' AND family IS NOT NULL) SELECT family, family IN (SELECT family FROM n) AS present FROM k")
def u05(spark, d):
    n = manifest(spark, d).where("month = '2020-05' AND family IS NOT NULL").select("family").distinct().withColumn("present", F.lit(True))
    return _cohort(spark, d).select("family").join(n, "family", "left").select("family", F.coalesce("present", F.lit(False)).alias("present"))


@query("U06_absent_classes", f"WITH {MANIFEST}, {COHORT} SELECT family FROM k WHERE family NOT IN (SELECT family FROM m WHERE split = 'validation' AND family IS NOT NULL)")
def u06(spark, d):
    return _cohort(spark, d).select("family").join(manifest(spark, d).where("split = 'validation'").select("family"), "family", "left_anti")


@query("C01_class_index", f"WITH {MANIFEST}, {COHORT} SELECT family, row_number() OVER (ORDER BY family) - 1 AS class_index FROM k")
def c01(spark, d):
    return cohort.class_index(_cohort(spark, d), "family")
