"""Problem 9: sources mixed to target weights along a curriculum.

The size of the mixture is the largest at which every source with documents meets its target share without using
a document more than max_repeat times. Each source has a weight schedule over training: phases in which it gives
a share of the tokens, the average over phases being its target. The schedule is integrated; a copy of a document
stands at a cumulative token demand of its source, and the inverse of the integral at that demand is its position in
training. Documents are range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm import bpe
from tidemark.session import Scratch

PHASES = 8
TILT = 0.5
#: Documents that a hash bucket is laid out for.
PER_BUCKET = 50_000
LEVELS, STEP = 3, 64


def sizes(docs: DataFrame, scratch: Scratch, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """doc_id, source, tokens of every document; null and empty texts have 0 tokens."""
    return scratch.cut(docs.select("doc_id", "source", bpe.encoded(docs.sparkSession, docs["text"], vocabulary, count_only=True).cast("long").alias("tokens")), "sizes")


def plan(sized: DataFrame, targets: DataFrame, schedule: dict[str, list[float]] | None = None) -> list[dict]:
    """One entry a source: available tokens, demand, and the integral of its schedule at the phase ends.

    Sources are few (a table of targets and the sources present), so this is worked out on the driver. A source without
    documents leaves its share to the others in proportion and is reported with 0. By default a source's weight rises
    (falls) linearly over training if its documents are repeated more (less) than the average; a schedule of own gives
    each source one weight a phase.
    """
    have = {r["source"]: (r["docs"], r["tokens"]) for r in sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")).collect()}
    want: dict = {}
    for r in targets.collect():
        if r["source"] is not None and (r["target_share"] or 0) > 0:
            share, most = want.get(r["source"], (0.0, 0))
            want[r["source"]] = (share + r["target_share"], max(most, r["max_repeat"] or 1))
    usable = {s: w for s, w in want.items() if have.get(s, (0, 0))[1]}
    whole = sum(share for share, _ in usable.values())
    size = min((most * have[s][1] * whole / share for s, (share, most) in usable.items()), default=0.0)
    out = []
    mean = sum(share / whole * (size * share / whole / have[s][1]) for s, (share, _) in usable.items())
    far = max((abs(size * share / whole / have[s][1] - mean) for s, (share, _) in usable.items()), default=0) or 1.0
    for s in sorted({*have, *want}, key=lambda x: (x is None, x)):
        docs, tokens = have.get(s, (0, 0))
        share, most = want.get(s, (0.0, 0))
        demand = size * share / whole if s in usable else 0.0
        tilt = TILT * (demand / tokens - mean) / far if s in usable else 0.0
        weights = (schedule or {}).get(s) or [1 + tilt * (2 * (k + 0.5) / PHASES - 1) for k in range(PHASES)]
        ends, total = [0.0], sum(weights)
        for w in weights:
            ends.append(ends[-1] + w / total)
        out.append({"source": s, "docs": docs, "available": tokens or 0, "target_share": share, "max_repeat": most, "demand": demand, "integral": ends})
    return out


def running(d: DataFrame, by: list[str]) -> DataFrame:
    """d with ends: the running token count of its documents in hash order within `by`.

    A prefix sum over hash buckets plus one within the bucket, so a source that holds most documents is spread like
    any other. The join and the window are by the same columns: documents are shuffled once.
    """
    sums = d.groupBy(*by, "bucket").agg(F.sum("tokens").alias("_n"))
    starts = sums.select(*by, "bucket", (F.sum("_n").over(W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_start"))
    within = W.partitionBy(*by, "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    return d.join(starts.hint("merge"), [*by, "bucket"]).withColumn("ends", F.col("_start") + F.sum("tokens").over(within)).drop("_start")


def last_pass(d: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents that the last, partial pass of their source takes: those of d whose tokens fill `rest`.

    Documents fall into LEVELS by size against the rest: over a STEP-th of it, over a STEP-th of that, and shorter. Each
    level gives its share of the rest in hash order, long ones first, by an exact rule on prefix sums: the documents that
    end within the level's limit. What a level leaves open, less than the document that was cut, is added to the
    next one's limit. In a source's last level a document is taken if its middle lies within, so a source misses its
    demand by half of one of its shortest documents at most, or by what it has no shorter documents for.
    """
    level = F.least(F.lit(LEVELS - 1), F.floor(F.log(float(STEP), F.greatest(F.col("rest") / F.col("tokens"), F.lit(1.0))))).cast("int")
    at = scratch.cut(running(d.where("rest > 0").withColumn("level", level), ["source", "level"]), "order")
    # One row a source and level, as below: sources are few (see plan).
    have: dict = {}
    for s, k, n, rest in at.groupBy("source", "level").agg(F.sum("tokens"), F.max("rest")).collect():
        have.setdefault(s, {})[k] = (n, rest)
    spark, schema = d.sparkSession, "source string, level int, limit double, middle boolean"
    limits, carry = [], dict.fromkeys(have, 0.0)
    for k in range(LEVELS):
        mine = []
        for s, levels in have.items():
            if k in levels:
                n, rest = levels[k]
                carry[s] += rest * n / sum(x for x, _ in levels.values())
                mine.append((s, k, carry[s], k == max(levels)))
        limits += mine
        if k < LEVELS - 1 and mine:
            cut = at.join(F.broadcast(spark.createDataFrame(mine, schema)), ["source", "level"]).where("ends <= limit").groupBy("source").agg(F.max("ends")).collect()
            for s, ends in cut:
                carry[s] -= ends
    taken = at.join(F.broadcast(spark.createDataFrame(limits or [("", -1, 0.0, False)], schema)), ["source", "level"])
    return taken.where("CASE WHEN middle THEN ends - tokens / 2 ELSE ends END <= limit").select(d.columns)


def mixture(sized: DataFrame, sources: list[dict], scratch: Scratch) -> DataFrame:
    """doc_id, source, copy, tokens, position in [0, 1): one row a use of a document, sorted by position.

    Documents of a source stand in hash order. Whole passes take every document; the last pass takes documents up to
    the demand (last_pass). Documents without tokens and sources without a target are not used.
    """
    spark = sized.sparkSession
    used = [x for x in sources if x["demand"] > 0]
    schema = "source string, available double, demand double, passes int, rest double, integral array<double>"
    rows = []
    for x in used:
        passes = int(x["demand"] / x["available"] + 1e-9)
        rows.append((x["source"], float(x["available"]), x["demand"], passes, max(0.0, x["demand"] - passes * x["available"]), x["integral"]))
    per = F.broadcast(spark.createDataFrame(rows, schema))  # one row a source
    buckets = 1 << max(6, (max((x["docs"] for x in used), default=0) // PER_BUCKET).bit_length())
    d = sized.where("tokens > 0").withColumn("h", F.xxhash64("doc_id", "source")).withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets)).cast("int")).join(per, "source")
    keep = ["doc_id", "source", "tokens", "available", "demand", "integral"]
    full = running(d.where("passes > 0"), ["source"]).select(*keep, "ends", F.explode(F.sequence(F.lit(1), "passes")).alias("copy"))
    last = running(last_pass(d, scratch), ["source"]).select(*keep, "ends", (F.col("passes") + 1).alias("copy"))
    at = full.unionByName(last).withColumn("mid", F.col("ends") - F.col("tokens") / 2)
    x = F.least((F.col("mid") + (F.col("copy") - 1) * F.col("available")) / F.col("demand"), F.lit(1.0 - 1e-12))
    at = at.withColumn("x", x).withColumn("k", F.expr("size(filter(integral, w -> w <= x)) - 1"))
    position = F.expr(f"least((k + (x - integral[k]) / (integral[k + 1] - integral[k])) / (size(integral) - 1), {1.0 - 1e-12})")
    return at.select("doc_id", "source", "copy", "tokens", position.alias("position")).orderBy("position", "doc_id", "copy")


def report(mixed: DataFrame, sources: list[dict]) -> DataFrame:
    """source, documents, uses, repeats (most uses of a document), tokens, actual_share, target_share; a null source has no target."""
    spark = mixed.sparkSession
    per_doc = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("tokens").alias("tokens"))
    got = per_doc.groupBy("source").agg(F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.max("uses").alias("repeats"), F.sum("tokens").alias("tokens"))
    whole = got.agg(F.sum("tokens").alias("whole"))
    all_sources = spark.createDataFrame([(x["source"], x["target_share"], x["max_repeat"]) for x in sources] or [("", 0.0, 0)], "source string, target_share double, max_repeat int")
    joined = all_sources.join(got, all_sources["source"].eqNullSafe(got["source"]), "left").drop(got["source"]).join(F.broadcast(whole))  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select("source", zero("documents"), zero("uses"), zero("repeats"), "max_repeat", zero("tokens"), F.round(F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)), 6).alias("actual_share"), "target_share")
