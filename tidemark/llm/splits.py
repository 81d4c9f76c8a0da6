"""Problem 6: splits that keep related records together.

Records that share a group, directly or through others, form a component, found by Hash-to-Min (Rastogi et
al. 2013): every node keeps a cluster of nodes, sends the cluster to its least member and the least member to the cluster,
and unites what it gets, until nothing changes; the node that is least of its component then holds all of it. Here a
cluster is kept as rows (node, member) of a table, never as a list, and a node's least member comes from a partial
aggregate that is joined back, so the rows of a hub spread over tasks (a window over them would not).

Every component gets its split by weighted rendezvous hashing: component c goes to the split s with the least
-ln(h(c, s)) / w(s), which picks s with probability w(s) and moves few components when weights change. Weights follow
family and size: components go in waves, the largest of each family first, and a wave's weights are what its family
still lacks of each split, so the small ones make up for where the large ones fell.

Nodes are 64-bit hashes. Two that agree by chance join two components, which keeps more together than needed, and
can neither part records nor make a case of leaks(), where keys are compared themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.keys import clean
from tidemark.session import Scratch

FEW = 20_000


def hash_to_min(links: DataFrame, scratch: Scratch, max_rounds: int = 40) -> DataFrame:
    """vertex, component (least vertex) for links (a, b); loops and nulls are ignored, repeats count once.

    A round sends, for each node v with cluster C and m = min(C): C to m, and m to every node of C. Rows (v, u) with
    u in C are the state; sending C to m gives (m, u), sending m to each u gives (u, m). So a round maps every row
    (v, u) to (m, u) and (u, m) and adds nothing else. Rounds end when no row changes.
    """
    e = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b")
    both = e.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(e.select(F.col("b").alias("v"), F.col("a").alias("u"))).distinct()
    mark = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("v", "u")), F.lit(0)).alias("x")).first()
    state = scratch.cut(both, "clusters")
    before = mark(state)
    for _ in range(max_rounds):
        sent = state.join(state.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m")).hint("merge"), "v")
        pair = lambda v, u: F.struct(F.col(v).alias("v"), F.col(u).alias("u"))
        nxt = sent.select(F.inline(F.array(pair("m", "u"), pair("u", "m"), pair("v", "m"), pair("m", "v")))).where("v <> u").distinct()
        nxt = scratch.cut(nxt, "clusters")
        # At rest every row joins a component's least node with another of its nodes.
        now = mark(nxt)
        scratch.drop(state)
        state = nxt
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"clusters not settled after {max_rounds} rounds")
    return state.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("component")).select(F.col("v").alias("vertex"), "component")


def rendezvous(seed: str, by: Column | str, weight: Column) -> Column:
    """-ln(h) / weight with h in (0, 1) from the hash of two columns (or a column and a literal column)."""
    h = (F.pmod(F.xxhash64(seed, by), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(h) / weight


def record_components(samples: DataFrame, scratch: Scratch) -> DataFrame:
    """sha, component for every record of samples: records that share a group_id, in any of their rows, are together.

    Links run between a hashed record and a hashed group, so a group with a tenth of all records has that many links
    and not their square. A record without a group is a component of its own.
    """
    pairs = samples.select(clean("sha").alias("sha"), clean("group_id").alias("g")).where(F.col("sha").isNotNull()).distinct()
    pairs = scratch.cut(pairs.select("sha", F.xxhash64(F.lit("r"), "sha").alias("a"), F.when(F.col("g").isNotNull(), F.xxhash64(F.lit("g"), "g")).alias("b")), "pairs")
    # A group with one record, of a record with one group, links nothing else: only others need rounds.
    per_record = pairs.where("b IS NOT NULL").groupBy("a").agg(F.count_distinct("b").alias("n"), F.min("b").alias("only"))
    several = per_record.where("n > 1").select("a")
    # Groups joined by records with several groups; all other records follow their one group.
    links = pairs.join(several.hint("merge"), "a", "left_semi").select("a", "b")
    joined = hash_to_min(links, scratch).withColumnRenamed("vertex", "only")
    home = per_record.join(joined.hint("merge"), "only", "left").select("a", F.coalesce("component", "only").alias("component"))
    return pairs.select("sha", "a").distinct().join(home.hint("merge"), "a", "left").select("sha", F.coalesce("component", "a").alias("component"))


def waves(comps: DataFrame) -> DataFrame:
    """comps (component, family, n) with wave: 0 for the largest of a family, then 1 and by powers of 4 of how many are larger.

    The rank comes from the counts of components by family and size, which are few rows, not from sorting components.
    """
    sizes = comps.groupBy("family", "n").agg(F.count("*").alias("c"))
    w = W.partitionBy("family").orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)
    larger = sizes.withColumn("larger", F.coalesce(F.sum("c").over(w), F.lit(0)))
    wave = F.when(F.col("larger") < 2, F.col("larger").cast("int")).otherwise(2 + F.floor(F.log2("larger") / 2).cast("int"))
    return comps.join(larger.select("family", "n", wave.alias("wave")).hint("merge"), ["family", "n"])


def assign(samples: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """sha, component, split_name for every record of samples.

    Shares hold for records, overall and within each family. A component belongs to the family most of its records
    have (ties: the least name). Waves of components, the largest of each family first, are hashed with the weights
    their family still lacks; a split that lacks less than a component's records has weight 0 for it, and where
    all do, the component goes where most is lacking. Null families are one family.
    """
    s = scratch.cut(record_components(samples, scratch), "components")
    fam = samples.select(clean("sha").alias("sha"), F.coalesce(clean("family"), F.lit("")).alias("family")).where(F.col("sha").isNotNull()).groupBy("sha").agg(F.max("family").alias("family"))
    sizes = s.join(fam.hint("merge"), "sha").groupBy("component", "family").agg(F.count("*").alias("n"))
    comps = sizes.groupBy("component").agg(F.sum("n").alias("n"), F.min_by("family", F.struct(-F.col("n"), "family")).alias("family"))
    comps = scratch.cut(comps, "sized")
    shares = sorted((r[0], float(r[1])) for r in targets.select("split_name", "target_share").dropna().groupBy("split_name").agg(F.sum("target_share")).collect())
    if not shares or sum(w for _, w in shares) <= 0:
        raise ValueError("targets needs splits with positive shares")
    whole = sum(w for _, w in shares)
    names = [x for x, _ in shares]
    waved = scratch.cut(waves(comps), "waves")
    # One row a family and one a wave (at most 34) reach the driver.
    numbers = sorted(r[0] for r in waved.select("wave").distinct().collect())
    families = scratch.cut(comps.groupBy("family").agg(F.sum("n").alias("all")), "families")
    few = families.count() <= FEW
    placed = None
    for k in numbers:
        lacks = families.select("family", *((F.col("all") * F.lit(w / whole)).alias(f"l{i}") for i, (_, w) in enumerate(shares)))
        if placed is not None:
            done = placed.groupBy("family").agg(*(F.sum(F.when(F.col("split_name") == x, F.col("n")).otherwise(0)).alias(f"d{i}") for i, x in enumerate(names)))
            lacks = lacks.join(done.hint("merge"), "family", "left").select("family", *((F.col(f"l{i}") - F.coalesce(f"d{i}", F.lit(0))).alias(f"l{i}") for i in range(len(names))))
        at = waved.where(F.col("wave") == k).join(F.broadcast(lacks) if few else lacks.hint("merge"), "family")
        best = lambda i, x: F.struct(F.when(F.col("n") <= F.col(f"l{i}"), rendezvous("component", F.lit(x), F.col(f"l{i}"))).otherwise(F.lit(1e9) - F.col(f"l{i}")).alias("d"), F.lit(x).alias("x"))
        mine = scratch.cut(at.select("component", "family", "n", F.array_min(F.array(*(best(i, x) for i, x in enumerate(names))))["x"].alias("split_name")), "placed")
        placed = mine if placed is None else placed.unionByName(mine)
    if placed is None:
        return s.select("sha", "component", F.lit(None).cast("string").alias("split_name"))
    return s.join(placed.select("component", "split_name").hint("merge"), "component").select("sha", "component", "split_name")


def shares_report(assigned: DataFrame, samples: DataFrame, targets: DataFrame) -> DataFrame:
    """family, split_name, records, actual_share, target_share; family null is the whole."""
    fam = samples.select(clean("sha").alias("sha"), clean("family").alias("family")).groupBy("sha").agg(F.max("family").alias("family"))
    n = assigned.join(fam.hint("merge"), "sha").select("split_name", F.coalesce("family", F.lit("(none)")).alias("family")).groupBy("family", "split_name").agg(F.count("*").alias("records"))
    n = n.unionByName(n.groupBy("split_name").agg(F.sum("records").alias("records")).select(F.lit(None).cast("string").alias("family"), "split_name", "records"))
    t = n.groupBy(F.col("family").alias("f")).agg(F.sum("records").alias("all"))
    return n.join(t, F.col("family").eqNullSafe(F.col("f"))).join(targets, "split_name", "left").select("family", "split_name", "records", F.round(F.col("records") / F.col("all"), 6).alias("actual_share"), "target_share")


def fold_keys(samples: DataFrame, manifest: DataFrame) -> DataFrame:
    """sha, fold, key: the groups and contents of manifest rows that are retained and in folds 0-4.

    A key is a hash of a group of the record's samples, or of the content hash of that row. Null keys are none.
    """
    m = manifest.where(F.col("retained") & F.col("fold").between(0, 4)).select(clean("sha").alias("sha"), F.col("fold").cast("int").alias("fold"), clean("disarmed_content_sha256").alias("c")).where(F.col("sha").isNotNull()).distinct()
    g = samples.select(clean("sha").alias("sha"), clean("group_id").alias("g")).where(F.col("g").isNotNull()).distinct()
    by_group = m.select("sha", "fold").distinct().join(g.hint("merge"), "sha").select("sha", "fold", F.concat(F.lit("g"), "g").alias("key"))
    return by_group.unionByName(m.where("c IS NOT NULL").select("sha", "fold", F.concat(F.lit("c"), "c").alias("key")))


def leaks(samples: DataFrame, manifest: DataFrame, scratch: Scratch) -> DataFrame:
    """sha of manifest records whose group or content lies in two or more folds today.

    Keys (groups and contents) that records connect form components, by Hash-to-Min. Each component is given one of
    its folds by rendezvous hashing, weighted by the rows it has there; rows elsewhere are away from the
    fold they should share. A key with a row away, and another at home or away in a further fold, breaks the rule:
    a component may be torn between keys that are each whole, so keys are settled one by one at the end.
    """
    rows = scratch.cut(fold_keys(samples, manifest).select("sha", "fold", F.xxhash64("key").alias("k"), "key").distinct(), "keys")
    # A record's keys are linked to its least key; records with one key link nothing.
    least = rows.groupBy("sha").agg(F.min("k").alias("m"), F.max("k").alias("o")).where("m <> o").select("sha", "m")
    links = rows.select("sha", "k").join(least.hint("merge"), "sha").where("k <> m").select(F.col("k").alias("a"), F.col("m").alias("b")).distinct()
    comp = hash_to_min(links, scratch).withColumnRenamed("vertex", "k")
    # One row a key and fold: a key with a third of all rows is five rows from here on.
    cells = rows.groupBy("k", "key", "fold").agg(F.count("*").alias("n"))
    at = scratch.cut(cells.join(comp.hint("merge"), "k", "left").withColumn("component", F.coalesce("component", "k")), "placed")
    present = at.groupBy("component", "fold").agg(F.sum("n").alias("n"))
    home = present.groupBy("component").agg(F.min_by("fold", F.struct(rendezvous("component", "fold", F.col("n")), "fold")).alias("home"))
    away = F.col("fold") != F.col("home")
    judged = at.join(home.hint("merge"), "component").groupBy("key").agg(F.count_if(~away).alias("stay"), F.min(F.when(away, F.col("fold"))).alias("lo"), F.max(F.when(away, F.col("fold"))).alias("hi"))
    bad = judged.where("lo IS NOT NULL AND (stay > 0 OR lo <> hi)").select("key")
    return rows.select("sha", "key").join(bad.hint("merge"), "key", "left_semi").select("sha").distinct()
