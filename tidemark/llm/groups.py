"""Problem 3: pairwise matches to groups.

The graph's giant component is peeled first: a breadth-first search from the vertex with most links, each
step a join of the frontier with the links. What it reached is taken out by anti-join. The many small components that
remain are labelled by minimum propagation in the form that alternates two steps, each a group-by on the links:
every vertex tells its larger neighbours of the least vertex it knows (large star), then its smaller
neighbours (small star). Distances halve as links move to ever smaller vertices, so a chain of n records takes
about log n rounds and not n. The least vertex that a vertex knows is a partial aggregate joined back, so the links of a
hub spread over tasks; a window over them would put them in one. Joins are sort-merge joins by hint: either side grows
with the links, so none may be built on the driver, and AQE splits the partitions of hubs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import clean, spread_ids
from tidemark.session import Scratch

MAX_BFS = 12


def accepted_links(edges: DataFrame, samples: DataFrame, within: int = 20) -> DataFrame:
    """Distinct links a < b: accepted comparisons, and a record with the representative its group_id names.

    A comparison is accepted if content_equal is true or tlsh_distance <= within; nulls accept nothing. Links with a
    missing end, or of a record with itself, are none.
    """
    e = edges.where(F.col("content_equal") | (F.col("tlsh_distance") <= within)).select(clean("sha_a").alias("x"), clean("sha_b").alias("y"))
    s = samples.select(clean("sha").alias("x"), clean("group_id").alias("y"))
    u = e.unionByName(s).where((F.col("x") != F.col("y")) & (F.col("x") != "") & (F.col("y") != ""))
    return u.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(links: DataFrame, scratch: Scratch, max_rounds: int = 60, max_bfs: int = MAX_BFS) -> DataFrame:
    """vertex, component (the least vertex of the component) for links (a, b) of any comparable type.

    Nulls and links of a vertex with itself are ignored; repeated links count once; no links give no rows. A
    breadth-first search that is not through after max_bfs steps stops there: the part it reached is one
    vertex (its least) to the second phase, so the result is the same.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = scratch.cut(links.distinct(), "links")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    top = both.groupBy("a").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a").limit(1).select(F.col("a").alias("v"))
    frontier = scratch.cut(top, "frontier")
    reached, whole = frontier, False
    for _ in range(max_bfs):
        step = both.join(frontier.withColumnRenamed("v", "a").hint("merge"), "a", "left_semi").select(F.col("b").alias("v")).distinct()
        frontier = scratch.cut(step.join(reached.hint("merge"), "v", "left_anti"), "frontier")
        if frontier.isEmpty():
            whole = True
            break
        reached = reached.unionByName(frontier)
    least = reached.agg(F.min("v")).first()[0]
    giant = reached.withColumn("c", F.lit(least))
    if whole:
        rest = links.join(reached.withColumnRenamed("v", "a").hint("merge"), "a", "left_anti")
    else:
        as_one = lambda df, k: df.join(giant.select(F.col("v").alias(k), F.col("c").alias("_c")).hint("merge"), k, "left").withColumn(k, F.coalesce("_c", k)).drop("_c")
        rest = as_one(as_one(links, "a"), "b")
    small = minimum_labels(rest, scratch, max_rounds)
    if whole:
        return giant.select(F.col("v").alias("vertex"), F.col("c").alias("component")).unionByName(small)
    moved = giant.join(small.select(F.col("vertex").alias("c"), "component").hint("merge"), "c", "left").select(F.col("v").alias("vertex"), F.coalesce("component", "c").alias("component"))
    return moved.unionByName(small.join(moved.select("vertex").hint("merge"), "vertex", "left_anti"))


def minimum_labels(links: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """vertex, component by alternating large and small stars until the links no longer change."""
    now = scratch.cut(_oriented(links), "stars")
    for _ in range(max_rounds):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # Large star: u's larger neighbours go to the least of u and all its neighbours.
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        after = both.where("v > u").join(m.hint("merge"), "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # Small star: u and its smaller neighbours all go to the least of these.
        w = after.groupBy("hi").agg(F.min("lo").alias("m"))
        pairs = after.join(w.hint("merge"), "hi")
        nxt = pairs.select(F.inline(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo"))))).where("hi <> lo").distinct()
        nxt = scratch.cut(nxt, "stars")
        # All stars: no vertex is both a centre and a leaf, and every leaf has one centre.
        many = nxt.groupBy("hi").count().where("count > 1").limit(1)
        chained = nxt.select(F.col("lo").alias("hi")).join(nxt.hint("merge"), "hi", "left_semi").limit(1)
        done = many.select("hi").unionByName(chained).isEmpty()
        scratch.drop(now)
        now = nxt
        if done:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return now.select(F.col("hi").alias("vertex"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("vertex"), F.col("lo").alias("component")).distinct())


def _oriented(links: DataFrame) -> DataFrame:
    return links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()


def found(edges: DataFrame, samples: DataFrame, scratch: Scratch) -> DataFrame:
    """sha, group_sha of every record in a linked group of two or more.

    Records are numbered (dense integers, no hashes that could clash), links go over numbers, and the least sha of
    each component is looked up at the end.
    """
    links = scratch.cut(accepted_links(edges, samples), "accepted")
    ends = links.select(F.col("a").alias("sha")).unionByName(links.select(F.col("b").alias("sha")))
    names = scratch.cut(spread_ids(ends, "sha", "vertex"), "names")
    number = lambda df, k: df.join(names.select(F.col("sha").alias(k), F.col("vertex").alias(f"n{k}")).hint("merge"), k).drop(k)
    labels = components(number(number(links, "a"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b")), scratch)
    rows = scratch.cut(names.join(labels.hint("merge"), "vertex").select("sha", "component"), "labelled")
    least = rows.groupBy("component").agg(F.min("sha").alias("group_sha"))
    return rows.join(least.hint("merge"), "component").select("sha", "group_sha")
