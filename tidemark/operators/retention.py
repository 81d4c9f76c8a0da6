"""Which samples stay: edges between near copies, the earliest earlier match, components and folds.

Decisions are independent of each other (an excluded row stays a reference), so each is an aggregate over the
row's edges, in one parallel pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import windows
from tidemark.functions.digest import PARTS, distance, length_value, pack, usable
from tidemark.functions.keys import clean, instant
from tidemark.operators.ranking import global_rank
from tidemark.session import Scratch, clean_up

#: The distance up to which windows find every pair.
WITHIN = 20
#: Queries of a search that are compared with all rows at a time: about 4 MB.
BLOCK = 20_000
#: Rows that a task of least_distances holds, or a part of all if that is more; its number bounds the copies of a query.
HELD, SHARES = 1 << 17, 64


def inventory(df: DataFrame) -> DataFrame:
    """One row a sample: sha, ts, cls, content, digest, and the packed digest. The earliest delivery wins."""
    d = df.select(clean("sha").alias("sha"), instant("timestamp").alias("ts"), clean("family").alias("cls"), clean("disarmed_content_sha256").alias("content"), usable("tlsh", "tlsh_status").alias("digest"))
    one = d.where("sha IS NOT NULL").groupBy("sha").agg(F.min_by(F.struct("ts", "cls", "content", "digest"), F.struct("ts", F.col("digest").isNull(), "digest")).alias("r")).select("sha", "r.*")
    return one.select("*", *pack(F.col("digest")))


def near_edges(rows: DataFrame, scratch: Scratch, within: int = WITHIN) -> DataFrame:
    """digest_a < digest_b, distance: distinct digests within the distance (at most 20). Digests as from pack, in column digest.

    By windows of 11 or 12 values (see functions.windows): each digest keeps 11 keys and asks for all that lie one step away,
    about 190, so two digests that are not alike meet with a probability of 10^-6 and candidates stay few as tables grow.
    """
    if within > WITHIN:
        raise ValueError(f"windows find all pairs up to distance {WITHIN}")
    d = scratch.cut(rows.where("digest IS NOT NULL").groupBy("digest").agg(*(F.first(p).alias(p) for p in PARTS)), "digests")
    d = d.withColumn("id", F.xxhash64(*PARTS))  # a short key for candidates, which may clash, as digests are compared below
    # Within 10 a window is equal, so there is no need to ask around.
    asked = windows.kept if within <= 10 else windows.asked
    ask = windows.banded(asked(d, ["id", "head"]), "head", 1, False).select("key", F.col("id").alias("x"))
    keep = windows.banded(windows.kept(d, ["id", "head"]), "head", 1, True).select("key", F.col("id").alias("y"))
    # A window one step away is asked for from both ends, so nearly every pair comes twice; a digest also meets itself.
    pairs = ask.join(keep.hint("merge"), "key").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    side = lambda s, k: d.select(F.col("id").alias(k), F.col("digest").alias(f"digest_{s}"), *(F.col(p).alias(f"{s}_{p}") for p in PARTS)).hint("merge")
    both = pairs.join(side("a", "x"), "x").join(side("b", "y"), "y").where("digest_a <> digest_b")
    near = both.select(F.least("digest_a", "digest_b").alias("digest_a"), F.greatest("digest_a", "digest_b").alias("digest_b"), distance(*({p: F.col(f"{s}_{p}") for p in PARTS} for s in ("a", "b"))).alias("distance"))
    return near.where(F.col("distance") <= within).distinct()


def short(c: Column) -> Column:
    """A text as bytes, without loss; 64 lower-case hex digits take 33."""
    return F.when(c.rlike(r"^[0-9a-f]{64}\z"), F.concat(F.lit(b"\x00"), F.unhex(c))).otherwise(F.concat(F.lit(b"\x01"), F.encode(c, "UTF-8")))


def unshort(c: Column) -> Column:
    rest = F.substring(c, 2, 2**31 - 1)
    return F.when(F.substring(c, 1, 1) == F.lit(b"\x00"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def compact(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows as a written table of id (a number), sha and content as bytes, ts, and the packed digest."""
    out = scratch.cut(rows.select(F.monotonically_increasing_id().alias("id"), short(F.col("sha")).alias("sha"), "ts", short(F.col("content")).alias("content"), *PARTS), "rows")
    clean_up(scratch.spark)
    return out


def banded(df: DataFrame, tasks: int = 64) -> DataFrame:
    """band, own and the columns of df: rows that can lie within 20 of each other share a band, and one task has all of a band.

    A band is two length values of 256 in a ring, with the next one's rows as guests (own false): distances up to 20 need
    length values at most 1 apart. Each pair has a band in which at most one is a guest.
    """
    v = length_value(F.col("head"))
    at = lambda d, own: F.struct(F.shiftright((v + d).bitwiseAND(F.lit(255)), 1).alias("band"), F.lit(own).alias("own"))
    both = F.when(v.bitwiseAND(F.lit(1)) == 0, F.array(at(0, True), at(-1, False))).otherwise(F.array(at(0, True)))
    return df.where("head IS NOT NULL").select(F.inline(both), *df.columns).repartition(tasks, "band")


def _by_band(f, schema: str):
    """A function for mapInArrow over banded rows: f(columns of a band as a dict, head, planes) yields dicts of results."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got)
        del got
        bands = t["band"].to_numpy()
        for band in np.unique(bands):
            c = t.take(pa.array(np.flatnonzero(bands == band)))
            planes = [c[p].to_numpy().view(np.uint64) for p in ("h0", "h1", "l0", "l1")]
            for out in f(c, c["head"].to_numpy(), planes):
                yield pa.RecordBatch.from_arrays([out[n] for n in names], names=names)

    return run


def _pairs_of_band(within: int):
    def f(c, head, planes):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from tidemark.functions.nearby import near_pairs

        sha, ts, content = (c[n].combine_chunks() for n in ("sha", "ts", "content"))
        # Equal contents as equal numbers; null, which equals nothing, as a number of its own.
        code = pc.fill_null(content.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        for i, j, d in near_pairs(head, planes, c["own"].to_numpy(), within):
            ok = np.flatnonzero((code[i] != code[j]) | (code[i] < 0))
            if len(ok):
                i, j = pa.array(i[ok]), pa.array(j[ok])
                yield {"sha_a": sha.take(i), "ts_a": ts.take(i), "sha_b": sha.take(j), "ts_b": ts.take(j), "distance": pa.array(d[ok])}

    return f


def pair_edges(rows: DataFrame, scratch: Scratch, within: int = 20) -> DataFrame:
    """earlier, later, distance, content_equal: all pairs with equal content or digests within the distance (at most 20).

    Rows need sha, ts, content and the packed digest. Earlier is by (ts, sha); where a ts is null, by sha. distance is null
    where it exceeds the limit or a digest is missing. Near pairs come from the rows of a band, in one task, and pairs of
    equal content from a join, so no pair comes twice and none is moved; only the rows are.
    """
    if within > WITHIN:
        raise ValueError(f"bands hold all pairs up to distance {WITHIN}")
    t = compact(rows, scratch)
    copied = t.where("content IS NOT NULL").groupBy("content").agg(F.count("*").alias("n")).where("n > 1").select("content")
    copies = scratch.cut(t.join(copied.hint("merge"), "content").select(*t.columns), "copies")
    clean_up(scratch.spark)
    side = lambda s: copies.select("content", *(F.col(c).alias(f"{c}_{s}") for c in ("sha", "ts", *PARTS)))
    d = distance(*({p: F.col(f"{p}_{s}") for p in PARTS} for s in ("a", "b")))
    same = side("a").join(side("b").hint("merge"), "content").where("sha_a < sha_b").select("sha_a", "ts_a", "sha_b", "ts_b", F.when(d <= within, d).cast("int").alias("distance"), F.lit(True).alias("content_equal"))
    schema = "sha_a binary, ts_a timestamp, sha_b binary, ts_b timestamp, distance int"
    near = banded(t.select("sha", "ts", "content", *PARTS)).mapInArrow(_by_band(_pairs_of_band(within), schema), schema)
    both = near.withColumn("content_equal", F.lit(False)).unionByName(same)
    both = both.select(unshort(F.col("sha_a")).alias("sha_a"), "ts_a", unshort(F.col("sha_b")).alias("sha_b"), "ts_b", "distance", "content_equal")
    after = F.when(F.col("ts_a") == F.col("ts_b"), F.col("sha_a") > F.col("sha_b")).otherwise(F.coalesce(F.col("ts_a") > F.col("ts_b"), F.col("sha_a") > F.col("sha_b")))
    return both.select(F.when(after, F.col("sha_b")).otherwise(F.col("sha_a")).alias("earlier"), F.when(after, F.col("sha_a")).otherwise(F.col("sha_b")).alias("later"), "distance", "content_equal")


def _firsts_of_band(thresholds: list[int]):
    def f(c, head, planes):
        import numpy as np
        import pyarrow as pa

        from tidemark.functions.nearby import head_distance, near_first, plane_distance

        rank = np.empty(len(head), np.int64)
        rank[pa.compute.sort_indices(c.select(["ts", "sha"]), sort_keys=[("ts", "ascending"), ("sha", "ascending")], null_placement="at_start").to_numpy()] = np.arange(len(head))
        digest = c["digest"].combine_chunks()
        for k in thresholds:
            j = near_first(head, planes, rank, k)
            i = np.flatnonzero(j != np.arange(len(j)))
            j = j[i]
            d = head_distance(head[i], head[j]) + plane_distance([p[i] for p in planes], [p[j] for p in planes])
            yield {"digest_a": digest.take(pa.array(i)), "digest_b": digest.take(pa.array(j)), "distance": pa.array(d.astype(np.int32))}

    return f


def near_firsts(rows: DataFrame, thresholds: list[int]) -> DataFrame:
    """Those of near_edges that class_decisions needs: per digest and threshold the one to the digest that came first.

    Digests that are near each other in masses give one row each here, and their square in near_edges.
    """
    if max(thresholds) > WITHIN:
        raise ValueError(f"bands hold all pairs up to distance {WITHIN}")
    at = F.min(F.struct("ts", "sha"))
    d = rows.where("digest IS NOT NULL").select("ts", "sha", F.unhex("digest").alias("digest"), *PARTS).groupBy("digest", *PARTS).agg(at.alias("at")).select("digest", *PARTS, "at.ts", "at.sha")
    schema = "digest_a binary, digest_b binary, distance int"
    near = banded(d).mapInArrow(_by_band(_firsts_of_band([k for k in thresholds if k]), schema), schema).distinct()
    a, b = F.hex("digest_a"), F.hex("digest_b")
    return near.select(F.least(a, b).alias("digest_a"), F.greatest(a, b).alias("digest_b"), "distance").distinct()


def decisions(targets: DataFrame, references: DataFrame, edges: DataFrame, thresholds: list[int], exact_first: bool = True, train_stage: Column | None = None) -> DataFrame:
    """sha, threshold, decision, reason, reference_sha, tlsh_distance for every target and threshold.

    A target is excluded if an earlier row (a reference or another target, excluded or not) has equal content or lies
    within the threshold. The witness is the earliest such row by (ts, sha): with exact_first among exact copies if there
    are any, else over both kinds. train_stage: rows for which it holds are excluded by exact copies only.
    """
    order = references.select(F.col("sha").alias("earlier"), F.col("ts").alias("_ets")).unionByName(targets.select(F.col("sha").alias("earlier"), F.col("ts").alias("_ets"))).distinct()
    t = targets.select("sha", (F.lit(False) if train_stage is None else train_stage).alias("_train"))
    hit = edges.join(order.hint("merge"), "earlier").withColumnRenamed("later", "sha").join(t.hint("merge"), "sha")
    rank = F.struct((~F.col("content_equal") if exact_first else F.lit(False)).alias("a"), F.col("_ets").alias("b"), F.col("earlier").alias("c"))
    counts = lambda k: F.col("content_equal") | ((F.col("distance") <= k) & ~F.col("_train"))
    # All thresholds in one pass over the edges.
    w = hit.groupBy("sha").agg(*(F.min_by(F.when(counts(k), F.struct("earlier", "content_equal", "distance")), F.when(counts(k), rank)).alias(f"w{k}") for k in thresholds))
    return _decided(t.select("sha").join(w.hint("merge"), "sha", "left"), thresholds)


def _decided(df: DataFrame, thresholds: list[int]) -> DataFrame:
    """The rows of decisions from columns w0, w10, ...: struct(earlier, content_equal, distance) of the witness, or null."""
    each = df.select("sha", F.inline(F.array(*(F.struct(F.lit(k).alias("threshold"), F.col(f"w{k}").alias("w")) for k in thresholds))))
    return each.select(
        "sha", "threshold", F.when(F.col("w").isNull(), "KEEP").otherwise("EXCLUDE").alias("decision"),
        F.when(F.col("w").isNull(), "no_earlier_match").when(F.col("w.content_equal"), "exact_sha256").otherwise("tlsh").alias("reason"),
        F.coalesce(F.col("w.earlier"), F.lit("")).alias("reference_sha"), F.when(~F.col("w.content_equal"), F.col("w.distance")).alias("tlsh_distance"),
    )


def class_decisions(rows: DataFrame, near: DataFrame, thresholds: list[int], exact_first: bool = True, train_stage: Column | None = None) -> DataFrame:
    """What decisions() gives for rows as targets and references, from near_edges and without the pairs of copies.

    The witness is the earliest row (ts, sha) of a class, so a content or digest that a third of the rows share is one
    aggregate and not its square: of equal contents the earliest, of digests within the threshold the earliest of
    each one's earliest. A row is excluded if that is earlier than itself. A null ts is the earliest.
    """
    me = F.struct("ts", "sha")
    mine = rows.select("sha", "content", "digest", me.alias("at"), (F.lit(False) if train_stage is None else train_stage).alias("_train"))
    copies = mine.where("content IS NOT NULL").groupBy("content").agg(F.min("at").alias("c_at"))
    firsts = mine.where("digest IS NOT NULL").groupBy("digest").agg(F.min("at").alias("d_at"))
    ends = lambda a, b: near.select(F.col(a).alias("to"), F.col(b).alias("digest"), "distance")
    reach = ends("digest_a", "digest_b").unionByName(ends("digest_b", "digest_a")).join(firsts.hint("merge"), "digest").select("to", "d_at", "distance")
    reach = reach.unionByName(firsts.select(F.col("digest").alias("to"), "d_at", F.lit(0).alias("distance")))
    best = reach.groupBy(F.col("to").alias("digest")).agg(*(F.min(F.when(F.col("distance") <= k, F.struct("d_at", "distance"))).alias(f"n{k}") for k in thresholds))
    j = mine.join(copies.hint("merge"), "content", "left").join(best.hint("merge"), "digest", "left")

    def witness(k: int) -> Column:
        exact = F.when(F.col("c_at") < F.col("at"), F.struct(F.col("c_at.sha").alias("earlier"), F.lit(True).alias("content_equal"), F.lit(None).cast("int").alias("distance")))
        alike = F.when((F.col(f"n{k}.d_at") < F.col("at")) & ~F.col("_train"), F.struct(F.col(f"n{k}.d_at.sha").alias("earlier"), F.lit(False).alias("content_equal"), F.col(f"n{k}.distance").cast("int").alias("distance")))
        if exact_first:
            return F.coalesce(exact, alike)
        # The earlier of the two; one row that is both is an exact copy.
        return F.when(exact.isNotNull() & (alike.isNull() | (F.col("c_at") <= F.col(f"n{k}.d_at"))), exact).otherwise(alike)

    return _decided(j.select("sha", *(witness(k).alias(f"w{k}") for k in thresholds)), thresholds)


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """vertex, component: the least vertex reached over edges (a, b). Alternating large and small stars.

    Vertices are compared as they are, so a caller who wants the earliest member as root passes ordered keys.
    """
    now = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    least = lambda df, k: df.join(df.groupBy(k).agg(F.min("v").alias("m")).hint("merge"), k)
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
    before = mark(now)
    for _ in range(max_rounds):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        large = least(both, "u").select(F.col("v").alias("hi"), F.least("m", "u").alias("lo"), "u").where("v > u AND hi <> lo").select("hi", "lo").distinct()
        small = least(large.select(F.col("hi").alias("u"), F.col("lo").alias("v")), "u")
        nxt = small.select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionByName(small.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).where("hi <> lo").distinct()
        nxt = scratch.cut(nxt, "edges")
        marked = mark(nxt)
        scratch.drop(now)
        now, same, before = nxt, marked == before, marked
        if same:
            return now.select(F.col("hi").alias("vertex"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("vertex"), F.col("lo").alias("component")).distinct())
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def group_members(rows: DataFrame, edges: DataFrame, scratch: Scratch, threshold: int) -> DataFrame:
    """rows with group_id: the earliest member (ts, sha) of the component over edges inside rows.

    An edge with an end outside rows joins nothing: outsiders are no bridges. A row without edges is its own group.
    """
    ids = rows.select("sha", _order_key().alias("k"))
    inside = edges.where(F.col("content_equal") | (F.col("distance") <= threshold))
    e = inside.join(ids.select(F.col("sha").alias("earlier"), F.col("k").alias("a")).hint("merge"), "earlier").join(ids.select(F.col("sha").alias("later"), F.col("k").alias("b")).hint("merge"), "later").select("a", "b")
    c = components(e, scratch).withColumnRenamed("vertex", "k")
    named = ids.join(c.hint("merge"), "k", "left").select("sha", F.substring_index(F.coalesce("component", "k"), "|", -1).alias("group_id"))
    return rows.join(named.hint("merge"), "sha")


def _order_key() -> Column:
    """Text that sorts as (ts, sha), a null ts first, and ends in the sha."""
    return F.concat(F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("")), F.lit("|"), "sha")


def class_groups(rows: DataFrame, near: DataFrame, scratch: Scratch, threshold: int) -> DataFrame:
    """What group_members() gives over all pairs within the threshold or of equal content, from near_edges.

    Every row is linked to the earliest row of its content and of its digest, and these of two near digests to each other: one
    link a row and class pair instead of the square of a class. Only digests of rows count, so outsiders are no bridges.
    """
    ids = rows.select("sha", _order_key().alias("k"), "content", "digest")
    first = lambda c: ids.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("k").alias("b"))
    digests = first("digest")
    links = [ids.join(first("content").hint("merge"), "content").select(F.col("k").alias("a"), "b"), ids.join(digests.hint("merge"), "digest").select(F.col("k").alias("a"), "b")]
    of = lambda s, to: digests.select(F.col("digest").alias(f"digest_{s}"), F.col("b").alias(to)).hint("merge")
    links.append(near.where(F.col("distance") <= threshold).join(of("a", "a"), "digest_a").join(of("b", "b"), "digest_b").select("a", "b"))
    c = components(links[0].unionByName(links[1]).unionByName(links[2]), scratch).withColumnRenamed("vertex", "k")
    named = ids.join(c.hint("merge"), "k", "left").select("sha", F.substring_index(F.coalesce("component", "k"), "|", -1).alias("group_id"))
    return rows.join(named.hint("merge"), "sha")


def _sets_of_band(scopes: list[tuple[int, int]]):
    def f(c, head, planes):
        import numpy as np
        import pyarrow as pa

        from tidemark.functions.nearby import near_sets

        known = {}
        for n, (flag, k) in sorted(enumerate(scopes), key=lambda x: x[1]):
            if not k:
                continue
            first = c[f"f{flag}"].to_numpy()  # the row that stands for the digest in this part, or nan
            at = np.flatnonzero(~np.isnan(first)) if first.dtype.kind == "f" else np.arange(len(first))
            label = known[flag] = near_sets(head[at], [p[at] for p in planes], k, known.get(flag))
            i = np.flatnonzero(label != np.arange(len(label)))
            ids = c[f"f{flag}"].combine_chunks()
            yield {"scope": pa.array(np.full(len(i), n, np.int32)), "a": ids.take(pa.array(at[i])), "b": ids.take(pa.array(at[label[i]]))}

    return f


def grouped_rows(rows: DataFrame, scratch: Scratch, scopes: list[tuple[str, Column, int]]) -> DataFrame:
    """The compact rows with g0, g1, ...: the group that class_groups gives in each scope (name, which rows, threshold), as short bytes.

    All scopes go through one round of components together, over numbers. Rows of equal content or digest are linked to one of
    them, and near digests within a band's task to one of those that they reach, so links are at most three a row.
    """
    if max(k for _, _, k in scopes) > WITHIN:
        raise ValueError(f"bands hold all pairs up to distance {WITHIN}")
    kinds = list(dict.fromkeys(n for n, _, _ in scopes))
    which = {n: c for n, c, _ in scopes}
    parts = [(kinds.index(n), k) for n, _, k in scopes]
    t = compact(rows, scratch)
    t = t.select("*", *(F.when(which[n], F.col("id")).alias(f"i{x}") for x, n in enumerate(kinds)))
    firsts = [F.min(f"i{x}").alias(f"f{x}") for x in range(len(kinds))]
    links = []

    def starred(by: list[str], table: DataFrame) -> DataFrame:
        """Each row with the first of its class, by kind of scope."""
        each = F.array(*(F.struct(F.lit(n).alias("scope"), F.col(f"i{x}").alias("a"), F.col(f"f{x}").alias("b")) for n, (x, _) in enumerate(parts)))
        return t.select(*by, *(f"i{x}" for x in range(len(kinds)))).join(table.hint("merge"), by).select(F.inline(each)).where("a <> b")

    for by in (["content"], list(PARTS)):
        classes = t.where(F.col(by[0]).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), *firsts)
        if len(by) > 1:
            classes = scratch.cut(classes, "digests")
            schema = "scope int, a long, b long"
            near = banded(classes.drop("n")).mapInArrow(_by_band(_sets_of_band(parts), schema), schema)
            links.append(scratch.cut(near, "links"))
        links.append(scratch.cut(starred(by, classes.where("n > 1").drop("n")), "links"))
        clean_up(scratch.spark)
    # A number of row and scope in one: there are far fewer than 2^58 rows.
    at = lambda c: F.col(c) * len(parts) + F.col("scope")
    found = components(scratch.tables(links).select(at("a").alias("a"), at("b").alias("b")), scratch)
    found = found.select(F.expr(f"vertex div {len(parts)}").alias("id"), F.pmod("vertex", F.lit(len(parts))).cast("int").alias("scope"), "component")
    named = scratch.cut(found.join(t.select("id", "ts", "sha").hint("merge"), "id"), "members")
    roots = named.groupBy("component").agg(F.min(F.struct("ts", "sha")).alias("r"))
    named = named.join(roots.hint("merge"), "component").select("id", "scope", F.col("r.sha").alias("root"))
    wide = named.groupBy("id").agg(*(F.max(F.when(F.col("scope") == n, F.col("root"))).alias(f"r{n}") for n in range(len(parts))))
    g = (F.when(F.col(f"i{x}").isNotNull(), F.coalesce(f"r{n}", "sha")).alias(f"g{n}") for n, (x, _) in enumerate(parts))
    return t.join(wide.hint("merge"), "id", "left").select("id", "sha", "ts", "content", *PARTS, *g)


def scoped_groups(rows: DataFrame, scratch: Scratch, scopes: list[tuple[str, Column, int]]) -> DataFrame:
    """scope (the number in the list), sha, group_id for every scope and each of its rows; see grouped_rows."""
    each = F.filter(F.array(*(F.struct(F.lit(n).alias("scope"), F.col(f"g{n}").alias("g")) for n in range(len(scopes)))), lambda e: e["g"].isNotNull())
    return grouped_rows(rows, scratch, scopes).select("sha", F.inline(each)).select("scope", unshort(F.col("sha")).alias("sha"), unshort(F.col("g")).alias("group_id"))


def nearest_neighbours(queries: DataFrame, rows: DataFrame, scratch: Scratch, within: int | None = None) -> DataFrame:
    """Per query: least distance to any other sample, ties, ties of the same and of another class, least sha among them.

    Exhaustive by definition; the queries, a stated set, go to every task of `rows` in blocks of about BLOCK. A task has the
    rows in the order of their length values and leaves out only those of which a part alone is farther than the best so far.
    within: queries whose nearest sample is farther are left out, which spares the search for it.
    """
    q, r = (x.where("digest IS NOT NULL").select("sha", "cls", "digest") for x in (queries, rows))
    q = scratch.cut(q, "queries")
    blocks = max(1, -(-q.count() // BLOCK))
    r = scratch.cut(r, "searched") if blocks > 1 else r
    clean_up(scratch.spark)
    out = None
    schema = "sha string, d int, ties long, same_class long, nearest_sha string"
    for i in range(blocks):
        mine = scratch.spark.sparkContext.broadcast(q.where(F.pmod(F.xxhash64("sha"), F.lit(blocks)) == i).toArrow())
        d = r.mapInArrow(_nearest_of_part(mine, within), schema)
        per = d.groupBy("sha", "d").agg(F.sum("ties").alias("ties"), F.sum("same_class").alias("same_class"), F.min("nearest_sha").alias("nearest_sha"))
        best = per.groupBy("sha").agg(F.min_by(F.struct("ties", "same_class", "nearest_sha"), "d").alias("b"), F.min("d").alias("distance"))
        got = best.select("sha", "distance", "b.ties", "b.same_class", (F.col("b.ties") - F.col("b.same_class")).alias("other_class"), "b.nearest_sha")
        got = scratch.cut(got, "nearest") if blocks > 1 else got
        out = got if out is None else out.unionByName(got)
    return out


def _nearest_of_part(queries, within):
    def run(batches):
        import pyarrow as pa

        from tidemark.functions.nearby import nearest, pack

        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        q = queries.value
        keys = pa.concat_arrays([c.cast(pa.string()) for t in (q, pa.Table.from_batches(got)) for c in t["cls"].chunks]).dictionary_encode().indices
        t = pa.Table.from_batches(got).combine_chunks()
        code = pa.compute.fill_null(keys, -1).to_numpy(zero_copy_only=False)
        # Where a query is among the rows itself, by its place.
        itself = pa.compute.index_in(t["sha"], value_set=q["sha"].combine_chunks()).combine_chunks()
        i, d, near = nearest(*pack(q["digest"]), *pack(t["digest"]), {int(itself[j].as_py()): j for j in pa.compute.indices_nonzero(itself.is_valid()).to_pylist()}, within)
        out = {"sha": [], "d": [], "ties": [], "same_class": [], "nearest_sha": []}
        n = q.num_rows
        for a, b, j in zip(i, d, near):
            own = code[a]
            for k, v in zip(out, (q["sha"][a].as_py(), b, len(j), int((code[n + j] == own).sum()) if own >= 0 else 0, min(t["sha"].take(pa.array(j)).to_pylist()))):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, {"d": pa.int32(), "ties": pa.int64(), "same_class": pa.int64()}.get(k, pa.string())) for k, v in out.items()], names=list(out))

    return run


def least_distances(queries: DataFrame, rows: DataFrame, scratch: Scratch, within: int) -> DataFrame:
    """distance, n: least distances of queries to any other sample, as far as they are at most `within`, and how many queries share one.

    Equal digests are compared once. Rows are laid out by length value, a task has those of one (of many rows, a part), and
    a query goes to all length values within the distance. No row that can be within it is left out, so the distances are
    exact; the work grows with queries times rows, of which length value and ratios leave a few per cent.
    """
    value = F.conv(F.concat(F.substring("digest", 4, 1), F.substring("digest", 3, 1)), 16, 10).cast("int").alias("v")
    q, r = (x.where("digest IS NOT NULL").select(short(F.col("sha")).alias("sha"), F.unhex("digest").alias("b"), value) for x in (queries, rows))
    r = scratch.cut(r.groupBy("b", "v").agg(F.count("*").alias("m"), F.min("sha").alias("sha")), "classes")
    # A digest that only the query's own sample has is no answer to it.
    alone = r.where("m = 1").select("sha", F.col("b").alias("skip"))
    q = q.join(alone.hint("merge"), "sha", "left").groupBy("b", "v", "skip").agg(F.count("*").alias("n"))
    sizes = {x["v"]: x["count"] for x in r.groupBy("v").count().collect()}
    most = max(HELD, -(-sum(sizes.values()) // SHARES))
    cells = [(v, n) for v in sorted(sizes, key=sizes.get, reverse=True) for n in range(-(-sizes[v] // most))]  # the largest begin
    of = {v: [c for c, (x, _) in enumerate(cells) if x == v] for v in sizes}
    from tidemark.functions.nearby import LENGTHS

    to = {v: [c for c, (x, _) in enumerate(cells) if LENGTHS[v, x] <= within] for v in range(256)}
    places = F.broadcast(scratch.spark.createDataFrame([(v, of.get(v, []), to[v]) for v in range(256)], "v int, own array<int>, near array<int>"))
    held = r.join(places, "v").select(F.element_at("own", (F.pmod(F.xxhash64("b"), F.size("own")) + 1).cast("int")).alias("cell"), "b", F.lit(None).cast("binary").alias("skip"), F.lit(0).cast("long").alias("n"))
    asked = q.join(places, "v").select(F.explode("near").alias("cell"), "b", "skip", "n")
    clean_up(scratch.spark)
    laid = held.unionByName(asked).repartitionById(max(1, len(cells)), F.col("cell")).select("b", "skip", "n")
    found = laid.mapInArrow(_least_of_cell(within), "b binary, skip binary, n long, d int")
    return found.groupBy("b", "skip").agg(F.min("d").alias("distance"), F.first("n").alias("n")).select("distance", "n")


def _least_of_cell(within):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        from tidemark.functions.nearby import least, pack_bytes

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        del got
        asks = pc.greater(t["n"], 0)
        q, r = (t.filter(x).combine_chunks() for x in (asks, pc.invert(asks)))
        del t
        if not q.num_rows or not r.num_rows:
            return
        skip = pc.index_in(q["skip"], value_set=r["b"].combine_chunks(), skip_nulls=True).combine_chunks()
        d = least(*pack_bytes(q["b"]), *pack_bytes(r["b"]), pc.fill_null(skip, -1).to_numpy(zero_copy_only=False), within)
        ok = pa.array(d <= within)
        yield from q.append_column("d", pa.array(d)).filter(ok).to_batches()

    return run


def cumulative_cutoffs(nearest: DataFrame, cutoffs: list[int], n: str | None = None) -> DataFrame:
    """cutoff, n: how many nearest distances are at most each cutoff. n: the column of how many a row stands for."""
    each = F.lit(1) if n is None else F.col(n)
    sums = nearest.agg(*(F.coalesce(F.sum(F.when(F.col("distance") <= c, each)), F.lit(0)).cast("long").alias(str(c)) for c in cutoffs))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(c).alias("cutoff"), F.col(str(c)).alias("n")) for c in cutoffs))))


def assign_folds(members: DataFrame, group: str, cls: str, folds: int = 5) -> DataFrame:
    """group, fold: greedy class-stratified folds of whole groups.

    Groups go in the order of (largest class share, size, id); the first ones seed the folds; each other goes where
    the squared deviations of class and size shares from 1/folds are least (ties: smaller, then lower fold). The order
    makes it sequential, so one task handles the group-by-class counts, not the samples.
    """
    counts = members.groupBy(group, cls).agg(F.count("*").alias("n"))

    def greedy(pdf):
        import numpy as np

        # Only the classes a group has are kept: a matrix of groups by classes would be nearly all zeros.
        names, g = np.unique(pdf[group].to_numpy(), return_inverse=True)
        classes, c = np.unique(pdf[cls].to_numpy(), return_inverse=True)
        n = pdf["n"].to_numpy(float)
        totals = np.maximum(np.bincount(c, n, len(classes)), 1)
        size = np.bincount(g, n, len(names))
        most = np.zeros(len(names))
        np.maximum.at(most, g, n / totals[c])
        by = np.argsort(g, kind="stable")
        starts = np.searchsorted(g[by], np.arange(len(names) + 1)).tolist()
        c, n, totals, whole, ideal = c[by].tolist(), n[by].tolist(), totals.tolist(), float(size.sum()), 1 / folds
        share, held, fold = [[0.0] * len(classes) for _ in range(folds)], [0.0] * folds, np.zeros(len(names), np.int32)
        sizes = size.tolist()
        for i, x in enumerate(np.lexsort((np.arange(len(names)), -size, -most)).tolist()):
            mine = [(c[k], n[k], totals[c[k]]) for k in range(starts[x], starts[x + 1])]
            best = (i,)
            if i >= folds:
                # The cost of fold f differs from the common sum by f's own terms in the group's classes only.
                best = []
                for f in range(folds):
                    own = share[f]
                    cost = ((held[f] + sizes[x]) / whole - ideal) ** 2 - (held[f] / whole - ideal) ** 2
                    for k, m, total in mine:
                        cost += ((own[k] + m) / total - ideal) ** 2 - (own[k] / total - ideal) ** 2
                    best.append((round(cost, 12), held[f], f))
                best = min(best)
            f = best[-1]
            for k, m, _ in mine:
                share[f][k] += m
            held[f] += sizes[x]
            fold[x] = f
        return __import__("pandas").DataFrame({group: names, "fold": fold})

    kind = members.schema[group].dataType.simpleString()
    return counts.where(F.col(group).isNotNull() & F.col(cls).isNotNull()).withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(greedy, f"`{group}` {kind}, fold int")


def two_sides(members: DataFrame, month: str, group: str, cls: str) -> DataFrame:
    """month, group, side: per month a greedy split of whole groups in two with like class counts; one task a month's counts."""
    counts = members.groupBy(month, group, cls).agg(F.count("*").alias("n"))

    def greedy(pdf):
        import numpy as np

        m = pdf.pivot_table(index=group, columns=cls, values="n", fill_value=0).sort_index()
        c, names = m.to_numpy(float), list(m.index)
        total, sides, out = c.sum(0), np.zeros((2, c.shape[1])), []
        for g in sorted(range(len(names)), key=lambda g: (-float((c[g] / total).sum()), names[g])):
            costs = [float(np.square((sides[0] - sides[1] + s * c[g]) / total).sum()) for s in (1, -1)]
            side = int(np.argmin(costs))
            sides[side] += c[g]
            out.append((pdf[month].iloc[0], names[g], side))
        return __import__("pandas").DataFrame(out, columns=[month, group, "side"])

    t = {x: members.schema[x].dataType.simpleString() for x in (month, group)}
    return counts.groupBy(month).applyInPandas(greedy, f"`{month}` {t[month]}, `{group}` {t[group]}, side int")


def partition_check(grouped: DataFrame, edges: DataFrame, threshold: int) -> DataFrame:
    """One row: members, groups, largest, links, broken_links (between groups), lonely (members of a group of several without a link).

    grouped: sha, group_id; edges as from pair_edges. Independent of how groups were made: it only joins both ends.
    """
    end = lambda k, g: grouped.select(F.col("sha").alias(k), F.col("group_id").alias(g)).hint("merge")
    links = edges.where(F.col("content_equal") | (F.col("distance") <= threshold)).join(end("earlier", "g"), "earlier").join(end("later", "h"), "later")
    linked = links.select(F.col("earlier").alias("sha")).unionByName(links.select(F.col("later").alias("sha"))).distinct()
    sizes = grouped.groupBy("group_id").agg(F.count("*").alias("n"))
    lonely = grouped.join(sizes.where("n > 1").hint("merge"), "group_id").join(linked.hint("merge"), "sha", "left_anti")
    one = [sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.count("*").alias("groups"), F.coalesce(F.max("n"), F.lit(0)).alias("largest")), links.agg(F.count("*").alias("links"), F.count_if(F.col("g") != F.col("h")).alias("broken_links")), lonely.agg(F.count("*").alias("lonely"))]
    return one[0].crossJoin(F.broadcast(one[1])).crossJoin(F.broadcast(one[2])).select(F.lit(threshold).alias("threshold"), "*")  # one row each


def _links_of_band(thresholds: list[int]):
    def f(c, head, planes):
        import numpy as np
        import pyarrow as pa

        from tidemark.functions.nearby import near_pairs

        code = lambda n: pa.compute.fill_null(c[n].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        content, groups = code("content"), [code(f"g{x}") for x in range(len(thresholds))]
        n, ids = c["n"].to_numpy(), c["id"].combine_chunks()
        sums, linked = np.zeros((2, len(thresholds)), np.int64), np.zeros((len(thresholds), len(head)), bool)
        for i, j, d in near_pairs(head, planes, c["own"].to_numpy(), max(thresholds)):
            ok = np.flatnonzero((content[i] != content[j]) | (content[i] < 0))
            i, j, d = i[ok], j[ok], d[ok]
            pairs = n[i] * n[j]
            for x, k in enumerate(thresholds):
                ok = d <= k
                sums[0, x] += pairs[ok].sum()
                sums[1, x] += pairs[ok & (groups[x][i] != groups[x][j])].sum()
                linked[x, i[ok]] = linked[x, j[ok]] = True
        for x in range(len(thresholds)):
            at = np.flatnonzero(linked[x])
            of = lambda v, first: pa.array(np.r_[first, np.zeros(len(at), np.int64)] if first is not None else np.full(len(at) + 1, v, np.int32))
            yield {"x": of(x, None), "id": pa.concat_arrays([pa.array([None], pa.int64()), ids.take(pa.array(at))]), "links": of(0, sums[0, x]), "broken": of(0, sums[1, x])}

    return f


def grouped_check(grouped: DataFrame, thresholds: list[int], scratch: Scratch) -> DataFrame:
    """What partition_check gives over all pairs for g0, g1, ... of grouped_rows, a row a threshold, without writing the pairs.

    Pairs are counted where they are met. Rows alike in content, digest and groups are one class with a count, so are pairs of them.
    """
    g = [f"g{x}" for x in range(len(thresholds))]
    c = scratch.cut(grouped.groupBy("content", *PARTS, *g).agg(F.count("*").alias("n"), F.min("id").alias("id")), "classes")
    clean_up(scratch.spark)
    schema = "x int, id long, links long, broken long"
    near = scratch.cut(banded(c).mapInArrow(_by_band(_links_of_band(thresholds), schema), schema), "near")
    pairs = lambda n: F.expr(f"{n} * ({n} - 1) div 2")
    # Rows without content and of one digest are a class of links at distance 0; equal contents are linked in any case.
    alone = c.where("content IS NULL AND head IS NOT NULL AND n > 1").select("id", pairs("n").alias("links")).agg(F.coalesce(F.sum("links"), F.lit(0)).alias("links"))
    copies = c.where("content IS NOT NULL").groupBy("content").agg(F.sum("n").alias("all")).where("`all` > 1")
    same = scratch.cut(c.join(copies.hint("merge"), "content").select(*c.columns, "all"), "copies")
    out = None
    for x, k in enumerate(thresholds):
        inside = same.groupBy("content", g[x], "all").agg(F.sum("n").alias("m"))
        per = inside.groupBy("content", "all").agg(F.sum(pairs("m")).alias("inner")).select(pairs("`all`").alias("p"), "inner")
        by_content = per.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("cp"), F.coalesce(F.sum(F.col("p") - F.col("inner")), F.lit(0)).alias("cb"))
        met = near.where(F.col("x") == x).agg(F.coalesce(F.sum("links"), F.lit(0)).alias("np"), F.coalesce(F.sum("broken"), F.lit(0)).alias("nb"))
        linked = near.where((F.col("x") == x) & F.col("id").isNotNull()).select("id").unionByName(same.select("id")).unionByName(c.where("content IS NULL AND head IS NOT NULL AND n > 1").select("id")).distinct()
        sizes = c.groupBy(g[x]).agg(F.sum("n").alias("size"))
        lonely = c.select("id", "n", g[x]).join(linked.hint("merge"), "id", "left_anti").join(sizes.where("size > 1").hint("merge"), g[x]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lonely"))
        one = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("members"), F.count("*").alias("groups"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"))
        for row in (by_content, met, alone, lonely):  # one row each
            one = one.crossJoin(F.broadcast(row))
        row = one.select(F.lit(k).alias("threshold"), "members", "groups", "largest", (F.col("cp") + F.col("np") + F.col("links")).alias("links"), (F.col("cb") + F.col("nb")).alias("broken_links"), "lonely")
        out = row if out is None else out.unionByName(row)
    return out


def numbered(df: DataFrame, root: str, prefix: str, scratch: Scratch, out: str = "group_no") -> DataFrame:
    """Adds names like F000001, numbered by the order of roots."""
    roots = global_rank(df.select(root).distinct(), [root], scratch).select(root, F.format_string(prefix + "%06d", F.col("rank_index") + 1).alias(out))
    return df.join(roots, root)
