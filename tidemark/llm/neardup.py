"""Problem 5: near-duplicate records with small edits.

Fast similarity sketching (Dahlgaard, Knudsen and Thorup 2017). A digest is the set of its 128 (place, value) tokens.
In each of the first T rounds every token is hashed to a bin and a value; bin b keeps the token of the least
(round, value). In round T + b every token falls into bin b, so no bin stays empty; with 128 tokens all bins are full
after about T ln T / 128 rounds. A coordinate of two sketches agrees with the Jaccard similarity of the sets, and
the agreements are concentrated as for independent ones.

Rounds and hashes are fixed, and there are 512 tokens, so the order in which a bin would accept tokens is a list made
once; a sketch takes, for each bin, the first token of its list that the set holds.

Banding: bands of some coordinates each. Distance 30 leaves at least 98 of 128 tokens equal, a similarity of 98/158; whatever
the layout, there are as many bands as miss such a pair with probability MISS at most, and closer pairs far less. How
many coordinates a band has follows the number of digests (layout): longer bands let fewer strangers meet, whose number
grows with the square, at more rows a digest. Bands go in passes of PER_PASS, each of which shuffles a bounded multiple of
the digests and frees it. Pairs that share a band are held against each other on one of their two halves first, and
verified on the whole digests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.digest import LOWER, PARTS, UPPER, distance, length_value, plane_distance
from tidemark.llm.records import CLASS, fingerprints, of_class, ordered_pairs, sides, whole
from tidemark.session import Scratch, clean_up

WITHIN = 30
MISS = 4e-5
TOKENS = 512
PER_PASS = 24
SEED = 1
#: Rows of a pass in a task, which a hash table of about 40 MB holds.
PER_TASK = 500_000
#: Similarity of two digests at distance 30, and of two that have nothing to do with each other.
ALIKE, STRANGERS = 98 / 158, 32 / 224


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def layout(n: int, meet: float, miss: float = MISS) -> tuple[int, int]:
    """(bands, coordinates a band) for n digests, of which two fall into one zone with probability `meet`.

    The cheapest of those that keep the probability of a miss: a band costs a row a digest, which is made, shuffled and
    hashed; a pair of strangers that share one costs about a seventh of that, as it is only compared.
    """

    def bands(rows: int) -> int:
        return math.ceil(math.log(miss) / math.log1p(-(ALIKE**rows)))

    def cost(rows: int) -> float:
        return bands(rows) * (1 + 0.15 * n * meet * STRANGERS**rows)

    rows = min(range(3, 15), key=cost)
    return bands(rows), rows


@lru_cache(maxsize=4)
def bin_lists(size: int, start: int = 0, stop: int | None = None, tokens: int = TOKENS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """For each bin from start to stop its tokens in the order of (round, value), as arrays (bin, depth) of tokens and rounds.

    All rounds: those before T = size, in which a bin gets some of the tokens, and round T + bin with every token, which
    ends a list. Shorter lists are filled up with their last entry.
    """
    stop = size if stop is None else stop
    t = np.arange(tokens, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    value = lambda r: mix(t[None, :] + ((np.uint64(seed) << np.uint64(32)) + np.asarray(r, np.uint64) + np.uint64(1))[:, None])
    found = []
    for r0 in range(0, size, 1024):
        rounds = np.arange(r0, min(size, r0 + 1024))
        h = value(rounds)
        bins = (h % np.uint64(size)).astype(np.int64)
        at, tok = np.nonzero((bins >= start) & (bins < stop))
        found.append((bins[at, tok] - start, rounds[at], h[at, tok] >> np.uint64(20), tok))
    last = np.arange(start, stop)
    h = value(size + last)
    found.append((np.repeat(last - start, tokens), np.repeat(size + last, tokens), (h >> np.uint64(20)).ravel(), np.tile(np.arange(tokens), len(last))))
    bins, rounds, values, toks = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((values, rounds, bins))
    bins, rounds, toks = bins[order], rounds[order], toks[order]
    counts = np.bincount(bins, minlength=len(last))
    ends = np.cumsum(counts)
    at = np.minimum(np.arange(counts.max())[None, :] + (ends - counts)[:, None], ends[:, None] - 1)
    return toks[at], rounds[at]


def sketch(present: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(n, bins) sketch of (n, tokens) membership rows: round * tokens + token of the winner of each bin.

    The first eight tokens of all lists are looked up together, as the bytes of one word a bin; nine bins of ten are settled
    by its lowest byte that is set. The others go on token by token.
    """
    tokens, rounds = lists
    n, bins = len(present), len(tokens)
    winner = rounds * TOKENS + tokens
    words = np.take(present, tokens[:, :8].ravel(), axis=1).reshape(n, bins, 8).view("<u8")[:, :, 0]
    low = words & (~words + np.uint64(1))
    at = (np.frexp(low.astype(np.float64))[1] - 1) >> 3
    out = winner[np.arange(bins), np.maximum(at, 0)]
    open_row, open_bin = np.nonzero(words == 0)
    for depth in range(8, tokens.shape[1]):
        if not len(open_row):
            break
        hit = present[open_row, tokens[open_bin, depth]]
        out[open_row[hit], open_bin[hit]] = winner[open_bin[hit], depth]
        open_row, open_bin = open_row[~hit], open_bin[~hit]
    return out


def band_keys(words: np.ndarray, lists: tuple[np.ndarray, np.ndarray], first: int, rows: int) -> np.ndarray:
    """(n, bands) 64-bit keys of (n, 4) words h0, h1, l0, l1 of digests; first: the number of the first band in the lists."""
    shifts = np.arange(63, -1, -1, dtype=np.uint64)
    planes = ((words.astype(np.uint64)[:, :, None] >> shifts) & np.uint64(1)).reshape(len(words), 2, 128).astype(np.int64)
    crumbs = 2 * planes[:, 0] + planes[:, 1]
    present = np.zeros((len(words), TOKENS), bool)
    np.put_along_axis(present, crumbs + 4 * np.arange(128), True, axis=1)
    bands = len(lists[0]) // rows
    s = sketch(present, lists).reshape(len(words), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(first + 1, first + bands + 1, dtype=np.uint64), (len(words), bands))
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r] + np.uint64(1))
    return key.astype(np.int64)


def with_bands(digests: DataFrame, bands: int, rows: int, start: int, stop: int) -> DataFrame:
    """CLASS and bands (array of keys), for the bands from start to stop of a layout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = bin_lists(bands * rows, start * rows, stop * rows)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                w = np.stack([part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (*UPPER, *LOWER)], axis=1)
                keys = band_keys(w, lists, start, rows)
                offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * (stop - start))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], names=[*part.schema.names, "bands"])

    return digests.select(*CLASS).mapInArrow(run, f"id long, head int, {', '.join(f'{p} long' for p in PARTS[1:])}, bands array<long>")


def near_digests(digests: DataFrame, scratch: Scratch, within: int = WITHIN) -> DataFrame:
    """CLASS of two distinct digests within the distance, as a_id, a_head, ..., b_id, ..., and distance; each pair once.

    Band keys carry a zone of length values: values more than 2 apart make the distance exceed 30. Zones are 16 values
    wide; a digest within 2 of the next zone is in both, so a pass makes one shuffled table and joins it with itself, by
    hash tables whose size the number of tasks bounds.
    """
    if within > WITHIN:
        raise ValueError(f"bands are laid out for distances up to {WITHIN}")
    v = length_value(F.col("head"))
    zone = lambda d: F.shiftright((v + d).bitwiseAND(F.lit(255)), 4)
    crowd = [r[1] for r in digests.groupBy(zone(0).alias("zone")).count().collect()]  # 16 rows
    n = sum(crowd)
    bands, rows = layout(n, 1.5 * sum(c * c for c in crowd) / max(1, n * n))
    half = lambda x: F.when(F.col("band") % 2 == 0, F.col(f"{x}0")).otherwise(F.col(f"{x}1")).alias(x)
    tasks = max(2 * scratch.spark.sparkContext.defaultParallelism, math.ceil(1.5 * n * min(bands, PER_PASS) / PER_TASK))
    hits = None
    for start in range(0, bands, PER_PASS):
        banded = with_bands(digests, bands, rows, start, min(bands, start + PER_PASS))
        keys = banded.select("id", "head", *UPPER, *LOWER, F.posexplode("bands").alias("band", "key")).select("id", "key", half("h"), half("l"), F.explode(F.array_distinct(F.array(zone(-2), zone(0), zone(2)))).alias("zone"))
        keys = keys.select(F.xxhash64("key", "zone").alias("key"), "id", "h", "l").repartition(tasks, "key")
        other = keys.select("key", F.col("id").alias("other"), F.col("h").alias("oh"), F.col("l").alias("ol"))
        twins = (F.col("id") == F.col("other")) & ((F.col("h") != F.col("oh")) | (F.col("l") != F.col("ol")))  # digests that share a hash
        close = plane_distance(F.col("h"), F.col("l"), F.col("oh"), F.col("ol")) <= within
        met = scratch.cut(keys.join(other.hint("shuffle_hash"), "key").where(((F.col("id") < F.col("other")) | twins) & close).select(F.col("id").alias("a_id"), F.col("other").alias("b_id")).distinct(), "met")
        hits = met if hits is None else hits.unionByName(met)
        clean_up(scratch.spark)  # the pass's shuffle files
    both = hits.distinct().join(of_class(digests, "a").hint("merge"), "a_id").join(of_class(digests, "b").hint("merge"), "b_id")
    once = (F.col("a_id") < F.col("b_id")) | (F.struct(*(F.col(f"a_{p}") for p in PARTS)) < F.struct(*(F.col(f"b_{p}") for p in PARTS)))
    near = both.where(once).select(*whole("a"), *whole("b"), distance(*sides("a", "b")).alias("distance"))
    return scratch.cut(near.where(F.col("distance") <= within), "near")


def classes(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Distinct (sha, CLASS) with a usable digest, and one row a digest."""
    members = scratch.cut(fingerprints(rows).where("id IS NOT NULL").select("sha", *CLASS).distinct(), "members")
    return members, scratch.cut(members.select(*CLASS).distinct(), "digests")


def found(rows: DataFrame, scratch: Scratch, within: int = WITHIN) -> DataFrame:
    """sha_a, sha_b: pairs of different records within the distance, equal digests included.

    Rows without a sha or a usable digest take no part; repeated rows count once; an empty table gives no rows.
    """
    members, digests = classes(rows, scratch)
    of = lambda s: of_class(members, s, F.col("sha").alias(f"s_{s}"))
    across = near_digests(digests, scratch, within).join(of("a").hint("merge"), whole("a")).join(of("b").hint("merge"), whole("b")).select("s_a", "s_b")
    same = members.withColumnRenamed("sha", "s_a").join(members.withColumnRenamed("sha", "s_b").hint("merge"), list(CLASS)).where("s_a < s_b").select("s_a", "s_b")
    return ordered_pairs(across.unionByName(same), "s_a", "s_b", "sha_a", "sha_b")


def representatives(members: DataFrame) -> DataFrame:
    """CLASS, class_sha: the least sha of each digest."""
    return members.groupBy(*CLASS).agg(F.min("sha").alias("class_sha"))


def class_pairs(rows: DataFrame, scratch: Scratch, within: int = WITHIN) -> DataFrame:
    """class_a < class_b, distance: pairs of different digests within the distance, each named by its least sha.

    With grouped() this holds what found() gives, without writing out the pairs of copies.
    """
    members, digests = classes(rows, scratch)
    rep = representatives(members)
    named = lambda s: of_class(rep, s, F.col("class_sha").alias(f"c_{s}")).hint("merge")
    both = near_digests(digests, scratch, within).join(named("a"), whole("a")).join(named("b"), whole("b"))
    return both.select(F.least("c_a", "c_b").alias("class_a"), F.greatest("c_a", "c_b").alias("class_b"), "distance")


def grouped(rows: DataFrame, scratch: Scratch, within: int = WITHIN) -> DataFrame:
    """sha, class_sha (least sha of its digest), links: other digests within the distance. One row a record."""
    members, digests = classes(rows, scratch)
    near = near_digests(digests, scratch, within)
    ends = lambda s: near.select(*(F.col(f"{s}_{c}").alias(c) for c in CLASS))
    n = ends("a").unionByName(ends("b")).groupBy(*CLASS).agg(F.count("*").alias("links"))
    per = representatives(members).join(n.hint("merge"), list(CLASS), "left")
    return members.join(per.hint("merge"), list(CLASS)).select("sha", "class_sha", F.coalesce("links", F.lit(0)).alias("links"))
