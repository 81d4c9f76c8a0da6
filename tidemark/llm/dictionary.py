"""Problem 2: frequency of every distinct value.

Terms get dense integers from a global dictionary. Blocks of rows (the partitions after records are told
apart) keep count arrays, one for each range of identifiers they meet, for occurrences and for record
presence; arrays are summed by identifier range. No array grows with the dictionary: a range has RANGE slots. Arrays
travel without their zeros, so a block that meets one term of a range sends one slot and not RANGE.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import clean, spread_ids
from tidemark.session import Scratch

RANGE = 512
HELD = 2048  # ranges a block holds before it hands them on: 16 MB


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        keys = sorted(held)
        at = [np.flatnonzero(held[k].any(0)) for k in keys]
        offsets = pa.array(np.cumsum([0, *map(len, at)]), pa.int32())
        flat = lambda parts, t: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts), t))
        counts = [flat([held[k][i][x] for k, x in zip(keys, at)], pa.int64()) for i in (0, 1)]
        batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), flat(at, pa.int32()), *counts], names=["id_range", "slots", "occurrences", "presence"])
        held.clear()
        return batch

    for b in batches:
        ids, n, rec = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        ranges = ids // RANGE
        for r in np.unique(ranges):
            at = ranges == r
            a = held.setdefault(int(r), np.zeros((2, RANGE), np.int64))
            a[0] += np.bincount(ids[at] % RANGE, n[at], RANGE).astype(np.int64)
            a[1] += np.bincount(ids[at] % RANGE, rec[at], RANGE).astype(np.int64)
        if len(held) > HELD:
            yield out()
    if held:
        yield out()


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the arrays of each range; ranges come in order, so only the last of a batch waits for the next one."""
    left = np.zeros((3, 0), np.int64)

    def out(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=["id", "occurrences", "records"])

    for b in batches:
        lists = [b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2, 3)]
        ranges = np.repeat(b.column(0).to_numpy(zero_copy_only=False), np.diff(b.column(1).offsets.to_numpy()))
        ids, at = np.unique(np.concatenate([left[0], ranges * RANGE + lists[0]]), return_inverse=True)
        sums = np.zeros((3, len(ids)), np.int64)
        sums[0] = ids
        for i in (1, 2):
            np.add.at(sums[i], at, np.concatenate([left[i], lists[i]]))
        split = np.searchsorted(ids, ids[-1] // RANGE * RANGE) if len(ids) else 0
        left = sums[:, split:]
        if split:
            yield out(sums[:, :split])
    if left.shape[1]:
        yield out(left)


def frequencies(rows: DataFrame, record: str, term: str, also: list[DataFrame] = (), rare_below: int = 5, common_from: float = 0.1, scratch: Scratch | None = None) -> DataFrame:
    """term, occurrences, records, mark for every distinct term of rows, and of `also` (a term column each) with 0.

    mark is rare below rare_below records, common from the share common_from of all distinct records, else null.
    Terms and records are compared without blanks around and letter case. The null term is none; rows without a
    record count as occurrences, not as presence; repeated rows count as occurrences each and as one
    presence. An empty table gives the terms of `also`, all rare.
    """
    base = rows.select(clean(record).alias("record"), clean(term).alias("term"))
    # One row a record and term: the records, told apart, are the blocks' rows.
    cells = base.groupBy("record", "term").agg(F.count("*").alias("n"))
    if scratch:
        cells = scratch.cut(cells, "cells")
    total = cells.where("record IS NOT NULL").select("record").distinct().agg(F.count("*").alias("all_records"))
    terms = cells.select("term")
    for other in also:
        terms = terms.unionByName(other.select(clean(other.columns[0]).alias("term")))
    ids = spread_ids(terms, "term", "id")
    if scratch:
        ids = scratch.cut(ids, "dictionary")
    # Cells of one block and term become one before they are encoded, so a hot term meets the dictionary as one row a block.
    block = cells.where("term IS NOT NULL").withColumn("block", F.spark_partition_id()).groupBy("block", "term").agg(F.sum("n").alias("n"), F.count("record").alias("records"))
    coded = block.join(ids.hint("merge"), "term").select("id", "n", "records")
    arrays = coded.mapInArrow(_blocks, "id_range long, slots array<int>, occurrences array<long>, presence array<long>")
    counts = arrays.repartition("id_range").sortWithinPartitions("id_range").mapInArrow(_totals, "id long, occurrences long, records long")
    out = ids.join(counts.hint("merge"), "id", "left").select("term", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.coalesce("records", F.lit(0)).alias("records"))
    out = out.join(F.broadcast(total))  # one row
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") >= F.lit(common_from) * F.col("all_records"), "common")
    return out.select("term", "occurrences", "records", mark.alias("mark"))
