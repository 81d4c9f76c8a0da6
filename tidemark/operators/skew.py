"""Problem 7: per-key results where a few keys hold most rows.

Eager aggregation: each input is aggregated to compact states before anything is joined, so a hot key meets
the join as one row. Distinct records are counted over states of (key, record), which spread evenly however
uneven the keys are; the state of a key is then combined map-side and only one row a key and task is moved.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import clean, instant


def key_states(samples: DataFrame, fields: list[str]) -> DataFrame:
    """field, key_value, row_count, record_count, first_seen, last_seen for every value of each field.

    The null key is a row of its own, with key_value null. Keys, and the sha that tells records apart, are compared
    in their normal form (blanks around, letter case); rows without a sha count as rows, not as records. Unreadable
    timestamps are ignored. An empty table gives no rows.
    """
    base = samples.select(clean("sha").alias("sha"), instant("timestamp").alias("ts"), *(clean(f).alias(f"k_{i}") for i, f in enumerate(fields)))
    keys = [f"k_{i}" for i in range(len(fields))]
    first = base.groupBy("sha", *keys).agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    each = first.select("sha", "n", "lo", "hi", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(k).alias("key_value")) for f, k in zip(fields, keys)))))
    per_record = each.groupBy("field", "key_value", "sha").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return per_record.groupBy("field", "key_value").agg(F.sum("n").alias("row_count"), F.count("sha").alias("record_count"), F.min("lo").alias("first_seen"), F.max("hi").alias("last_seen"))


def hot_keys(samples: DataFrame, fields: list[str], share: float = 0.05) -> DataFrame:
    """field, key_value, pairs, share of non-null values that hold at least `share` of all rows, repeats and null rows counted.

    By eager_join of the table's keys with the table's fields: in the join of every row with every row of its
    field, which is never made, a key with n of N rows stands for n * N rows of N * N. Both inputs are
    compact states (one row a key, one row a field) before they meet; pairs is the multiplied count, and its
    roll-up by field gives the whole that a key's share is taken of. Ties count as hot, exactly (decimals).
    """
    cells = samples.select(F.inline(F.array(*(F.struct(F.lit(f).alias("field"), clean(f).alias("key_value")) for f in fields))))
    states = eager_join(cells, cells.select("field"), ["field"], ["field", "key_value"], wide=True, few_right=True).withColumnRenamed("joined_rows", "pairs")
    whole = states.groupBy("field").agg(F.sum("pairs").alias("all_pairs"))
    # One row a field: as many as there are names in `fields`.
    at = states.join(F.broadcast(whole), "field")
    return at.where(F.col("key_value").isNotNull() & (F.col("pairs") >= F.lit(Decimal(str(share))) * F.col("all_pairs"))).select("field", "key_value", "pairs", (F.col("pairs") / F.col("all_pairs")).cast("double").alias("share"))


def eager_join(left: DataFrame, right: DataFrame, on: list[str], left_by: list[str] = (), right_by: list[str] = (), left_sums: dict[str, Column] | None = None, right_sums: dict[str, Column] | None = None, wide: bool = False, few_right: bool = False) -> DataFrame:
    """The inner join of two tables aggregated by left_by + right_by, without ever making its rows.

    Both inputs are first aggregated by join key and grouping columns to a count and sums; the compact states
    are joined; a pair of states stands for count_l * count_r joined rows, so a left sum is multiplied by
    the right count and the other way round; then states are rolled up. Gives the grouping columns, joined_rows and the
    sums. Null join keys meet nothing. Columns of other names in either table are not read; a grouping column may be
    a join key. wide: counts are decimals of 38 digits, for joins of more than 2^63 rows, where longs raise an error.
    The states are joined by sort-merge, as a side with as many keys as rows must not be built on the driver; few_right
    says that the right side has few states by its nature, which are then broadcast.
    """
    ls, rs = left_sums or {}, right_sums or {}
    lk, rk = list(dict.fromkeys([*on, *left_by])), list(dict.fromkeys([*on, *right_by]))
    a = left.groupBy(*lk).agg(F.count("*").alias("_nl"), *(F.sum(c).alias(k) for k, c in ls.items()))
    b = right.groupBy(*rk).agg(F.count("*").alias("_nr"), *(F.sum(c).alias(k) for k, c in rs.items()))
    by = list(dict.fromkeys([*left_by, *right_by]))
    pairs = F.sum(F.col("_nl").cast("decimal(19,0)") * F.col("_nr").cast("decimal(19,0)")) if wide else F.sum(F.col("_nl") * F.col("_nr"))
    return a.join(F.broadcast(b) if few_right else b.hint("merge"), list(on)).groupBy(*by).agg(pairs.cast("decimal(38,0)" if wide else "long").alias("joined_rows"), *(F.sum(F.col(k) * F.col("_nr")).alias(k) for k in ls), *(F.sum(F.col(k) * F.col("_nl")).alias(k) for k in rs))
