"""Normal forms of identifiers and of timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"


def clean(c: Column | str) -> Column:
    """Surrounding blanks, tabs and line breaks removed, lower case; null stays null."""
    return F.lower(trimmed(c))


def trimmed(c: Column | str) -> Column:
    """Surrounding blanks, tabs and line breaks removed."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def instant(c: Column | str) -> Column:
    """ISO-8601 text with any offset as a timestamp; without an offset it is UTC; unreadable text is null."""
    t = trimmed(c)
    return F.when(t.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$") & t.rlike(r"\d:\d"), t).when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit("T00:00:00Z"))).otherwise(F.concat(t, F.lit("Z"))).try_cast("timestamp")


def spread_ids(df, key: str, out: str, buckets: int = 1024):
    """Dense integers 0..n-1 for the distinct non-null values of a column, without a global sort.

    Values fall into hash buckets; bucket offsets come from a prefix sum over the bucket counts (one row
    a bucket), and the number within a bucket from a window over that bucket.
    """
    from pyspark.sql import Window as W

    terms = df.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    counts = terms.groupBy("_b").agg(F.count("*").alias("_n"))
    starts = counts.select("_b", (F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_start"))
    return terms.join(F.broadcast(starts), "_b").select(F.col(key), (F.row_number().over(W.partitionBy("_b").orderBy(key)) - 1 + F.col("_start")).cast("long").alias(out))
