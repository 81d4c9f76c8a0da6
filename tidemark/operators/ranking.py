"""Row numbers over a whole table without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.session import Scratch


def global_rank(df: DataFrame, order: list[str], scratch: Scratch, out: str = "rank_index") -> DataFrame:
    """Adds the 0-based position of each row in a total order.

    Rows are range-partitioned by the order and written with their partition; the sizes of the partitions, one row each,
    give where a partition starts, and a window within the partition does the rest.
    """
    parts = scratch.cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    starts = sizes.select("_p", (F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_start"))
    within = F.row_number().over(W.partitionBy("_p").orderBy(*order))
    return parts.join(F.broadcast(starts), "_p").withColumn(out, (within - 1 + F.col("_start")).cast("int")).drop("_p", "_start")
