"""Writers: ordered exports, canonical JSON, read-back checks, incremental outputs, checksum manifests."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ordered_csv(df: DataFrame, path: str, *order: str) -> None:
    """A CSV export in a total order: range-sorted files whose names keep the order; an existing path is an error."""
    df.orderBy(*order).write.mode("errorifexists").option("header", True).csv(path)


def canonical_json(value: object) -> bytes:
    """Compact JSON with sorted keys in ASCII; a number that is not finite is an error."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False).encode()


def config_id(value: object) -> str:
    return hashlib.sha256(canonical_json(value)).hexdigest()


def write_json(path: str, value: object) -> None:
    """Atomic and exclusive: written beside, then renamed; an existing file is an error."""
    if os.path.exists(path):
        raise FileExistsError(path)
    with open(f"{path}.tmp", "xb") as f:
        f.write(canonical_json(value) + b"\n")
        f.flush()
        os.fsync(f.fileno())
    os.rename(f"{path}.tmp", path)


def verified_parquet(df: DataFrame, path: str) -> DataFrame:
    """Writes df and returns what was written, if it is the same bag of rows (count and a hash sum of both)."""
    df.write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.parquet(path)
    mark = lambda d: d.select(F.xxhash64(*d.columns).alias("h")).agg(F.count("*"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    if mark(df) != mark(back):
        raise ValueError(f"{path} does not read back as written")
    return back


def verified_pngs(df: DataFrame, path: str, key: str, pixels: str, side: int) -> DataFrame:
    """Writes key, png, sha256 of row-major pixels and returns what was written, once every image decodes to its pixels."""
    from tidemark.sources.images import image_column, png_column

    files = df.select(key, pixels, png_column(F.col(pixels), side).alias("png")).withColumn("sha256", F.sha2("png", 256))
    files.write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.parquet(path)
    seen = F.transform(image_column(F.col("png"), F.col("sha256"), side), lambda x: F.round(x.cast("double") * 255).cast("int"))
    if not back.where(~seen.eqNullSafe(F.col(pixels).cast("array<int>"))).isEmpty():
        raise ValueError(f"{path} does not decode to the pixels written")
    return back


def reused(df: DataFrame, path: str, key: str, source_hash: str) -> DataFrame:
    """The output at path for the rows of df (key, source_hash and results): kept rows are reused if their source is the same.

    Each source is hashed again by the caller, in source_hash; a kept row whose source changed is an error, never silently
    replaced, and rows that are not kept yet are appended. A call with the same rows writes nothing.
    """
    spark = df.sparkSession
    if _exists(spark, path):
        kept = spark.read.parquet(path).select(key, F.col(source_hash).alias("_kept"))
        changed = df.select(key, source_hash).join(kept.hint("merge"), key).where(~F.col(source_hash).eqNullSafe(F.col("_kept")))
        if (row := changed.select(key).limit(1).first()) is not None:
            raise ValueError(f"the source of {row[0]} has changed since its output was kept")
    return append_new(df, path, key)


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key the output lacks; a repeated call with the same rows writes nothing."""
    spark = df.sparkSession
    if _exists(spark, path):
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
        if df.isEmpty():
            return spark.read.parquet(path)
    df.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def checksums(spark: SparkSession, folder: str, manifest: str = "checksums.json") -> DataFrame:
    """path, sha256 of each file under a folder but the manifest itself."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return d.where(~F.col("path").endswith("/" + manifest)).select("path", F.sha2("content", 256).alias("sha256"))


def long_table(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, metric, value."""
    return df.select(*keys, F.inline(F.array(*(F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values))))
