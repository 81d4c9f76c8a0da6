"""Readers of files that Spark has no strict reader for, and path guards."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def strict_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with exactly the schema's header, in order; a repeated name or a ragged row is an error.

    A byte-order mark before the header is allowed.
    """
    from pyspark.sql.types import StructType

    st = StructType.fromDDL(schema)
    head = spark.read.text(path).limit(1).first()
    names = [x.strip().strip('"') for x in (head[0].lstrip("\ufeff").split(",") if head else [])]
    if names != st.names or len(set(names)) != len(names):
        raise ValueError(f"header {names} is not {st.names}")
    return spark.read.schema(st).option("header", True).option("mode", "FAILFAST").option("enforceSchema", True).csv(path)


def strict_json(text: str) -> object:
    """Parsed JSON; a repeated key or a number that is not finite is an error."""

    def once(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def never(x):
        raise ValueError(f"{x} is no JSON number")

    return json.loads(text, object_pairs_hook=once, parse_constant=never)


def inside(root: str, path: str) -> str:
    """The real path, if it lies in root."""
    full = os.path.realpath(os.path.join(root, path))
    if os.path.commonpath([full, os.path.realpath(root)]) != os.path.realpath(root):
        raise ValueError(f"{path} leaves {root}")
    return full


def pinned(root: str, path: str, sha256: str) -> bytes:
    """A file's bytes, if it lies in root and has the stated SHA-256."""
    with open(inside(root, path), "rb") as f:
        data = f.read()
    if hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError(f"{path} has another SHA-256")
    return data


def only(paths: list[str]) -> str:
    """The one path; none or several are an error, never the latest."""
    if len(paths) != 1:
        raise ValueError(f"{len(paths)} runs match, not one")
    return paths[0]


def contents(spark: SparkSession, path: str) -> DataFrame:
    """path, content, file_size, sha256, crc32 of each file under a path."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return d.select("path", "content", F.col("length").alias("file_size"), F.sha2("content", 256).alias("sha256"), F.lpad(F.lower(F.hex(F.crc32("content"))), 8, "0").alias("crc32"))


class _Archive(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class ZipIndex(DataSource):
    """spark.read.format("zip_index").load(pattern): one row a member of each archive, from the central directory alone."""

    @classmethod
    def name(cls) -> str:
        return "zip_index"

    def schema(self) -> str:
        return "archive string, zip_member string, file_size long, compressed_size long, zip_crc32 string, modified string"

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(self.options["path"])


class _ZipReader(DataSourceReader):
    def __init__(self, pattern: str):
        self.pattern = pattern

    def partitions(self) -> list[InputPartition]:
        import glob

        return [_Archive(p) for p in sorted(glob.glob(self.pattern))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import zipfile

        with zipfile.ZipFile(partition.value) as z:
            for i in z.infolist():
                if not i.is_dir():
                    yield partition.value, i.filename, i.file_size, i.compress_size, f"{i.CRC:08x}", "%04d-%02d-%02dT%02d:%02d:%02d" % i.date_time


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """The rows of zip_index for archives on any file system that Spark reads (up to 2 GB each, read whole by one task)."""

    def run(batches):
        import io
        import zipfile

        import pandas as pd

        names = ["archive", "zip_member", "file_size", "compressed_size", "zip_crc32", "modified"]
        for b in batches:
            for at, data in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    yield pd.DataFrame([(at, i.filename, i.file_size, i.compress_size, f"{i.CRC:08x}", "%04d-%02d-%02dT%02d:%02d:%02d" % i.date_time) for i in z.infolist() if not i.is_dir()], columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content").mapInPandas(run, "archive string, zip_member string, file_size long, compressed_size long, zip_crc32 string, modified string")


def zip_summary(members: DataFrame, first: int = 10) -> DataFrame:
    """archive, entries, file_bytes, compressed_bytes, first_members: the first names of each archive in sorted order."""
    w = W.partitionBy("archive").orderBy("zip_member")
    ranked = members.withColumn("_r", F.row_number().over(w))
    few = F.array_sort(F.collect_list(F.when(F.col("_r") <= first, F.col("zip_member"))))
    return ranked.groupBy("archive").agg(F.count("*").alias("entries"), F.sum("file_size").alias("file_bytes"), F.sum("compressed_size").alias("compressed_bytes"), few.alias("first_members"))


def zip_coverage(rows: DataFrame, members: DataFrame, member: str) -> DataFrame:
    """rows with the columns of their member; a row without a member, or with several of that name, is an error."""
    named = members.groupBy(F.col("zip_member").alias(member)).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in members.columns if c != "zip_member"))
    joined = rows.join(named.hint("merge"), member, "left")
    n = F.coalesce("_n", F.lit(0))
    checked = F.when(n == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("index covers a row "), n.cast("string"), F.lit(" times: "), F.coalesce(F.col(member), F.lit("null")))).cast("boolean"))
    return joined.where(checked).drop("_n")


class NpzBundle(DataSource):
    """spark.read.format("npz_bundle").load(pattern): sample rows of archives with arrays ids, labels and logits, and classes."""

    @classmethod
    def name(cls) -> str:
        return "npz_bundle"

    def schema(self) -> str:
        return "path string, position int, id string, label int, logits array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _NpzReader(self.options["path"], self.options.get("sha256"))


class _NpzReader(_ZipReader):
    def __init__(self, pattern: str, sha256: str | None):
        super().__init__(pattern)
        self.sha256 = sha256

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import io

        import numpy as np

        with open(partition.value, "rb") as f:
            data = f.read()
        if self.sha256 and hashlib.sha256(data).hexdigest() != self.sha256:
            raise ValueError(f"{partition.value} has another SHA-256")
        with np.load(io.BytesIO(data), allow_pickle=False) as z:
            ids, labels, logits = z["ids"], z["labels"], z["logits"].astype(float)
            if logits.shape != (len(ids), len(z["classes"])) or len(set(ids.tolist())) != len(ids) or not np.isfinite(logits).all():
                raise ValueError("shapes, ids or logits of the bundle")
        for i, (s, y, row) in enumerate(zip(ids.tolist(), labels.tolist(), logits.tolist())):
            yield partition.value, i, str(s), int(y), row


def npy_header(data: bytes) -> dict:
    """version, dtype, fortran_order and shape of an NPY file's header (versions 1-3, at most 64 KiB)."""
    import ast
    import struct

    if data[:6] != b"\x93NUMPY" or data[6] not in (1, 2, 3):
        raise ValueError("no NPY file")
    wide = data[6] > 1
    n = struct.unpack("<I" if wide else "<H", data[8 : 12 if wide else 10])[0]
    start = 12 if wide else 10
    if n > 65536 or len(data) < start + n:
        raise ValueError("header too long or cut off")
    h = ast.literal_eval(data[start : start + n].decode("utf-8" if data[6] == 3 else "latin-1"))
    return {"version": data[6], "dtype": h["descr"], "fortran_order": h["fortran_order"], "shape": tuple(h["shape"])}


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipIndex)
    spark.dataSource.register(NpzBundle)
