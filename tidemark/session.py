"""Session set-up and the shared scratch space in which plans are cut."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; further settings by keyword (dots as __)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Where it is unset (tests, single machine) a temporary folder is made; on a cluster that would
    be a folder of one machine, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = getattr(spark, "_tidemark_root", None)
        if not root:
            root = spark._tidemark_root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, root[7:], True)
    return root


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive the loss of an executor.

    They stay until close(), or the end of the driver's program, as results read them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        if self.path.startswith("file:"):
            atexit.register(shutil.rmtree, self.path.split(":", 1)[1].replace("///", "/", 1), True)
        else:
            atexit.register(_remove_at_exit, spark, self.path)

    def close(self) -> None:
        """Delete all tables of this scratch; nothing may read them afterwards."""
        remove(self.spark, self.path)

    def cut(self, df: DataFrame, name: str = "t", *by: str) -> DataFrame:
        """Write df and return the written table; earlier parts of the plan are not run again. by: columns that make folders."""
        self.n += 1
        path = f"{self.path}/{self.n:04d}-{name}"
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path).select(*df.columns)
        out._tidemark_path = path
        return out

    def tables(self, dfs: list[DataFrame]) -> DataFrame:
        """Tables made by cut() with the same columns as one: a single scan, where a union would be a branch a table."""
        return self.spark.read.schema(dfs[0].schema).parquet(*(df._tidemark_path for df in dfs)).select(*dfs[0].columns)

    def drop(self, *dfs: DataFrame | None) -> None:
        """Delete tables made by cut() that nothing reads any more."""
        for df in dfs:
            if path := getattr(df, "_tidemark_path", None):
                remove(self.spark, path)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    """On other file systems through the JVM, if it still runs; handlers run last in first out, so before pyspark ends it."""
    try:
        remove(spark, path)
    except Exception as e:  # the program ends anyway; what stays is named
        print(f"{path} was not removed: {e}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def clean_up(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files and broadcasts of finished steps, which it does when the driver collects garbage.

    For long loops of jobs on the driver, between whose steps nothing of the old plans is needed.
    """
    gc.collect()
    spark._jvm.System.gc()
