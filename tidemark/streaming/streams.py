"""Structured Streaming forms. The batch operators have no event time; these are extensions, and labelled so."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import Scratch


def run_available(stream: DataFrame, scratch: Scratch, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there to a table in the shared folder and returns the table."""
    path = f"{scratch.path}/{name}"
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return scratch.spark.read.schema(stream.schema).parquet(path)


def source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's file or folder as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def windowed_counts(events: DataFrame, ts: str, keys: list[str], value: str, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """window_start, keys, n, total per tumbling window; rows later than the watermark are dropped by Spark.

    A window closes when the watermark passes it, so the last windows of a bounded stream stay open; callers that need
    them add a row past the end.
    """
    e = events.withWatermark(ts, late)
    w = e.groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def first_arrivals(stream: DataFrame, key: str) -> DataFrame:
    """The first row of each key: exact-copy retention against all accumulated history, kept in the state store."""
    return stream.dropDuplicates([key])


def retention_function(threshold: int, horizon_days: float | None = None):
    """For applyInPandasWithState: keeps, per block of one key, all digests seen so far, excluded ones too, and decides each new row.

    State is a list of (ts, sha, digest) of the block in the order of (ts, sha), in which rows of a batch are taken too; a new row
    is compared with the whole list at once. A row that is earlier than one already decided is an error: late data
    are rejected, not handled. horizon_days: entries older than a new row by more leave the state and are matched no more;
    by default everything stays, as the batch operator compares with all history, and blocks must be small by their key.
    """

    def decide(key, pdfs, state):
        import numpy as np
        import pandas as pd

        seen = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(pdfs)).sort_values(["ts", "sha"])
        held = np.frombuffer(bytes.fromhex("".join(s[2] for s in seen) + "".join(rows["digest"])), np.uint8).reshape(-1, 35)
        if horizon_days is not None:
            since = [np.datetime64(pd.Timestamp(t)) for t in [*(s[0] for s in seen), *rows["ts"].astype(str)]]
        out, first = [], 0
        for r in rows.itertuples():
            n = len(seen)
            if seen and (str(r.ts), r.sha) <= (seen[-1][0], seen[-1][1]):
                raise ValueError("a row earlier than one already decided")
            while horizon_days is not None and first < n and since[n] - since[first] > np.timedelta64(int(horizon_days * 86_400_000_000), "us"):
                first += 1
            hits = np.flatnonzero(_distances(held[first:n], held[n]) <= threshold)
            near = seen[first + hits[0]] if len(hits) else None
            out.append((key[0], r.sha, "EXCLUDE" if near else "KEEP", near[1] if near else ""))
            seen.append((str(r.ts), r.sha, r.digest))
        state.update((seen[first:],))
        yield pd.DataFrame(out, columns=["block", "sha", "decision", "reference_sha"])

    return decide


def _distances(many, one):
    """Distances of rows of 35 bytes from one."""
    import numpy as np

    x, y = many.astype(np.int64), one.astype(np.int64)
    ring = lambda a, b, m: np.minimum(np.abs(a - b), m - np.abs(a - b))
    swap = lambda v: (v & 15) << 4 | v >> 4
    r = ring(swap(x[:, 1]), swap(y[1]), 256)
    d = (x[:, 0] != y[0]) + np.where(r <= 1, r, 12 * r)
    for s in (4, 0):
        q = ring(x[:, 2] >> s & 15, y[2] >> s & 15, 16)
        d = d + np.where(q <= 1, q, 12 * (q - 1))
    for s in (0, 2, 4, 6):
        v = np.abs((x[:, 3:] >> s & 3) - (y[3:] >> s & 3))
        d = d + np.where(v == 3, 6, v).sum(1)
    return d


def _steps(a: str, b: str) -> int:
    """Distance of two digests of 70 hex digits."""
    ring = lambda x, y, m: min(abs(x - y), m - abs(x - y))
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    swap = lambda v: (v & 15) << 4 | v >> 4
    r = ring(swap(x[1]), swap(y[1]), 256)
    d = (x[0] != y[0]) + (r if r <= 1 else 12 * r)
    for s in (4, 0):
        q = ring(x[2] >> s & 15, y[2] >> s & 15, 16)
        d += q if q <= 1 else 12 * (q - 1)
    for p, q in zip(x[3:], y[3:]):
        for s in (0, 2, 4, 6):
            v = abs((p >> s & 3) - (q >> s & 3))
            d += 6 if v == 3 else v
    return d
