"""Views of byte content as small matrices: bit transitions, raw bytes, local entropy; digests; copies within files.

Contents are binary columns. Each view is an Arrow UDF over whole contents: a content's work is a handful of NumPy
calls, and rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH, SIDE = 256, 64


def _column(f: Callable[[bytes], object], kind: str, arrow: pa.DataType) -> Callable[[Column], Column]:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if x is None else f(x) for x in b.to_pylist()], arrow)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def states(data: bytes, bits: int = 6) -> np.ndarray:
    """MSB-first states of `bits` bits; a last partial block keeps its integer value."""
    if not 1 <= bits <= 8:
        raise ValueError("1 to 8 bits a state")
    b = np.unpackbits(np.frombuffer(data, np.uint8))
    whole = len(b) // bits
    powers = 1 << np.arange(bits - 1, -1, -1)
    out = b[: whole * bits].reshape(whole, bits) @ powers
    rest = b[whole * bits :]
    return out if not len(rest) else np.append(out, int("".join(map(str, rest)), 2))


def transitions(data: bytes, bits: int = 6) -> np.ndarray:
    """(2^bits, 2^bits) counts of successive states, each row scaled to count * 255 // row total; an empty row is 0."""
    s, n = states(data, bits), 1 << bits
    if len(s) < 2:
        raise ValueError("two states at least")
    c = np.bincount(s[:-1] * n + s[1:], minlength=n * n).reshape(n, n)
    total = c.sum(1, keepdims=True)
    return np.where(total > 0, c * 255 // np.maximum(total, 1), 0).astype(np.uint8)


def local_entropy(data: bytes, window: int = 256, stride: int = 128) -> np.ndarray:
    """Per byte the mean of the normalised entropies (0..1) of the windows that cover it; the last window reaches the end."""
    if not data or window <= 0 or not 1 <= stride <= window:
        raise ValueError("content, a window and a stride within it are required")
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    n = len(x)
    starts = np.arange(0, max(n - window, 0) + stride, stride)
    starts = starts[: int(np.argmax(starts + window >= n)) + 1]
    total, cover = np.zeros(n + 1), np.zeros(n + 1)
    for a in range(0, len(starts), 4096):  # a few MB of histograms at a time
        at = starts[a : a + 4096]
        stops = np.minimum(at + window, n)
        where = np.concatenate([np.arange(s, e) for s, e in zip(at, stops)])
        row = np.repeat(np.arange(len(at)), stops - at)
        c = np.bincount(row * 256 + x[where], minlength=256 * len(at)).reshape(-1, 256)
        p = c / (stops - at)[:, None]
        e = -(p * np.log2(np.where(p > 0, p, 1))).sum(1) / 8
        np.add.at(total, at, e)
        np.subtract.at(total, stops, e)
        np.add.at(cover, at, 1)
        np.subtract.at(cover, stops, 1)
    return np.cumsum(total)[:n] / np.cumsum(cover)[:n]


def layout(values: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `width` values and the mask of those that exist."""
    rows = max(1, -(-len(values) // width))
    m, ok = np.zeros(rows * width), np.zeros(rows * width, bool)
    m[: len(values)], ok[: len(values)] = values, True
    return m.reshape(rows, width), ok.reshape(rows, width)


def overlaps(source: int, target: int) -> np.ndarray:
    """(target, source) integer overlaps of equal divisions of one length."""
    t, s = np.arange(target)[:, None] * source, np.arange(source)[None, :] * target
    return np.maximum(0, np.minimum(t + source, s + target) - np.maximum(t, s))


def masked_resize(m: np.ndarray, ok: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Area mean over valid cells only, exact integer overlaps; a region without valid cells is 0."""
    h, w = m.shape
    across = overlaps(w, side).T.astype(float)
    num, den = (m * ok) @ across, ok.astype(float) @ across
    if h <= 4096:
        down = overlaps(h, side).astype(float)
        num, den = down @ num, down @ den
    else:  # a target row meets few source rows
        rows = []
        for o in range(side):
            r = np.arange(o * h // side, min(h, -(-(o + 1) * h // side)))
            a = np.maximum(0, np.minimum((o + 1) * h, (r + 1) * side) - np.maximum(o * h, r * side)).astype(float)
            rows.append((a @ num[r], a @ den[r]))
        num, den = (np.array(x) for x in zip(*rows))
    return np.divide(num, den, out=np.zeros_like(num), where=den > 0)


def raw_image(data: bytes) -> np.ndarray:
    """64 x 64 masked area mean of byte / 255, as float32."""
    return masked_resize(*layout(np.frombuffer(data, np.uint8) / 255)).astype(np.float32)


def entropy_image(data: bytes) -> np.ndarray:
    return masked_resize(*layout(local_entropy(data))).astype(np.float32)


def transition_image(content: Column, bits: int = 6) -> Column:
    """Row-major transition matrix as array<int>; fails for contents of fewer than two states."""
    return _column(lambda b: transitions(b, bits).ravel().astype(np.int32), "array<int>", pa.list_(pa.int32()))(content)


def state_column(content: Column, bits: int = 6) -> Column:
    return _column(lambda b: states(b, bits).astype(np.int32), "array<int>", pa.list_(pa.int32()))(content)


def raw_byte_image(content: Column) -> Column:
    return _column(lambda b: raw_image(b).ravel(), "array<float>", pa.list_(pa.float32()))(content)


def local_entropy_image(content: Column) -> Column:
    return _column(lambda b: entropy_image(b).ravel(), "array<float>", pa.list_(pa.float32()))(content)


def entropy_column(content: Column, window: int = 256, stride: int = 128) -> Column:
    return _column(lambda b: local_entropy(b, window, stride) if b else [], "array<double>", pa.list_(pa.float64()))(content)


def declared_size(content: Column, size: Column) -> Column:
    """The content, if it has exactly the declared size; an error if it is shorter or longer."""
    return F.when(F.length(content) == size, content).otherwise(F.raise_error(F.concat(F.lit("content has not its declared size "), size.cast("string"))).cast("binary"))


def size_status(content: Column, size: Column) -> Column:
    """EXACT, SHORT (fewer bytes than declared), TRAILING (more), UNDECLARED (no size), MISSING (no content)."""
    n = F.length(content)
    return F.when(content.isNull(), "MISSING").when(size.isNull(), "UNDECLARED").when(n < size, "SHORT").when(n > size, "TRAILING").otherwise("EXACT")


def permutation(path: str, heading: str = "*Table T:*") -> list[int]:
    """The permutation of 0..255 that a digest's hash uses, read from a text in which it follows a heading."""
    import re

    text = open(path, encoding="utf-8").read().split(heading, 1)[1]
    t = [int(x) for x in re.findall(r"\d+", text)[:256]]
    if sorted(t) != list(range(256)):
        raise ValueError("no permutation of 0..255 follows the heading")
    return t


def digest(data: bytes, table: np.ndarray) -> str:
    """T1 + 70 hex digits by the published algorithm, or TNULL for under 50 bytes or too little variation."""
    n = len(data)
    if n < 50:
        return "TNULL"
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    a, b, c, e, f = (x[4 - k : n - k] for k in range(5))
    step = lambda s, p, q, r: table[table[table[table[s] ^ p] ^ q] ^ r]
    counts = np.zeros(256, np.int64)
    for salt, p, q, r in ((2, a, b, c), (3, a, b, e), (5, a, c, e), (7, a, c, f), (11, a, b, f), (13, a, e, f)):
        counts += np.bincount(step(salt, p, q, r), minlength=256)
    counts = counts[:128]
    q1, q2, q3 = np.sort(counts)[[31, 63, 95]]
    if q3 == 0 or (counts > 0).sum() <= 64:
        return "TNULL"
    check, t = 0, table.tolist()
    for v in table[table[table[0] ^ a] ^ b].tolist():
        check = t[v ^ check]
    log = np.log(n)
    length = int(log / np.log(1.5) if n <= 656 else log / np.log(1.3) - 8.72777 if n <= 3199 else log / np.log(1.1) - 62.5472) % 256
    codes = (counts > q1).astype(int) + (counts > q2) + (counts > q3)
    body = (codes.reshape(32, 4) << np.array([0, 2, 4, 6])).sum(1)[::-1]
    swap = lambda v: (v & 15) << 4 | v >> 4
    return "T1" + "".join(f"{v:02X}" for v in [swap(check), swap(length), int(100 * q1 / q3) % 16 << 4 | int(100 * q2 / q3) % 16, *body])


def digest_column(content: Column, table: list[int]) -> Column:
    t = np.array(table, np.int64)
    return _column(lambda b: digest(b, t), "string", pa.string())(content)


def compare(shorter: bytes, longer: bytes, anchors: int = 64, block: int = 4096) -> dict:
    """Common prefix and suffix (not overlapping), whether one insertion explains the difference, and each anchor's status and shift."""
    m = min(len(shorter), len(longer))
    s, t = np.frombuffer(shorter, np.uint8), np.frombuffer(longer, np.uint8)
    run = lambda eq: int(np.argmin(eq)) if len(eq) and not eq.all() else len(eq)
    prefix = run(s[:m] == t[:m])
    rest = len(s) - prefix
    suffix = run((s[::-1][:rest] == t[::-1][:rest])) if rest else 0
    found = []
    for i in range(anchors):
        at = (len(shorter) - block) * i // (anchors - 1)
        piece = shorter[at : at + block]
        first = longer.find(piece)
        if shorter.find(piece, shorter.find(piece) + 1) != -1:
            status = "AMBIGUOUS_SOURCE"
        elif first == -1:
            status = "NOT_FOUND"
        else:
            status = "AMBIGUOUS_TARGET" if longer.find(piece, first + 1) != -1 else "UNIQUE_MATCH"
        found.append({"source_offset": at, "status": status, "shift": first - at if status == "UNIQUE_MATCH" else None})
    return {"prefix": prefix, "suffix": suffix, "one_insertion": len(s) - prefix - suffix == 0, "anchors": found}


def compare_columns(shorter: Column, longer: Column, anchors: int = 64, block: int = 4096) -> Column:
    """compare() of two binary columns as a struct; contents shorter than a block have no anchors."""
    anchor = pa.struct([("source_offset", pa.int64()), ("status", pa.string()), ("shift", pa.int64())])
    kind = pa.struct([("prefix", pa.int64()), ("suffix", pa.int64()), ("one_insertion", pa.bool_()), ("anchors", pa.list_(anchor))])

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = zip(a.to_pylist(), b.to_pylist())
        return pa.array([None if x is None or y is None else compare(x, y, anchors if len(x) >= block else 0, block) for x, y in rows], kind)

    run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<prefix:bigint,suffix:bigint,one_insertion:boolean,anchors:array<struct<source_offset:bigint,status:string,shift:bigint>>>")(shorter, longer)
