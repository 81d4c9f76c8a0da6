"""Greyscale images as PNG or NPY bytes: encoding, and decoding with checksum and range checks, in Arrow batches.

Only what the study's images are: 8-bit greyscale PNG without interlace, with any of the five line filters, and NPY arrays
of float32. No imaging library is needed.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.sources.files import npy_header

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(pixels: np.ndarray) -> bytes:
    """An 8-bit greyscale PNG of a (height, width) array of bytes."""
    p = np.asarray(pixels)
    if p.dtype != np.uint8 or p.ndim != 2 or 0 in p.shape:
        raise ValueError("pixels must be a matrix of bytes")
    lines = np.concatenate([np.zeros((len(p), 1), np.uint8), p], axis=1)  # no line is filtered
    head = struct.pack(">IIBBBBB", p.shape[1], p.shape[0], 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 9)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """The (height, width) bytes of an 8-bit greyscale PNG; a wrong signature, checksum, size or kind is an error."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, head, body, ended = 8, None, b"", False
    while not ended:
        if len(data) < at + 12:
            raise ValueError("PNG is cut off")
        n, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n or zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("PNG chunk with a wrong checksum")
        head = struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else head
        body += part if kind == b"IDAT" else b""
        ended, at = kind == b"IEND", at + 12 + n
    if at != len(data) or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a plain 8-bit greyscale PNG")
    width, height = head[:2]
    raw = np.frombuffer(zlib.decompress(body), np.uint8)
    if raw.size != height * (width + 1):
        raise ValueError("PNG has another size than it says")
    raw = raw.reshape(height, width + 1)
    out = np.zeros((height + 1, width + 1), np.int64)  # a row and a column of zeros before the first ones
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        up = out[y, 1:]
        if kind == 0:
            out[y + 1, 1:] = line
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(line) & 255
        elif kind == 2:
            out[y + 1, 1:] = (line + up) & 255
        elif kind in (3, 4):
            for x in range(width):
                left, above, corner = out[y + 1, x], out[y, x + 1], out[y, x]
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    near = left + above - corner
                    guess = min((left, above, corner), key=lambda v: abs(near - v))
                out[y + 1, x + 1] = (line[x] + guess) & 255
        else:
            raise ValueError("unknown line filter")
    return out[1:, 1:].astype(np.uint8)


def encode_npy(values: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.asarray(values, np.float32), allow_pickle=False)
    return out.getvalue()


def decode_image(data: bytes, sha256: str | None, side: int | None = None) -> np.ndarray:
    """Values in [0, 1] of a PNG (bytes / 255) or an NPY file (float32 as it is).

    The bytes must have the stated SHA-256 (None: not checked), values must be finite and in range, and the image must be
    square of the stated side (None: any).
    """
    if sha256 is not None and hashlib.sha256(data).hexdigest() != sha256.strip().lower():
        raise ValueError("image has another SHA-256")
    if data[:8] == SIGNATURE:
        image = decode_png(data).astype(np.float32) / np.float32(255)
    else:
        if npy_header(data)["dtype"] not in ("<f4", "=f4", "|f4"):
            raise ValueError("NPY image is not float32")
        image = np.load(io.BytesIO(data), allow_pickle=False)
    if image.ndim != 2 or side is not None and image.shape != (side, side):
        raise ValueError(f"image has shape {image.shape}")
    if not np.isfinite(image).all() or image.min() < 0 or image.max() > 1:
        raise ValueError("image values outside 0 to 1")
    return image


def png_column(pixels: Column, side: int) -> Column:
    """PNG bytes of row-major pixels (array<int> of side * side values 0 to 255); null stays null."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if x is None else encode_png(_bytes(x).reshape(side, side)) for x in s])

    return run(pixels)


def _bytes(x) -> np.ndarray:
    v = np.asarray(x)
    if v.size and (v.min() < 0 or v.max() > 255):
        raise ValueError("pixels outside 0 to 255")
    return v.astype(np.uint8)


def image_column(data: Column, sha256: Column, side: int | None = None) -> Column:
    """array<float> of the decoded, checked image, row-major; null data stays null, a failed check ends the job."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for d, h in batches:
            yield pd.Series([None if x is None else decode_image(x, y, side).ravel() for x, y in zip(d, h)])

    return run(data, sha256)
