"""Locality-sensitive digests of 35 bytes as one integer and four 64-bit words, and their distance.

The published TLSH difference is a sum over 128 two-bit values and three header fields. The values are kept as two
bit planes, upper bits in h0, h1 and lower bits in l0, l1, so that it needs only XOR, AND and bit counts. The code for
it stays small enough for the JVM's compiler, which leaves methods of more than 8,000 bytecodes interpreted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.keys import trimmed

UPPER, LOWER = ("h0", "h1"), ("l0", "l1")
PARTS = ("head", *UPPER, *LOWER)
#: A hex digit is two values; their upper and their lower bits, each pair as a digit of base 4.
HEX, UPPER_BITS, LOWER_BITS = "0123456789ABCDEF", "0011001122332233", "0101232301012323"


def usable(tlsh: Column | str, status: Column | str) -> Column:
    """The 70 upper-case hex digits of a digest whose status reads VALID, else null."""
    d = F.upper(trimmed(tlsh))
    return F.when((F.upper(trimmed(status)) == "VALID") & d.rlike(r"^(T1)?[0-9A-F]{70}\z"), F.right(d, F.lit(70)))


def pack(digest: Column) -> list[Column]:
    """head (checksum, length value, two ratios: 24 bits) and the bit planes of a digest of 70 hex digits; null gives null."""
    head = F.concat(F.substring(digest, 1, 2), F.substring(digest, 4, 1), F.substring(digest, 3, 1), F.substring(digest, 5, 2))
    plane = lambda to, i: F.conv(F.substring(F.translate(digest, HEX, to), 7 + 32 * i, 32), 4, -10).cast("long")
    planes = [plane(to, i).alias(n) for names, to in ((UPPER, UPPER_BITS), (LOWER, LOWER_BITS)) for i, n in enumerate(names)]
    return [F.conv(head, 16, -10).cast("int").alias("head"), *planes]


def length_value(head: Column) -> Column:
    return F.shiftright(head, 8).bitwiseAND(F.lit(255))


def _ring(a: Column, b: Column, m: int) -> Column:
    return F.least(F.abs(a - b), F.lit(m) - F.abs(a - b))


def head_distance(a: Column, b: Column) -> Column:
    """The share of checksum, length value and ratios in the distance."""
    r = _ring(length_value(a), length_value(b), 256)
    out = F.when(F.shiftright(a, 16) == F.shiftright(b, 16), 0).otherwise(1) + F.when(r > 1, 12 * r).otherwise(r)
    for s in (4, 0):
        q = _ring(F.shiftright(a, s).bitwiseAND(F.lit(15)), F.shiftright(b, s).bitwiseAND(F.lit(15)), 16)
        out = out + F.greatest(q, 12 * q - 12)
    return out


def plane_distance(ah: Column, al: Column, bh: Column, bl: Column) -> Column:
    """Sum over 64 two-bit values of |a-b|, 3 counting as 6."""
    high, low = ah.bitwiseXOR(bh), al.bitwiseXOR(bl)
    both = high.bitwiseAND(low)  # 3 against 0, or 2 against 1
    three = ah.bitwiseAND(al).bitwiseOR(bh.bitwiseAND(bl))
    return F.bit_count(low) + 2 * (F.bit_count(high) - F.bit_count(both)) + 5 * F.bit_count(both.bitwiseAND(three))


def distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Distance of two packed digests given as dicts of PARTS."""
    out = head_distance(a["head"], b["head"])
    for h, l in zip(UPPER, LOWER):
        out = out + plane_distance(a[h], a[l], b[h], b[l])
    return out


def equal_values(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """How many of the 128 two-bit values agree."""
    out = F.lit(128)
    for h, l in zip(UPPER, LOWER):
        out = out - F.bit_count(a[h].bitwiseXOR(b[h]).bitwiseOR(a[l].bitwiseXOR(b[l])))
    return out


def parts(df, prefix: str = "") -> dict[str, Column]:
    return {p: df[f"{prefix}{p}"] for p in PARTS}


def bits(names: tuple[str, str], start: int, n: int) -> Column:
    """Bits start..start+n-1 (n <= 31) of a plane of 128 bits as an int, the first one highest."""
    i, off = divmod(start, 64)
    if off + n <= 64:
        return F.shiftrightunsigned(F.col(names[i]), 64 - off - n).bitwiseAND(F.lit(2**n - 1).cast("long")).cast("int")
    lo = off + n - 64
    hi = F.col(names[i]).bitwiseAND(F.lit(2 ** (n - lo) - 1).cast("long"))
    return F.shiftleft(hi, lo).bitwiseOR(F.shiftrightunsigned(F.col(names[i + 1]), 64 - lo)).cast("int")
