"""Windows of digests and their winnowed fingerprints: keys by which near digests meet.

A digest body is a string of 128 two-bit values in which an edit changes values in place, so equal passages
lie at equal offsets. The string is cut into 11 windows of 11 or 12 values. A window keeps one fingerprint:
the smallest rolling hash of its grams of 11 values, with window and place. Two windows that are equal keep
the same fingerprint.

Which windows must agree follows from the distance: within distance 10 at most 10 windows differ, so one of 11
is equal. Within distance 20, ten windows of distance 2 or more would use it up and leave the eleventh equal; so
one of the first ten windows lies within distance 1, or the last is equal. The asking side therefore also asks
for the fingerprints of every window one step away (neighbourhood seeds); the answering side keeps its own only.
No pair within the distance is missed, at 11 kept and, for distance 20, about 190 asked fingerprints a digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.digest import LOWER, UPPER, bits, length_value

GRAM = 11
SIZES = (12,) * 7 + (11,) * 4
LONG = SIZES.index(11)
PLANE, MASK = 2**GRAM - 1, 4**GRAM - 1
ODD = 0x2545F491 & MASK | 1


def _rolled(upper: Column, lower: Column, place: int) -> Column:
    """The rolling hash of a gram, its bits scrambled one to one, with the place of the gram in its window."""
    gram = F.shiftleft(upper, GRAM).bitwiseOR(lower).cast("long")
    mixed = (gram * F.lit(ODD).cast("long")).bitwiseAND(F.lit(MASK).cast("long")).cast("int")
    mixed = mixed.bitwiseXOR(F.shiftrightunsigned(mixed, 9))
    return F.shiftleft(mixed, 1).bitwiseOR(F.lit(place))


def fingerprint(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep, window, fp (28 bits: window number and smallest rolling hash of its grams) for rows of windows."""
    low = lambda c: F.col(c).bitwiseAND(F.lit(PLANE))
    last = _rolled(low("upper"), low("lower"), 0)
    pair = F.least(_rolled(F.shiftrightunsigned("upper", 1), F.shiftrightunsigned("lower", 1), 0), _rolled(low("upper"), low("lower"), 1))
    return df.select(*keep, "window", F.shiftleft("window", 2 * GRAM + 1).bitwiseOR(F.when(F.col("window") < LONG, pair).otherwise(last)).alias("fp"))


def windows(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row a window: keep, window, and the two planes of its values."""
    starts = [sum(SIZES[:i]) for i in range(len(SIZES))]
    each = (F.struct(F.lit(i).alias("window"), bits(UPPER, s, n).alias("upper"), bits(LOWER, s, n).alias("lower")) for i, (s, n) in enumerate(zip(starts, SIZES)))
    return df.select(*keep, F.inline(F.array(*each)))


def kept(df: DataFrame, keep: list[str]) -> DataFrame:
    """The 11 fingerprints of each digest: keep, window, fp."""
    return fingerprint(windows(df, keep), keep)


def asked(df: DataFrame, keep: list[str]) -> DataFrame:
    """The fingerprints of each window and, but for the last window, of all windows one step away.

    A step raises or lowers one value by 1: its lower bit flips, and its upper bit flips with a carry.
    """
    steps = F.explode(F.array(*(F.lit(i) for i in range(-max(SIZES), max(SIZES) + 1))))
    rows = windows(df, keep).select(*keep, "window", "upper", "lower", steps.alias("step"))
    rows = rows.withColumn("at", F.expr("CASE WHEN step = 0 THEN 0 ELSE shiftleft(1, abs(step) - 1) END"))
    size = F.when(F.col("window") < LONG, 12).otherwise(11)
    can = F.when(F.col("step") > 0, F.expr("(upper & lower & at) = 0")).otherwise(F.expr("((upper | lower) & at) <> 0"))
    rows = rows.where((F.col("step") == 0) | ((F.abs("step") <= size) & (F.col("window") < len(SIZES) - 1) & can))
    carry = F.expr("CASE WHEN step > 0 THEN lower & at ELSE ~lower & at END")
    return fingerprint(rows.select(*keep, "window", F.col("upper").bitwiseXOR(carry).alias("upper"), F.col("lower").bitwiseXOR(F.col("at")).alias("lower")), keep)


def banded(fps: DataFrame, head: str, reach: int, neighbours: bool) -> DataFrame:
    """key: fp with the length value's band of 8.

    Length values more than `reach` apart exceed the distance by themselves. One side (neighbours) also goes
    to the bands that lie within reach, so the other may keep to its own.
    """
    v = length_value(F.col(head))
    one = lambda d: F.shiftright((v + d).bitwiseAND(F.lit(255)), 3)
    band = F.explode(F.array_distinct(F.array(one(-reach), one(0), one(reach)))) if neighbours else one(0)
    return fps.select("*", band.alias("band")).withColumn("key", F.shiftleft(F.col("band").cast("long"), 40).bitwiseOR(F.col("fp"))).drop("band")
