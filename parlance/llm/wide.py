"""Integers of any size in three columns (high, middle, low limb), so that Spark orders them as integers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LIMB = 62
HALF = (1 << LIMB) - 1
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
LIMBS = "h long, m long, l long"


def limbs(values) -> dict[str, list[int]]:
    """The limbs h, m and l of each value."""
    wide = [int(v) for v in values]
    return {"h": [v >> 2 * LIMB for v in wide], "m": [(v >> LIMB) & HALF for v in wide], "l": [v & HALF for v in wide]}


def descending() -> list[Column]:
    return [F.desc("h"), F.desc("m"), F.desc("l")]


def saturated() -> Column:
    """The value as a long; beyond 64 bits the nearest long."""
    joined = lambda m: F.shiftleft(m, LIMB).bitwiseOR(F.col("l"))
    whole = F.when((F.col("h") == 0) & (F.col("m") <= 1), joined(F.col("m"))).when((F.col("h") == -1) & (F.col("m") >= HALF - 1), joined(F.col("m") - (HALF + 1)))
    return whole.when(F.col("h") >= 0, F.lit(int(HIGHEST))).otherwise(F.lit(int(LOWEST)))


def value(h: int, m: int, l: int) -> int:  # noqa: E741
    return (h << 2 * LIMB) + (m << LIMB) + l
