"""A counter-based random column: draw k is a pure function of the seed and k.

The generator's state grows by a constant, so no state is carried: draws are a column over
``spark.range``, or an array from any place on, and come out the same in any partitioning.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = 0x6D2B79F5
MASK = 0xFFFFFFFF


def _mul(a: Column, b: Column) -> Column:
    """a * b modulo 2**32 without overflow of 64 bits."""
    low = a.bitwiseAND(F.lit(0xFFFF)) * b
    high = F.shiftleft((F.shiftright(a, 16) * b).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low + high).bitwiseAND(F.lit(MASK))


def mulberry(seed: Column, k: Column) -> Column:
    """Draw ``k`` (from 0) in [0, 1); both arguments are BIGINT, ``k`` below 2**31."""
    mask = F.lit(MASK)
    state = (seed.bitwiseAND(mask) + _mul((k + 1).bitwiseAND(mask), F.lit(STEP).cast("bigint"))).bitwiseAND(mask)
    t = _mul(state.bitwiseXOR(F.shiftright(state, 15)), state.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + _mul(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(mask))
    return t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0)


def mulberry_array(seed: int, first: int, n: int) -> np.ndarray:
    """Draws ``first`` to ``first + n - 1`` in [0, 1), the same as ``mulberry`` gives."""
    s = np.arange(n, dtype=np.uint32) * np.uint32(STEP) + np.uint32((seed + (first + 1) * STEP) & MASK)
    t = (s ^ (s >> np.uint32(15))) * (s | np.uint32(1))
    t ^= t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61))
    return (t ^ (t >> np.uint32(14))) / 4294967296.0


def mulberry_sql(seed: str, k: str) -> str:
    """The same draw as a scalar subquery of DuckDB."""
    s = f"((({seed})::hugeint + (({k}) + 1)::hugeint * {STEP}) % 4294967296)::bigint"
    return (
        f"(select xor(t2, t2 >> 14) / 4294967296.0 from (select xor(t1, ((t1::hugeint + (xor(t1, t1 >> 7)::hugeint * (t1 | 61)::hugeint) % 4294967296) % 4294967296)::bigint) as t2 "
        f"from (select ((xor(s0, s0 >> 15)::hugeint * (s0 | 1)::hugeint) % 4294967296)::bigint as t1 from (select {s} as s0))))"
    )
