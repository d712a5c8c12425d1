"""Deterministic, partition-independent pseudo-random columns (M5).

Everything is derived from ``md5`` of a tagged key, so a row gets the same
value whatever the partitioning, the executor count or a task retry.
``F.rand``/``F.randn`` depend on the partition layout and are never used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: 2**32 + 1, the divisor that maps a 32-bit word w to (w+1)/(2**32+1) in (0, 1).
WORD_SPAN = 4294967297.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def hash_hex(*parts) -> Column:
    """md5 hex of ``part1|part2|...`` (all parts cast to string)."""
    return F.md5(F.concat_ws("|", *[_c(p).cast("string") for p in parts]))


def hex_word(h: Column, i: int) -> Column:
    """i-th 32-bit word (8 hex digits) of an md5 hex string, as double."""
    return F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("double")


def uniform01(h: Column, i: int = 0) -> Column:
    """Open-interval uniform from word i of the hash."""
    return (hex_word(h, i) + F.lit(1.0)) / F.lit(WORD_SPAN)


def std_normal(*parts) -> Column:
    """Box-Muller standard normal from words 1 and 2 of md5(parts)."""
    h = hash_hex(*parts)
    u1 = uniform01(h, 0)
    u2 = uniform01(h, 1)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def gaussian_noise(sigma: float, *parts) -> Column:
    """``N(0, sigma)`` noise keyed by ``parts``; exactly 0 when sigma is 0."""
    if not sigma:
        return F.lit(0.0)
    return F.lit(float(sigma)) * std_normal(*parts)
