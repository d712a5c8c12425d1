"""Scalar column functions (M1-M4, M6).  All JVM-side expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cyclic_sin(c, period: float = 12.0) -> Column:
    """M1: ``sin(2*pi*x/period)`` rounded to 32-bit float."""
    return F.sin(F.lit(2.0 * math.pi) * _col(c) / F.lit(float(period))).cast("float")


def log1p(c) -> Column:
    """M2: ``log(1 + x)`` (double)."""
    return F.log1p(_col(c))


def square(c) -> Column:
    """M3: ``x ** 2`` (double)."""
    x = _col(c).cast("double")
    return x * x


def smoothed_mean(label_sum, label_count, prior, smoothing: float) -> Column:
    """M4: ``(n*mean + s*g) / (n + s)`` written with the label sum ``n*mean``.

    ``n == 0`` (no labelled rows for the key) gives the prior, also when
    ``s == 0`` where the plain formula would divide by zero.
    """
    s = F.lit(float(smoothing))
    n = _col(label_count).cast("double")
    g = _col(prior)
    return F.when(n > 0, (_col(label_sum).cast("double") + s * g) / (n + s)).otherwise(g)


def as_int(c) -> Column:
    """M6: integer cast of codes."""
    return _col(c).cast("int")
