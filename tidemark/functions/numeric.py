"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(c: Column, digits: int = 4) -> Column:
    """Round half up with plain IEEE steps (``floor(x * 10^d + 0.5) / 10^d``).

    Deterministic across engines (the SQL oracle uses the same steps), unlike
    decimal-string rounding whose ties differ between engines.
    """
    m = 10 ** digits
    return F.floor(c * F.lit(float(m)) + F.lit(0.5)) / F.lit(float(m))
