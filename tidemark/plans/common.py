"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numeric import rnd  # noqa: F401


def cents(col: str) -> Column:
    """Exact 2-decimal summation: values are sums of money / counts, so a
    DECIMAL sum cast back to double is identical in every engine (a double
    sum depends on the order of additions)."""
    return F.col(col).cast("decimal(18,2)")
