"""What each row of a series knows of the rows before it, in one slice pass.

Least and greatest value, the value k rows back and an exponentially decayed
sum are states that combine across slices: a slice hands on its extremes, its
last k rows and its sum as of its end, one row a slice, and every row joins the
state of the slices before its own (see :mod:`seqwindow`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecols import epoch_us
from .seqwindow import DEFAULT_SPLIT_S, _Slices

#: Half-lives after which a row no longer shows in a double (2 ** -64 of its value).
FORGOTTEN = 64
#: Half-lives in a slice at most: weights within a slice stay below 2 ** 256.
SLICE_HALF_LIVES = 256


def history(df: DataFrame, keys: Sequence[str] | str, ts: str, value: str, tiebreak: Sequence[str] | str = (),
            back: Sequence[int] = (), half_life_s: float | None = None, split_s: int = DEFAULT_SPLIT_S) -> DataFrame:
    """``df`` with ``prev_min``, ``prev_max`` (of all earlier rows; nulls do not count), ``back_<k>`` for
    each k of ``back`` (the value k rows earlier, null if there is none) and, with a half-life,
    ``decayed_sum``: the sum over earlier rows of ``value * 2 ** (-age / half_life_s)``.

    What a row of a slice needs of the slices before is bounded: two numbers, the last ``max(back)``
    values, and one sum.
    """
    if half_life_s is not None and split_s > SLICE_HALF_LIVES * half_life_s:
        split_s = max(1, int(SLICE_HALF_LIVES * half_life_s))
    most, width_us = max([0, *back]), int(split_s) * 1_000_000
    s = _Slices(df, keys, ts, tiebreak, split_s)
    v, first = s.value(value), Window.unboundedPreceding
    upto, before = s.local.rowsBetween(first, 0), s.local.rowsBetween(first, -1)
    earlier = s.across.rowsBetween(first, -1)
    state: dict[str, Column] = {"__mn": F.min(v).over(upto), "__mx": F.max(v).over(upto)}
    local: dict[str, Column] = {"__mn": F.min(v).over(before), "__mx": F.max(v).over(before)}
    carried: dict[str, Column] = {"__cmn": F.min("__mn").over(earlier), "__cmx": F.max("__mx").over(earlier)}
    told = [F.least("__mn", "__cmn").alias("prev_min"), F.greatest("__mx", "__cmx").alias("prev_max")]
    if most:
        # a slice has at least one row, so the last k rows before a slice are in the k slices before it
        state["__tail"] = F.collect_list(F.struct(v.alias("v"))).over(s.local.rowsBetween(1 - most, 0))
        tails = F.flatten(F.collect_list("__tail").over(s.across.rowsBetween(-most, -1)))
        carried["__tails"] = tails
        local["__rn"] = F.row_number().over(s.local)
        for k in back:
            local[f"__b{k}"] = F.lag(v, k).over(s.local)
            at = F.size("__tails") + F.col("__rn") - k  # place in the rows before the slice, from 1
            old = F.when(at >= 1, F.try_element_at("__tails", at).getField("v"))
            told.append(F.when(F.col("__rn") > k, F.col(f"__b{k}")).otherwise(old).alias(f"back_{k}"))
    if half_life_s is not None:
        age = (epoch_us(s.value(ts)) - F.col(s.sb) * width_us) / F.lit(1e6 * half_life_s)  # since the slice began, in half-lives
        grown = v.cast("double") * F.pow(F.lit(2.0), age)
        state["__sum"] = F.sum(grown).over(upto)
        local["__sum"], local["__age"] = F.sum(grown).over(before), age
        reach = -(-int(FORGOTTEN * half_life_s) // int(split_s)) - 1
        sums = F.collect_list(F.struct(F.col(s.sb).alias("b"), F.coalesce("__sum", F.lit(0.0)).alias("x"))).over(s.across.rangeBetween(reach * -1 - 1, -1))
        lives = F.lit(float(split_s) / half_life_s)
        carried["__csum"] = F.aggregate(sums, F.lit(0.0), lambda a, r: a + r["x"] * F.pow(F.lit(2.0), (r["b"] - F.col(s.sb)) * lives))
        whole = F.coalesce("__sum", F.lit(0.0)) + F.coalesce("__csum", F.lit(0.0))
        told.append((whole * F.pow(F.lit(2.0), -F.col("__age"))).alias("decayed_sum"))
    carry = s.carried(s.ends(s.rows.withColumns(state)), **carried)
    return s.stitch(s.rows.withColumns(local), carry, *told)
