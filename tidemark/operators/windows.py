"""Ordered per-series operators: deltas, rates, change per second, history
expressions, last-observation-carried-forward, stacks, duplicate guard.

All of them use the skew-safe helpers of :mod:`seqwindow`, never a window
partitioned by the series key alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecols import epoch_us, whole_seconds_between
from .seqwindow import DEFAULT_SPLIT_S, carry_forward, prev_row

SERIES_KEY = ("entity", "tbl", "metric")


def with_kind(df: DataFrame, catalog: DataFrame, plugin_col: Column | None = None) -> DataFrame:
    """Kind lookup: join the (tiny, broadcast) metric catalog on (plugin, metric)."""
    from ..functions.patterns import plugin_of
    p = plugin_col if plugin_col is not None else plugin_of("tbl")
    return df.withColumn("plugin", p).join(F.broadcast(catalog), ["plugin", "metric"], "left")


def dedup_first(df: DataFrame, keys: Sequence[str] = SERIES_KEY, ts: str = "ts",
                arrival: str = "seq") -> DataFrame:
    """Duplicate-timestamp guard: keep the first arrival per (series, ts).

    An aggregate (partial + final), so a hot series is pre-combined map-side.
    """
    others = [c for c in df.columns if c not in (*keys, ts)]
    first = F.min_by(F.struct(*[F.col(c) for c in others]), F.col(arrival))
    return df.groupBy(*keys, ts).agg(first.alias("__r")).select(*keys, ts, "__r.*")


def raw_delta(df: DataFrame, keys: Sequence[str] = SERIES_KEY, kind_col: str = "kind",
              tiebreak: Sequence[str] | str = (), split_s: int | None = DEFAULT_SPLIT_S) -> DataFrame:
    """Non-gauges: ``v - prev`` (first sample 0, resets stay negative); gauges unchanged."""
    d = prev_row(df, keys, "ts", ["value"], tiebreak=tiebreak, split_s=split_s)
    delta = F.coalesce(F.col("value") - F.col("prev_value"), F.lit(0.0))
    return d.withColumn("delta", F.when(F.col(kind_col) == "GAUGE", F.col("value")).otherwise(delta)) \
            .drop("prev_ts", "prev_value")


def fixed_rate(df: DataFrame, step_s: float, keys: Sequence[str] = SERIES_KEY, kind_col: str = "kind",
               tiebreak: Sequence[str] | str = (), split_s: int = DEFAULT_SPLIT_S) -> DataFrame:
    """``(v - prev) / step`` with a declared step; first sample 0; gauges unchanged."""
    d = prev_row(df, keys, "ts", ["value"], tiebreak=tiebreak, split_s=split_s)
    rate = F.coalesce((F.col("value") - F.col("prev_value")) / F.lit(float(step_s)), F.lit(0.0))
    return d.withColumn("rate", F.when(F.col(kind_col) == "GAUGE", F.col("value")).otherwise(rate)) \
            .drop("prev_ts", "prev_value")


def counter_rate(df: DataFrame, keys: Sequence[str] = SERIES_KEY, heartbeat_col: str = "heartbeat_s",
                 min_col: str = "min_v", max_col: str = "max_v", kind_col: str = "kind",
                 tiebreak: Sequence[str] | str = (), split_s: int = DEFAULT_SPLIT_S) -> DataFrame:
    """Round-robin DERIVE semantics on real sample times: ``dv / dt``; null
    without a predecessor, when ``dt`` exceeds the heartbeat or is 0, or when
    the result leaves ``[min, max]`` (so counter resets give null).  GAUGE
    values pass through the same bounds check."""
    d = prev_row(df, keys, "ts", ["value"], tiebreak=tiebreak, split_s=split_s)
    dt = (epoch_us("ts") - epoch_us("prev_ts")) / F.lit(1_000_000.0)
    raw = F.when(F.col(kind_col) == "GAUGE", F.col("value")).otherwise(
        F.when((dt > 0) & (dt <= F.col(heartbeat_col)),
               F.try_divide(F.col("value") - F.col("prev_value"), dt)))
    ok = (F.col(min_col).isNull() | (raw >= F.col(min_col))) & (F.col(max_col).isNull() | (raw <= F.col(max_col)))
    return d.withColumn("rate", F.when(ok, raw)).drop("prev_ts", "prev_value")


def previous_sample(df: DataFrame, entity: str = "entity", name: str = "smp_ts") -> DataFrame:
    """Add the time of the client's sample before the row's own (null: none), of short series: one window a client."""
    earlier = Window.partitionBy(entity).orderBy(epoch_us("ts")).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.max("ts").over(earlier))


def change_per_second(df: DataFrame, entity: str = "entity", item_keys: Sequence[str] = ("tbl", "metric"),
                      split_s: int | None = DEFAULT_SPLIT_S, samples: DataFrame | None = None) -> DataFrame:
    """Current vs previous *sample* of each client: a sample is all rows of an
    entity at one ts.  For every (tbl, metric) present in both samples,
    ``(v - v_prev) / whole_seconds``; skipped when no previous sample or the
    whole-second gap is 0.  Keys only in the current sample are ignored.

    A series has a value in the previous sample exactly when its own
    previous row sits at the previous sample time, so this is a per-series
    lag plus one join with the per-client sample sequence.  ``samples``: the
    rows that tell the sample times, where ``df`` has only some of the metrics.
    With ``split_s=None`` (see :mod:`seqwindow`) and without ``samples`` both
    come from windows, and nothing is joined.
    """
    whole = split_s is None and samples is None
    series = prev_row(df, [entity, *item_keys], "ts", ["value"], split_s=split_s)
    if whole:
        j = previous_sample(series, entity).where(F.col("prev_ts") == F.col("smp_ts"))
    else:
        samples = (df if samples is None else samples).select(entity, "ts").distinct()
        seq = prev_row(samples, [entity], "ts", [], prefix="smp_", split_s=split_s)
        j = series.join(seq, [entity, "ts"]).where(F.col("prev_ts") == F.col("smp_ts"))
    secs = whole_seconds_between("prev_ts", "ts")
    return (j.where(secs != 0)
            .select(entity, *item_keys, "ts", "prev_ts", secs.alias("diff_sec"),
                    ((F.col("value") - F.col("prev_value")) / secs).alias("change_per_sec")))


def locf(df: DataFrame, keys: Sequence[str], value: str = "value", default: float | None = 0.0,
         split_s: int = DEFAULT_SPLIT_S) -> DataFrame:
    """Fill missing values with the last value seen in the series (``default`` if none)."""
    d = carry_forward(df, keys, "ts", value, name="__filled", split_s=split_s)
    filled = F.coalesce(F.col("__filled"), F.lit(default)) if default is not None else F.col("__filled")
    return d.withColumn(value, filled).drop("__filled")


def prescale(df: DataFrame, step_s: float, kind_col: str = "kind") -> DataFrame:
    """DERIVE values multiplied by the sample interval, so a later per-second
    rate yields the per-interval delta."""
    return df.withColumn("value", F.when(F.col(kind_col) == "DERIVE", F.col("value") * F.lit(float(step_s)))
                         .otherwise(F.col("value")))


def stack_adjacent(series: DataFrame, cumulative: bool = False) -> DataFrame:
    """For charts whose layout has the ``#stack`` flag (column ``stack``): an item
    ``stack`` placed first, (last item) + (item before it) per time, null where
    either is null; ``cumulative=True`` stacks every item instead.  Other charts
    pass unchanged.  Windows are per (chart, ts): a handful of items, never a
    whole series."""
    flagged = series.where("stack")
    w = Window.partitionBy("chart_ord", "entity", "tbl", "ts").orderBy("item_ord")
    total = F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)) if cumulative else F.col("value") + F.lag("value").over(w)
    top = F.col("item_ord") == F.max("item_ord").over(Window.partitionBy("chart_ord", "entity", "tbl", "ts"))
    title = F.concat(F.lit("stack, "), F.col("chart_title")).alias("chart_title")
    cols = [c for c in ("chart_ord", "item_ord", "item_title", "entity", "tbl", "ts", "value")]
    stacked = flagged.withColumn("__s", total).withColumn("__top", top).where("__top").select(
        "chart_ord", title, F.lit(-1).alias("item_ord"), F.lit("stack").alias("item_title"), "entity", "tbl", "ts", F.col("__s").alias("value"))
    return stacked.unionByName(flagged.select(title, *cols)).unionByName(series.where(~F.col("stack")).select("chart_title", *cols))
