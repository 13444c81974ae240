"""Series aggregates: per-series statistics, sum across instances, latest
value, share of total, time buckets and multi-tier rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecols import bucket_start

# Consolidation tiers of the round-robin store
# (step seconds, rows kept): 5 s x 1 day, 60 s x 7 days, 1 h x 31 days, 3 h x 3 years.
DEFAULT_TIERS = ((5, 17280), (60, 10080), (3600, 744), (10800, 8784))
DEFAULT_XFF = 0.5
SAMPLE_STEP_S = 5          # collector interval
BUCKET_POINT_LIMIT = 400   # max points before the store buckets by max


# ---------------------------------------------------------- A1..A4 --------
def total(v="value") -> Column:
    """The store's ``count``: the sum of the non-null values (0 when none)."""
    return F.coalesce(F.sum(v).cast("double"), F.lit(0.0))


def mean_over_points(v="value") -> Column:
    """The store's ``avg``: sum of non-nulls divided by all points, nulls included."""
    return F.try_divide(F.sum(v).cast("double"), F.count(F.lit(1)))


def max_floor0(v: str = "value") -> Column:
    """The store's ``max``: never below 0."""
    return F.greatest(F.coalesce(F.max(v), F.lit(0.0)), F.lit(0.0))


def series_stats(df: DataFrame, keys: Sequence[str] = ("entity", "tbl", "metric")) -> DataFrame:
    """total / avg / max / min per series (partial + final hash aggregate)."""
    return df.groupBy(*keys).agg(total().alias("total"), mean_over_points().alias("avg"),
                                 max_floor0().alias("max"), F.min("value").alias("min"),
                                 F.count(F.lit(1)).alias("points"))


# ---------------------------------------------------------------- A5 ------
def sum_instances(series: DataFrame, by: Sequence[str] = ("chart_ord", "item_ord")) -> DataFrame:
    """[SUM] over instances aligned on time: null + v = v, null + null = null."""
    return (series.groupBy(*by, "ts")
            .agg(F.first("chart_title").alias("chart_title"), F.first("item_title").alias("item_title"),
                 F.sum("value").cast("double").alias("value"), F.count("value").alias("n_instances")))


# ------------------------------------------------------------ A9, A10 -----
def latest_value(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latest non-null value per series (max_by over non-null points)."""
    nn = df.where(F.col("value").isNotNull())
    return nn.groupBy(*keys).agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))


def share_of_total(latest: DataFrame, group: Sequence[str], exclude_title: str = "total") -> DataFrame:
    """Percentage of each item's latest value within its chart, rounded.

    ``latest`` has one row per item (bounded by the chart layout), so the
    window over the chart is over a handful of rows.
    """
    d = latest.where(F.col("item_title") != exclude_title) if "item_title" in latest.columns else latest
    w = Window.partitionBy(*group)
    share = F.try_divide(F.col("value") * 100.0, F.sum("value").over(w))
    return d.withColumn("share_pct", F.floor(share + F.lit(0.5)).cast("double"))


# ---------------------------------------------------------------- A6 ------
def bucket_width(range_s: float, step_s: int = SAMPLE_STEP_S, limit: int = BUCKET_POINT_LIMIT) -> int | None:
    """Bucket width used by the store: ``int(range / limit)`` once the range
    holds more than ``limit`` collector steps, else None (raw points)."""
    if range_s / step_s > limit:
        return int(range_s / limit)
    return None


def bucket_max(df: DataFrame, keys: Sequence[str], range_s: float,
               step_s: int = SAMPLE_STEP_S, limit: int = BUCKET_POINT_LIMIT) -> DataFrame:
    """Server-side bucketed max for long ranges; raw points otherwise."""
    w = bucket_width(range_s, step_s, limit)
    if w is None:
        return df.select(*keys, "ts", "value")
    return (df.groupBy(*keys, bucket_start("ts", w).alias("ts"))
            .agg(F.max("value").alias("value")))


# ---------------------------------------------------------------- A7 ------
def rollup_tier(df: DataFrame, keys: Sequence[str], base_step_s: int, tier_step_s: int,
                rows_kept: int | None = None, now=None, xff: float = DEFAULT_XFF) -> DataFrame:
    """One consolidation tier: MAX per epoch-aligned bucket, null when more
    than ``xff`` of the bucket's ``tier_step_s / base_step_s`` points are
    unknown; then the tier's retention (``rows_kept`` buckets before ``now``)."""
    n = tier_step_s // base_step_s
    g = (df.groupBy(*keys, bucket_start("ts", tier_step_s).alias("ts"))
         .agg(F.max("value").alias("mx"), F.count("value").alias("known")))
    out = g.select(*keys, "ts", F.lit(tier_step_s).alias("step_s"),
                   F.when(F.col("known") >= F.lit(xff * n), F.col("mx")).alias("value"))
    if rows_kept is not None and now is not None:
        from ..functions.timecols import add_seconds, to_ntz_literal
        out = out.where(F.col("ts") > add_seconds(to_ntz_literal(now), -rows_kept * tier_step_s))
    return out


def rollup_tiers(df: DataFrame, keys: Sequence[str], base_step_s: int,
                 tiers: Sequence[tuple[int, int]] = DEFAULT_TIERS, now=None,
                 xff: float = DEFAULT_XFF) -> DataFrame:
    """All tiers in one pass over the samples: a row counts for a bucket of each tier, which the
    partial aggregate combines before anything is shuffled."""
    from ..functions.timecols import add_seconds, to_ntz_literal
    used = [(step, keep) for step, keep in tiers if step >= base_step_s]
    buckets = F.array(*[F.struct(F.lit(step).cast("int").alias("step_s"), bucket_start("ts", step).alias("bucket")) for step, _ in used])
    g = df.select(*keys, "value", F.inline(buckets)).groupBy(*keys, "step_s", "bucket") \
        .agg(F.max("value").alias("mx"), F.count("value").alias("known"))
    out = g.select(*keys, F.col("bucket").alias("ts"), "step_s",
                   F.when(F.col("known") >= F.lit(xff) * F.floor(F.col("step_s") / F.lit(base_step_s)), F.col("mx")).alias("value"))
    if now is None:
        return out
    kept = F.lit(False)
    for step, keep in used:
        kept = kept | ((F.col("step_s") == step) & (F.col("ts") > add_seconds(to_ntz_literal(now), -keep * step)))
    return out.where(kept)


def chained_tiers(df: DataFrame, keys: Sequence[str], base_step_s: int, tiers: Sequence[int], xff: float = DEFAULT_XFF) -> DataFrame:
    """Rollup tiers, each from the buckets of the tier below: a bucket carries its maximum and the number of
    known base points, so a tier is the same as one made from the samples, and the samples are shuffled
    once, combined, by the lowest tier.  ``tiers``: widths in seconds, each a multiple of the one before."""
    for a, b in zip(tiers, tiers[1:]):
        if b % a:
            raise ValueError(f"{b} s is no multiple of {a} s")
    lowest = df.groupBy(*keys, bucket_start("ts", tiers[0]).alias("ts")).agg(F.max("value").alias("value"), F.count("value").alias("known"))
    # a bucket counts for each tier above: its own row and those of the tiers, which combine before they are shuffled
    steps = F.array(*[F.struct(F.lit(step).cast("int").alias("step_s"), bucket_start("ts", step).alias("bucket")) for step in tiers])
    up = lowest.select(*keys, "value", "known", F.inline(steps)).groupBy(*keys, "step_s", "bucket") \
        .agg(F.max("value").alias("value"), F.sum("known").alias("known"))
    enough = F.col("known") >= F.lit(xff) * F.floor(F.col("step_s") / F.lit(base_step_s))
    return up.select(*keys, F.col("bucket").alias("ts"), "step_s", F.when(enough, F.col("value")).alias("value"), "known")


def choose_tier(start_age_s: float, tiers: Sequence[tuple[int, int]] = DEFAULT_TIERS) -> int | None:
    """Resolution routing: the first tier whose retention covers ``now - start``."""
    for step, keep in tiers:
        if start_age_s <= step * keep:
            return step
    return None


# --------------------------------------------------------------- A17 ------
def per_sample_rollup(df: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Per host and sample: number of rows and sums of the given columns."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in sums])
