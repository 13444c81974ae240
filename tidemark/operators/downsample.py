"""Min/max downsampling of series to at most ``2 * resolution`` points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecols import epoch_us
from .seqwindow import DEFAULT_SPLIT_S, position

DEFAULT_RESOLUTION = 400  # chart resolution; sampling starts at 2x this many points


def downsample_minmax(df: DataFrame, keys: Sequence[str], resolution: int = DEFAULT_RESOLUTION,
                      split_s: int | None = DEFAULT_SPLIT_S) -> DataFrame:
    """Series with fewer than ``2R`` points are kept.  Otherwise points are cut,
    in time order, into buckets of ``per = n // R`` points (null points count);
    each complete bucket yields its first minimum and first maximum point in
    time order (one point when they coincide); the trailing partial bucket and
    all-null buckets yield nothing.  If fewer than ``R / 2`` points come out,
    the original series is kept.

    Positions come from the skew-safe :func:`position`; the per-bucket
    min/max is a partial+final aggregate, so a hot series is reduced map-side.
    With ``split_s=None`` (see :mod:`seqwindow`) points are marked by windows
    over whole series instead, and no row is joined.
    """
    keys = list(keys)
    r = int(resolution)
    d = position(df, keys, "ts", "__pos", total_name="__n", split_s=split_s)
    per = F.floor(F.col("__n") / F.lit(r))
    bucket = F.floor((F.col("__pos") - 1) / per)
    if split_s is None:
        # a point counts if its bucket's first minimum or first maximum is at its position
        v, t, us, p = F.col("value"), F.col("ts"), epoch_us("ts"), F.col("__pos")
        used = (F.col("__n") >= 2 * r) & v.isNotNull() & (F.col("__b") < F.floor(F.col("__n") / per))
        here = Window.partitionBy(*keys, "__b")
        low = F.min(F.when(used, F.struct(v.alias("v"), t.alias("t"), p.alias("p")))).over(here)
        high = F.max(F.when(used, F.struct(v.alias("v"), (-us).alias("nt"), (-p).alias("np")))).over(here)
        b = F.when(F.col("__n") >= 2 * r, bucket)
        marked = d.select(*keys, "ts", "value", "__n", "__pos", b.alias("__b")).select(
            *keys, "ts", "value", "__n", F.coalesce(used & ((low["p"] == p) | (high["np"] == -p)), F.lit(False)).alias("__hit"))
        m = F.count(F.when(F.col("__hit"), 1)).over(Window.partitionBy(*keys))
        return marked.withColumn("__m", m).where((F.col("__n") < 2 * r) | (F.col("__m") < F.lit(r / 2.0)) | F.col("__hit")) \
            .select(*keys, "ts", "value")
    # 1) sampled points of long series (complete buckets, non-null values): a
    #    partial+final aggregate per (series, bucket); at most 2 points per bucket
    big = d.where((F.col("__n") >= 2 * r) & F.col("value").isNotNull()).withColumn("__b", bucket) \
           .where(F.col("__b") < F.floor(F.col("__n") / per))
    agg = big.groupBy(*keys, "__b").agg(
        F.min(F.struct(F.col("value").alias("v"), F.col("ts").alias("t"))).alias("mn"),
        F.max(F.struct(F.col("value").alias("v"), (-epoch_us("ts")).alias("nt"), F.col("ts").alias("t"))).alias("mx"))
    pts = agg.select(*keys, F.explode(F.array_distinct(F.array(
        F.struct(F.col("mn.t").alias("ts"), F.col("mn.v").alias("value")),
        F.struct(F.col("mx.t").alias("ts"), F.col("mx.v").alias("value"))))).alias("p"))
    sampled = pts.select(*keys, "p.ts", "p.value")   # small: <= 2R rows per series
    # 2) series whose sampling kept too few points fall back to their original rows
    counts = sampled.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m"))
    good = counts.where(F.col("__m") >= F.lit(r / 2.0)).select(*keys, F.lit(True).alias("__good"))
    kept = d.join(good, keys, "left").where((F.col("__n") < 2 * r) | F.col("__good").isNull()) \
            .select(*keys, "ts", "value")
    return kept.unionByName(sampled.join(good, keys, "left_semi"))
