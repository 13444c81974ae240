"""Scans, catalog listings, metric selection and chart layout.

A *series frame* has the columns
``chart_ord, chart_title, item_ord, item_title, entity, tbl, ts, value``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import matches
from ..functions.timecols import to_ntz_literal

SERIES_COLS = ["chart_ord", "chart_title", "item_ord", "item_title", "entity", "tbl", "ts", "value"]


# ---------------------------------------------------------------- scans ----
def range_scan(df: DataFrame, start, end, entity=None, tbl=None, metrics=None,
               ts: str = "ts") -> DataFrame:
    """Half-open time range ``start <= ts < end`` plus optional key filters.

    Plain column predicates, so they reach the parquet scan (PushedFilters).
    """
    pred = (F.col(ts) >= to_ntz_literal(start)) & (F.col(ts) < to_ntz_literal(end))
    if entity is not None:
        pred = pred & matches("entity", entity)
    if tbl is not None:
        pred = pred & matches("tbl", tbl)
    if metrics is not None:
        pred = pred & F.col("metric").isin(list(metrics))
    return df.where(pred)


def lookback_scan(df: DataFrame, start, end, lookback_s: int, ts: str = "ts") -> DataFrame:
    """Range scan widened by ``lookback_s`` so ordered operators see the
    predecessor of the first in-range row.  Filter to ``start`` afterwards."""
    from ..functions.timecols import add_seconds
    return df.where((F.col(ts) >= add_seconds(to_ntz_literal(start), -lookback_s))
                    & (F.col(ts) < to_ntz_literal(end)))


# -------------------------------------------------------------- catalog ----
def list_entities(*stores: DataFrame) -> DataFrame:
    """Distinct entities over one or more stores (union distinct)."""
    out = None
    for s in stores:
        e = s.select("entity")
        out = e if out is None else out.unionByName(e)
    return out.distinct()


def list_tables(df: DataFrame, prefix: str = "", entity: str | None = None) -> DataFrame:
    """Tables by prefix as ``entity/table`` (``startswith``, not LIKE)."""
    d = df.where(F.col("tbl").startswith(prefix)) if prefix else df
    if entity is not None:
        return d.where(F.col("entity") == entity).select("tbl").distinct()
    return d.select(F.concat_ws("/", "entity", "tbl").alias("path")).distinct()


def instance_catalog(df: DataFrame, plugin_prefix: str, exclude_prefix: str | None = None) -> DataFrame:
    """entity -> sorted list of its tables of one plugin (as text)."""
    d = df.where(F.col("tbl").startswith(plugin_prefix))
    if exclude_prefix:
        d = d.where(~F.col("tbl").startswith(exclude_prefix))
    d = d.select("entity", "tbl").distinct()
    return (d.groupBy("entity")
            .agg(F.array_join(F.sort_array(F.collect_list("tbl")), ",").alias("tables"),
                 F.count(F.lit(1)).alias("n_tables")))


def drill_down(df: DataFrame, levels: Sequence[str], chosen: Sequence[str]) -> DataFrame:
    """Next level of a catalog given values chosen for the first levels."""
    d = df
    for col, val in zip(levels, chosen):
        d = d.where(F.col(col) == val)
    nxt = levels[len(chosen)]
    return d.select(F.col(nxt).alias("choice")).distinct()


def first_instance(df: DataFrame, prefix: str, by: Sequence[str] = ("entity",)) -> DataFrame:
    """Per entity, the first table (in name order) starting with ``prefix``."""
    d = df.where(F.col("tbl").startswith(prefix))
    return d.groupBy(*by).agg(F.min("tbl").alias("tbl"))


# ------------------------------------------------------------ selection ----
def select_metrics(long_df: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    return long_df if metrics is None else long_df.where(F.col("metric").isin(list(metrics)))


def unpivot_all(wide: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide table -> long form, every metric selected (filter=None)."""
    return wide.unpivot(list(ids), list(metrics), "metric", "value")


def layout_frame(spark: SparkSession, spec: Sequence, title_prefix: str = "") -> DataFrame:
    """Chart layout from a filter list: ``'m'`` = one chart; ``['a','b']`` = one
    chart of two items; ``#``-entries are markers and skipped.

    Returns ``(chart_ord, chart_title, item_ord, item_title, metric, stack)``;
    the chart title joins the item titles with ", ".  Tiny, broadcast.
    """
    rows = []
    for ci, entry in enumerate(spec):
        items = [entry] if isinstance(entry, str) else list(entry)
        stack = any(isinstance(i, str) and i == "#stack" for i in items)
        names = [i for i in items if not (isinstance(i, str) and i.startswith("#"))]
        titles = [f"{title_prefix}{m}" for m in names]
        chart_title = ", ".join(titles)
        for ii, (m, t) in enumerate(zip(names, titles)):
            rows.append((ci, chart_title, ii, t, m, stack))
    return spark.createDataFrame(
        rows, "chart_ord int, chart_title string, item_ord int, item_title string, metric string, stack boolean")


def apply_layout(long_df: DataFrame, layout: DataFrame) -> DataFrame:
    """Long samples x layout (broadcast: the layout is a handful of rows)."""
    return (long_df.join(F.broadcast(layout), "metric")
            .select(*SERIES_COLS, "metric", "stack"))


def filter_titles(series: DataFrame, titles: Sequence[str]) -> DataFrame:
    return series.where(F.col("chart_title").isin(list(titles)))


def drop_nulls(series: DataFrame) -> DataFrame:
    return series.where(F.col("value").isNotNull())


# ---------------------------------------------------------------- shapes ---
def grid_to_points(grid: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Normalise regular-grid results (shape A/B): one row per series chunk
    with ``start`` (timestamp), ``step_s`` and ``vals`` (array of values)
    -> ``(key.., ts, value)`` with ``ts = start + pos * step``."""
    exploded = grid.select(*key_cols, "start", "step_s", F.posexplode("vals").alias("pos", "value"))
    return exploded.select(
        *key_cols,
        F.timestamp_add("SECOND", (F.col("pos") * F.col("step_s")).cast("bigint"), F.col("start")).alias("ts"),
        "value")


def points_to_grid(df: DataFrame, key_cols: Sequence[str], chunk_s: int, step_s: int) -> DataFrame:
    """Pack points into regular-grid chunks (one array per key and chunk).

    Chunks are epoch-aligned ``chunk_s`` slices, so every array holds at most
    ``chunk_s / step_s`` slots however long the series is.  A slot holds the
    last point that falls into it.
    """
    from ..functions.timecols import bucket_start, epoch_us
    d = df.withColumn("start", bucket_start("ts", chunk_s)).withColumn(
        "slot", ((epoch_us("ts") - epoch_us("start")) / F.lit(step_s * 1_000_000)).cast("int"))
    d = d.groupBy(*key_cols, "start", "slot").agg(F.max_by("value", "ts").alias("value"))
    g = d.groupBy(*key_cols, "start").agg(
        F.max("slot").alias("n"), F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("m"))
    vals = F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: F.try_element_at(F.col("m"), i))
    return g.select(*key_cols, "start", F.lit(step_s).alias("step_s"), vals.alias("vals"))


def generated_series(spark: SparkSession, x_start: int, x_end: int, step: int, fn) -> DataFrame:
    """y = fn(x) over ``range(x_start, x_end, step)``; fn maps a Column to a Column."""
    r = spark.range(x_start, x_end, step).withColumnRenamed("id", "x")
    return r.select("x", fn(F.col("x")).alias("y"))


def to_local_time(ts: Column | str, tz: str) -> Column:
    """Shift a UTC wall-clock timestamp to a time zone's wall clock."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), c)
