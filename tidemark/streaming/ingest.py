"""Structured Streaming ingest: sample files -> long samples -> rollups,
dedup, fan-out writes and the alarm sink."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.timecols import from_instant, to_instant

EVENT_TIME = "__event_time"

LONG_SCHEMA = "entity string, tbl string, metric string, ts timestamp_ntz, value double"
NESTED_SCHEMA = ("sample struct<client: string, datetime: timestamp_ntz, "
                 "tables: map<string, map<string, double>>>")
STACK_SCHEMA = f"stack array<{NESTED_SCHEMA.split(' ', 1)[1]}>"


def read_samples(spark: SparkSession, path: str, schema: str = LONG_SCHEMA, fmt: str = "parquet",
                 max_files_per_trigger: int | None = None, recursive: bool = False) -> DataFrame:
    """File source of sample batches (the collector's periodic pushes)."""
    r = spark.readStream.format(fmt).schema(schema)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def unstack(stream: DataFrame) -> DataFrame:
    """A stacked batch (array of samples) -> one row per sample."""
    return stream.select(F.explode("stack").alias("sample"))


def unnest(stream: DataFrame) -> DataFrame:
    """Nested sample -> long rows (explode tables, then metrics)."""
    t = stream.select(F.col("sample.client").alias("entity"), F.col("sample.datetime").alias("ts"),
                      F.explode("sample.tables").alias("tbl", "m"))
    return t.select("entity", "tbl", F.explode("m").alias("metric", "value"), "ts") \
            .select("entity", "tbl", "metric", "ts", "value")


def dedup(stream: DataFrame, delay: str = "60 seconds",
          keys: Sequence[str] = ("entity", "tbl", "metric", "ts"), keep_event_time: bool = False) -> DataFrame:
    """Late / duplicate samples: a repeated (series, ts) inside the watermark
    delay is dropped, keeping state bounded by the delay.  With
    ``keep_event_time`` the watermarked column stays for later windows."""
    d = stream.withColumn(EVENT_TIME, to_instant("ts")).withWatermark(EVENT_TIME, delay)
    d = d.dropDuplicatesWithinWatermark(list(keys))
    return d if keep_event_time else d.drop(EVENT_TIME)


def tumbling_max(stream: DataFrame, width: str, delay: str, xff: float = 0.5, points_per_bucket: int | None = None,
                 keys: Sequence[str] = ("entity", "tbl", "metric")) -> DataFrame:
    """Rollup tier on a stream: MAX per tumbling window, emitted once the
    watermark passes the window end (append mode); null when too few points
    are known (``count >= xff * points_per_bucket``).  An upstream watermark
    (from :func:`dedup` with ``keep_event_time``) is reused."""
    src = stream if EVENT_TIME in stream.columns else \
        stream.withColumn(EVENT_TIME, to_instant("ts")).withWatermark(EVENT_TIME, delay)
    g = (src.groupBy(*keys, F.window(EVENT_TIME, width).alias("w"))
         .agg(F.max("value").alias("mx"), F.count("value").alias("known")))
    val = F.col("mx") if points_per_bucket is None else \
        F.when(F.col("known") >= F.lit(xff * points_per_bucket), F.col("mx"))
    return g.select(*keys, from_instant("w.start").alias("ts"), val.alias("value"), "known")


def chained_tiers(stream: DataFrame, base_step_s: int, tiers: Sequence[int], delay: str = "60 seconds", xff: float = 0.5,
                  keys: Sequence[str] = ("entity", "tbl", "metric"), ts: str = "ts") -> list[DataFrame]:
    """Rollup tiers, each a window over the windows of the tier below, which are closed by the same
    watermark: a tier keeps the maximum and how many of its base points are known, so that ``xff`` asks
    for the points and not for the buckets below.  ``tiers``: widths in seconds, each a multiple of the
    one before.  One DataFrame a tier (``keys, ts, step_s, value, known``); the samples are read by the
    lowest window only."""
    for a, b in zip(tiers, tiers[1:]):
        if b % a:
            raise ValueError(f"{b} s is no multiple of {a} s")
    own = stream.withColumn(EVENT_TIME, to_instant(ts)).withWatermark(EVENT_TIME, delay)
    level, out = own.withColumn("known", F.when(F.col("value").isNotNull(), 1).otherwise(0)), []
    for step in tiers:
        time = F.col(EVENT_TIME) if not out else F.window_time("w")
        level = level.groupBy(*keys, F.window(time, f"{step} seconds").alias("w")).agg(F.max("value").alias("value"), F.sum("known").alias("known"))
        out.append(level.select(*keys, from_instant("w.start").alias("ts"), F.lit(step).alias("step_s"),
                                F.when(F.col("known") >= F.lit(xff) * (step // base_step_s), F.col("value")).alias("value"), "known"))
    return out


def fan_out(targets: Sequence[Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body writing one micro-batch to several stores in
    order; the first failure stops the batch (and the query retries it)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        for t in targets:
            t(batch, batch_id)
    return run


def parquet_target(path: str, partition_by: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """Idempotent-by-batch append: each batch goes to its own sub-folder, so a
    retried batch overwrites its own output instead of duplicating it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        w = batch.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(f"{path.rstrip('/')}/batch={batch_id}")
    return write


def alarm_sink(alarms: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Alarm sink: append alarms to parquet (exactly-once file sink)."""
    return (alarms.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append"))
