"""End-to-end ingest: the collector's pushes -> long samples -> store tiers.

Two streaming queries share one source:

* raw tier: unstack -> unnest -> dedup -> ``foreachBatch`` fan-out into the
  partitioned sample store (one idempotent folder per batch id);
* rollup tier: the same long rows -> tumbling MAX with a watermark -> append.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.patterns import plugin_of
from . import ingest as I


def long_samples(spark: SparkSession, path: str, delay: str, recursive: bool = False,
                 keep_event_time: bool = False, max_files_per_trigger: int | None = None) -> DataFrame:
    stacks = I.read_samples(spark, path, I.STACK_SCHEMA, max_files_per_trigger=max_files_per_trigger, recursive=recursive)
    return I.dedup(I.unnest(I.unstack(stacks)), delay=delay, keep_event_time=keep_event_time)


def ingest_to_store(spark: SparkSession, source: str, store: str, checkpoint: str, delay: str = "60 seconds",
                    available_now: bool = False, recursive: bool = False,
                    max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Raw tier: every micro-batch appended to ``store`` (partitioned by day
    and plugin), written once per batch id so a retried batch does not duplicate."""
    from pyspark.sql import functions as F
    rows = long_samples(spark, source, delay, recursive, max_files_per_trigger=max_files_per_trigger) \
        .withColumn("plugin", plugin_of("tbl")).withColumn("day", F.to_date("ts"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("day", "plugin").parquet(os.path.join(store, f"batch={batch_id}"))

    w = rows.select("entity", "tbl", "metric", "ts", "value", "day", "plugin").writeStream \
        .foreachBatch(I.fan_out([write])).option("checkpointLocation", os.path.join(checkpoint, "raw"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def rollup_to_store(spark: SparkSession, source: str, store: str, checkpoint: str, width: str,
                    delay: str = "60 seconds", points_per_bucket: int | None = None,
                    available_now: bool = False, recursive: bool = False,
                    max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Rollup tier: tumbling MAX windows, appended once the watermark closes them."""
    rows = long_samples(spark, source, delay, recursive, keep_event_time=True, max_files_per_trigger=max_files_per_trigger)
    t = I.tumbling_max(rows, width, delay, points_per_bucket=points_per_bucket)
    w = (t.writeStream.format("parquet").option("path", store)
         .option("checkpointLocation", os.path.join(checkpoint, "rollup")).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()
