"""Streaming alarms in two stages.

1. samples -> per-client change per second (keyed state) -> ``foreachBatch``:
   each micro-batch is a static DataFrame, so the batch rule operators
   (distinct-key rule matching, threshold join) run unchanged; the batch's
   alarms are written once per batch id (idempotent on retry).
2. alarm table -> per-key suppression (keyed state) -> alarm sink.

Rules on values (predicates, overlaid limits) need whole samples: these are
assembled in keyed state from the rows of any files, and each micro-batch of
them then meets the static rules with the batch operators.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.alarms import DEFAULT_SUPPRESS_S, overlay_alarms, predicate_alarms, threshold_alarms
from ..operators.rules import LambdaRule
from . import ingest as I
from . import state as ST


def detect(samples: DataFrame, rules: DataFrame, alarms_path: str, checkpoint: str,
           available_now: bool = False) -> StreamingQuery:
    return _alarm_table(ST.change_per_second(samples), lambda batch: threshold_alarms(batch, rules), alarms_path,
                        os.path.join(checkpoint, "detect"), available_now)


def _alarm_table(stream: DataFrame, alarms_of: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    """Each micro-batch's alarms as one folder of its batch id."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        alarms_of(batch).write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id:09d}"))

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def detect_predicates(samples: DataFrame, rules: Sequence[LambdaRule], metrics: Sequence[str], alarms_path: str, checkpoint: str,
                      delay: str = ST.DELAY, available_now: bool = False) -> StreamingQuery:
    """Predicate rules on a stream of long rows; ``metrics``: those that the rules name."""
    def alarms_of(batch: DataFrame) -> DataFrame:
        wide = batch.select("entity", "tbl", "ts", *[F.col("metrics")[m].alias(m) for m in metrics])
        return predicate_alarms(batch.sparkSession, wide, rules)

    return _alarm_table(ST.samples(samples, delay), alarms_of, alarms_path, os.path.join(checkpoint, "predicates"), available_now)


def detect_overlay(samples: DataFrame, entries: DataFrame, alarms_path: str, checkpoint: str,
                   delay: str = ST.DELAY, available_now: bool = False) -> StreamingQuery:
    """Overlaid limits (:func:`tidemark.operators.rules.overlay`) on a stream of long rows."""
    def alarms_of(batch: DataFrame) -> DataFrame:
        return overlay_alarms(batch.select("entity", "tbl", "ts", F.explode("metrics").alias("metric", "value")), entries)

    return _alarm_table(ST.samples(samples, delay), alarms_of, alarms_path, os.path.join(checkpoint, "overlay"), available_now)


def notify(spark, alarms_path: str, sink_path: str, checkpoint: str, window_s: int = DEFAULT_SUPPRESS_S,
           available_now: bool = False, max_files_per_trigger: int | None = None) -> StreamingQuery:
    alarms = I.read_samples(spark, alarms_path, ST.ALARM_SCHEMA, max_files_per_trigger=max_files_per_trigger, recursive=True)
    fired = ST.suppress(alarms, window_s)
    w = I.alarm_sink(fired, sink_path, os.path.join(checkpoint, "notify"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()
