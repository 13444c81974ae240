"""Clients that fall silent: the batch twin of the absence timers on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timecols import add_seconds, epoch_us, to_ntz_literal
from .seqwindow import DEFAULT_SPLIT_S, prev_row


def absences(samples: DataFrame, gap_s: float, until=None, entity: str = "entity", split_s: int = DEFAULT_SPLIT_S) -> DataFrame:
    """``entity, ts, change, silent_s``: ``down`` at ``gap_s`` after a row that no row follows for
    longer than that, ``up`` at the next row.  The last row of a client counts as followed by none
    if its time to be down is before ``until`` (None: such clients are not told).

    Gaps come from the previous row in sliced order, and the last row from an aggregate: no client
    is in one task.
    """
    times = samples.select(entity, "ts").distinct()
    gaps = prev_row(times, [entity], "ts", [], split_s=split_s)
    silent = (epoch_us("ts") - epoch_us("prev_ts")) / F.lit(1_000_000.0)
    late = gaps.withColumn("silent_s", silent).where(F.col("silent_s") > gap_s)
    events = F.array(F.struct(add_seconds("prev_ts", gap_s).alias("ts"), F.lit("down").alias("change"), F.lit(float(gap_s)).alias("silent_s")),
                     F.struct(F.col("ts"), F.lit("up").alias("change"), F.col("silent_s")))
    told = late.select(F.col(entity).alias("entity"), F.inline(events))
    if until is None:
        return told
    last = samples.groupBy(F.col(entity).alias("entity")).agg(F.max("ts").alias("last")).withColumn("ts", add_seconds("last", gap_s)) \
        .where(F.col("ts") < to_ntz_literal(until))
    return told.unionByName(last.select("entity", "ts", F.lit("down").alias("change"), F.lit(float(gap_s)).alias("silent_s")))
