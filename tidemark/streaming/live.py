"""Live views and continuous query cursors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.timecols import from_instant, to_instant

LIVE_DIFF_MIN = 5        # live view spans the last 5 minutes
LIVE_REFRESH_S = 5       # re-evaluated every 5 seconds
LIVE_END_AHEAD_S = 60    # end of the live range = now + 60 s


def live_window(stream: DataFrame, width: str = f"{LIVE_DIFF_MIN} minutes", slide: str | None = None,
                delay: str = "60 seconds", keys=("entity", "tbl", "metric")) -> DataFrame:
    """Latest values per series over recent windows (for dashboards)."""
    et = "__event_time"
    w = F.window(et, width, slide) if slide else F.window(et, width)
    d = stream.withColumn(et, to_instant("ts")).withWatermark(et, delay)
    return (d.groupBy(*keys, w.alias("w"))
            .agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))
            .withColumn("window_start", from_instant("w.start")).drop("w"))


def cursor(stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str,
           available_now: bool = False) -> StreamingQuery:
    """Continuous query cursor: every new micro-batch of results is pushed to
    ``callback`` (``foreachBatch``)."""
    w = stream.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{LIVE_REFRESH_S} seconds")
    return w.start()
