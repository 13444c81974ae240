"""Combinators over chart sets: serial concat, merge ([EACH]), sum ([SUM]),
snapshot differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregate import sum_instances


def concat_charts(inputs: Sequence[DataFrame]) -> DataFrame:
    """Serial: chart lists one after another, in argument order."""
    out = None
    for i, df in enumerate(inputs):
        d = df.withColumn("section_ord", F.lit(i))
        out = d if out is None else out.unionByName(d)
    return out


def merge_charts(inputs: Sequence[DataFrame], chart_counts: Sequence[int] | None = None) -> DataFrame:
    """Merge: chart i of every input becomes one chart holding all their items
    (items keep ``input_ord``).  Chart counts are known from the layouts at
    plan time; when they differ the merge is refused."""
    if chart_counts is not None and len(set(chart_counts)) > 1:
        raise ValueError(f"merge needs equal chart counts, got {list(chart_counts)}")
    out = None
    for i, df in enumerate(inputs):
        d = df.withColumn("input_ord", F.lit(i))
        out = d if out is None else out.unionByName(d)
    return out


def snapshot_changes(snapshots: DataFrame, snap: str = "snap", member: str = "member",
                     prev_snap_col=None) -> DataFrame:
    """Up / down events between consecutive snapshots.

    ``snapshots`` has one row per (snap, member).  ``prev_snap_col`` maps a
    snapshot id to the id of the snapshot before it (a Column expression on
    ``snap``).  A member in snapshot s but not in its predecessor is ``up``;
    one in the predecessor but not in s is ``down``.  Two anti joins over
    (member, snap): no pairs, no group is collected.
    """
    cur = snapshots.select(F.col(snap).alias("snap"), F.col(member).alias("member"))
    snaps = cur.select("snap").distinct()
    with_prev = snaps.withColumn("prev_snap", prev_snap_col(F.col("snap")))
    has_prev = with_prev.join(snaps.select(F.col("snap").alias("prev_snap")), "prev_snap", "left_semi")
    prev_members = cur.select(F.col("snap").alias("prev_snap"), "member")
    # up: in s, not in prev(s)
    up = (cur.join(has_prev, "snap")
          .join(prev_members, ["prev_snap", "member"], "left_anti")
          .select("snap", "member", F.lit("up").alias("change")))
    # down: in prev(s), not in s
    down = (prev_members.join(has_prev, "prev_snap")
            .join(cur, ["snap", "member"], "left_anti")
            .select("snap", "member", F.lit("down").alias("change")))
    return up.unionByName(down)
