"""Queries: combinators (serial, merge, snapshot differences)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import combine as C
from ..operators import select as S
from ..sources import testdata as T
from .registry import query
from .sqlviews import with_views as V

_L2 = [["cmd_get", "get_hits"]]
_L2_SQL = """(VALUES (0, 'cmd_get, get_hits', 0, 'cmd_get', 'cmd_get'),
                     (0, 'cmd_get, get_hits', 1, 'get_hits', 'get_hits'))
        AS l(chart_ord, chart_title, item_ord, item_title, metric)"""


def _loader(spark, d, tbl):
    lay = S.layout_frame(spark, _L2)
    return S.apply_layout(T.net_long(spark, d).where(F.col("tbl") == tbl), lay).select(*S.SERIES_COLS)


# ---------------------------------------------------------------- U1 ------
@query("concat_charts", V("net_long", body=f"""
SELECT CASE n.tbl WHEN 'net_A' THEN 0 WHEN 'net_N' THEN 1 ELSE 2 END AS section_ord, l.chart_ord, l.chart_title, l.item_ord,
       l.item_title, n.entity, n.tbl, n.ts, n.value
FROM net_long n JOIN {_L2_SQL} ON n.metric = l.metric"""), "U1 P7")
def concat_charts(spark, d):
    return C.concat_charts([_loader(spark, d, t) for t in ("net_A", "net_N", "net_R")])


# ---------------------------------------------------------------- U2 ------
@query("merge_charts", V("net_long", body=f"""
SELECT l.chart_ord, l.chart_title, l.item_ord, l.item_title, n.entity, n.tbl, n.ts, n.value,
       CASE n.tbl WHEN 'net_A' THEN 0 WHEN 'net_N' THEN 1 ELSE 2 END AS input_ord
FROM net_long n JOIN {_L2_SQL} ON n.metric = l.metric
WHERE n.tbl IN ('net_A', 'net_N', 'net_R')"""), "U2 V4 V5")
def merge_charts(spark, d):
    ins = [_loader(spark, d, t) for t in ("net_A", "net_N", "net_R")]
    return C.merge_charts(ins, chart_counts=[len(_L2)] * 3)


# ------------------------------------------------------------ U5, T9 ------
@query("membership_changes", """
WITH s AS (SELECT DISTINCT CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS snap,
                  'cust-' || CAST(o_custkey AS VARCHAR) AS member FROM orders),
sn AS (SELECT DISTINCT snap FROM s),
hp AS (SELECT snap, snap - 1 AS prev_snap FROM sn WHERE snap - 1 IN (SELECT snap FROM sn))
SELECT s.snap, s.member, 'up' AS change FROM s JOIN hp USING (snap)
WHERE NOT EXISTS (SELECT 1 FROM s p WHERE p.snap = hp.prev_snap AND p.member = s.member)
UNION ALL
SELECT hp.snap, p.member, 'down' AS change FROM s p JOIN hp ON p.snap = hp.prev_snap
WHERE NOT EXISTS (SELECT 1 FROM s c WHERE c.snap = hp.snap AND c.member = p.member)""", "U5 T9")
def membership_changes(spark, d):
    o = T.table(spark, d, "orders")
    snaps = o.select((F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("int").alias("snap"),
                     F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("member")).distinct()
    return C.snapshot_changes(snaps, prev_snap_col=lambda s: s - 1)


# ---------------------------------------------------------------- O1 ------
@query("sort_charts", V("net_long", body=f"""
SELECT l.chart_ord, l.chart_title, l.item_ord, l.item_title, n.entity, n.tbl, n.ts, n.value,
       CASE n.tbl WHEN 'net_A' THEN 0 WHEN 'net_N' THEN 1 ELSE 2 END AS input_ord
FROM net_long n JOIN {_L2_SQL} ON n.metric = l.metric
WHERE n.tbl IN ('net_A', 'net_N', 'net_R')
ORDER BY l.chart_title, input_ord, l.item_ord, n.entity, n.ts"""), "O1 U2")
def sort_charts(spark, d):
    ins = [_loader(spark, d, t) for t in ("net_A", "net_N", "net_R")]
    return C.merge_charts(ins, chart_counts=[len(_L2)] * 3).orderBy("chart_title", "input_ord", "item_ord",
                                                                     "entity", "ts")
