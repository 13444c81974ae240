"""Cluster topology: node lookups, declared-vs-live reconciliation, IP
remaps, catalogs and memory / instance reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cluster_lookup(nodes: DataFrame, node_map: DataFrame) -> DataFrame:
    """Node -> cluster via ``ip:port``, else ``ip:0`` (a whole host), else
    unknown (null: no rules apply).  ``node_map``: ``(addr, cluster)``.
    Two equi left joins on the map; no theta join."""
    m = node_map.select("addr", "cluster").distinct()
    exact = m.select(F.col("addr").alias("__a1"), F.col("cluster").alias("__c1"))
    host = m.select(F.col("addr").alias("__a0"), F.col("cluster").alias("__c0"))
    d = nodes.withColumn("__a0k", F.concat(F.col("ip"), F.lit(":0"))) \
             .withColumn("__a1k", F.concat(F.col("ip"), F.lit(":"), F.col("port")))
    j = d.join(exact, d["__a1k"] == exact["__a1"], "left").join(host, d["__a0k"] == host["__a0"], "left")
    return j.select(*nodes.columns, F.coalesce("__c1", "__c0").alias("cluster"))


def reconcile(declared: DataFrame, live: DataFrame, addr: str = "addr") -> DataFrame:
    """declared + live -> active; live only -> active flagged ``noport``;
    declared only -> dead.  One full outer join on the address."""
    d = declared.select(F.col(addr).alias("__d"), "cluster")
    lv = live.select(F.col(addr).alias("__l"))
    j = d.join(lv, d["__d"] == lv["__l"], "full_outer")
    state = (F.when(F.col("__d").isNotNull() & F.col("__l").isNotNull(), "active")
             .when(F.col("__l").isNotNull(), "noport").otherwise("dead"))
    return j.select(F.coalesce("__d", "__l").alias(addr), "cluster", state.alias("state"))


def remap_ip(df: DataFrame, remap: DataFrame, ip: str = "ip") -> DataFrame:
    """Replace ``ip`` by its mapped address when the lookup has one."""
    r = remap.select(F.col("from_ip").alias("__f"), F.col("to_ip").alias("__t"))
    j = df.join(r, df[ip] == r["__f"], "left")
    return j.select(*[F.coalesce("__t", ip).alias(ip) if c == ip else F.col(c) for c in df.columns])


def memory_report(nodes: DataFrame) -> DataFrame:
    """Per node used / limit MB and %, subtotal per server, grand total
    (``rollup(ip, node)`` + ``grouping_id``)."""
    g = nodes.rollup("ip", "node").agg(F.sum("used_mb").alias("used_mb"), F.sum("limit_mb").alias("limit_mb"),
                                       F.grouping_id().cast("int").alias("level"))
    pct = F.floor(F.try_divide(F.col("used_mb") * 100.0, F.col("limit_mb")) * 100 + 0.5) / 100
    return g.withColumn("pct", pct)


def cluster_brief(nodes: DataFrame) -> DataFrame:
    """Instances and memory per cluster plus an overall total row."""
    return nodes.rollup("cluster").agg(F.count(F.lit(1)).alias("instances"), F.sum("used_mb").alias("used_mb"),
                                       F.grouping_id().cast("int").alias("level"))


def merge_prefix_stats(stats: DataFrame, prefix_filter: str | None = None,
                       hide_in_totals: Sequence[str] = ("time",)) -> DataFrame:
    """Sum prefix statistics over nodes by (prefix, key).  ``prefix_filter``:
    ``'all'`` / None = every prefix, ``'null'`` or ``'<null>'`` = the null
    prefix, else a startsWith prefix.  Keys in ``hide_in_totals`` are not summed."""
    d = stats.where(~F.col("key").isin(list(hide_in_totals)))
    if prefix_filter in ("null", "<null>"):
        d = d.where(F.col("prefix") == "<null>")
    elif prefix_filter not in (None, "all"):
        d = d.where(F.col("prefix").startswith(prefix_filter))
    return d.groupBy("prefix", "key").agg(F.sum("value").alias("total"))
