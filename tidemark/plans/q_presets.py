"""Queries: chart presets of hosts, databases and cache clusters, and the rule sets' ratios.

Samples of a service are derived from lineitem: a supplier is a server, the
return flag an instance, the ship day the time, and a line's quantity counts
for one of the service's metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alarms as AL
from ..operators import rules as RU
from ..operators import select as S
from ..operators import windows as Wn
from ..operators.search import derive
from ..sources import testdata as T
from .presets_data import CACHE, CUBRID, HEARTBEAT_S, HOST_TABLES, KINDS, MYSQL, items_of, metrics_of
from .registry import query


def service_samples(spark: SparkSession, d: str, plugins: dict[str, list[str]]) -> DataFrame:
    """Samples of services that have these metrics, in one scan."""
    li = T.table(spark, d, "lineitem")
    nth = F.col("l_orderkey") * 5 + F.col("l_partkey") + F.col("l_linenumber")
    one = [F.struct(T.named(f"{plugin}_", "l_returnflag").alias("tbl"),
                    F.element_at(F.array(*[F.lit(m) for m in metrics]), (F.pmod("nth", F.lit(len(metrics))) + 1).cast("int")).alias("metric"))
           for plugin, metrics in plugins.items()]
    lines = T.keyed(li, "l_suppkey", "l_returnflag").select(T.named("server-", "l_suppkey").alias("entity"), "l_returnflag", nth.alias("nth"),
                                                            F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("value"))
    return T.by_entity(lines, li).select("entity", F.inline(F.array(*one)), "ts", "value") \
        .groupBy("entity", "tbl", "ts", "metric").agg(F.sum("value").alias("value"))


def _samples_sql(plugin: str, metrics: list[str]) -> str:
    names = "[" + ", ".join(f"'{m}'" for m in metrics) + "]"
    return f"""(SELECT 'server-' || l_suppkey AS entity, '{plugin}_' || l_returnflag AS tbl, l_shipdate AS ts,
       {names}[CAST((l_orderkey * 5 + l_partkey + l_linenumber) % {len(metrics)} AS INTEGER) + 1] AS metric, SUM(l_quantity) AS value
FROM lineitem GROUP BY ALL)"""


def preset_charts(spark: SparkSession, samples: DataFrame, preset: list) -> DataFrame:
    """Series of every chart: plain items by one join with the layout, ratio items by one pass over the metrics they use."""
    plain = [(c, t, n, i, i, False) for c, t, n, i in items_of(preset) if isinstance(i, str)]
    layout = spark.createDataFrame(plain, "chart_ord int, chart_title string, item_ord int, item_title string, metric string, stack boolean")
    out = S.apply_layout(samples, layout).select(*S.SERIES_COLS)
    for c, t, n, item in items_of(preset):
        if not isinstance(item, str):
            ratio = derive(samples, item[0], item[1]).where(F.col("value").isNotNull())
            out = out.unionByName(ratio.select(F.lit(c).alias("chart_ord"), F.lit(t).alias("chart_title"), F.lit(n).alias("item_ord"),
                                               "item_title", "entity", "tbl", "ts", "value"))
    return out


def _charts_sql(plugin: str, preset: list, ratios: dict[str, str] | None = None) -> str:
    metrics = metrics_of(preset)
    plain = ", ".join(f"({c}, '{t}', {n}, '{i}')" for c, t, n, i in items_of(preset) if isinstance(i, str))
    parts = [f"""SELECT l.chart_ord, l.chart_title, l.item_ord, l.metric AS item_title, s.entity, s.tbl, s.ts, s.value
FROM s JOIN (VALUES {plain}) AS l(chart_ord, chart_title, item_ord, metric) USING (metric)"""]
    for c, t, n, item in items_of(preset):
        if not isinstance(item, str):
            parts.append(f"SELECT {c}, '{t}', {n}, '{item[0]}', entity, tbl, ts, v FROM (SELECT entity, tbl, ts, {ratios[item[0]]} AS v "
                         f"FROM w) x WHERE v IS NOT NULL")
    wide = ", ".join(f"max(CASE WHEN metric = '{m}' THEN value END) AS \"{m}\"" for m in metrics)
    return (f"WITH s AS {_samples_sql(plugin, metrics)}, w AS (SELECT entity, tbl, ts, {wide} FROM s GROUP BY entity, tbl, ts) "
            + " UNION ALL ".join(parts))


CACHE_RATIOS = {
    "hit_ratio": "get_hits / nullif(cmd_get, 0) * 100",
    "bop_hit_ratio": "(bop_get_ehits + bop_get_nhits) / nullif(cmd_bop_get, 0) * 100",
    "bop_elem_hit_ratio": "bop_get_ehits / nullif(bop_get_ehits + bop_get_nhits, 0) * 100",
}


@query("mysql_preset", _charts_sql("mysql", MYSQL), "V6 P3")
def mysql_preset(spark, d):
    return preset_charts(spark, service_samples(spark, d, {"mysql": metrics_of(MYSQL)}), MYSQL)


@query("cubrid_preset", _charts_sql("cubrid", CUBRID), "V6 P3")
def cubrid_preset(spark, d):
    return preset_charts(spark, service_samples(spark, d, {"cubrid": metrics_of(CUBRID)}), CUBRID)


@query("cache_preset", _charts_sql("cache", CACHE, CACHE_RATIOS), "V4 F6 P5")
def cache_preset(spark, d):
    return preset_charts(spark, service_samples(spark, d, {"cache": metrics_of(CACHE)}), CACHE)


# ---------------------------------------------------------------- V1 ------
def _brief_sql() -> str:
    return " UNION ALL ".join(f"SELECT {n} AS section_ord, * FROM ({_charts_sql(t, p)}) x{n}" for n, (t, p) in enumerate(HOST_TABLES.items()))


@query("host_brief", _brief_sql(), "V1 U1 F6")
def host_brief(spark, d):
    """The brief view of every host: the charts of its six tables, one after the other."""
    from ..operators.combine import concat_charts
    return concat_charts([preset_charts(spark, service_samples(spark, d, {t: metrics_of(p)}), p) for t, p in HOST_TABLES.items()])


# ---------------------------------------------------------------- R2 ------
# Ratio limits of the rule sets (level 0, 1, 2).
RATIO_LIMITS = {"used": (0.95, None, None), "keyspace": (0.80, 0.60, None)}
_RATIO_METRICS = ["used", "total", "keyspace_hits", "keyspace_misses"]


def _used(m, limit):
    share = F.try_divide(m["used"], m["total"])
    return share > F.lit(limit), F.format_string("share in use %f is over %f", share, F.lit(limit))


def _keyspace(m, limit):
    share = F.try_divide(m["keyspace_hits"], m["keyspace_hits"] + m["keyspace_misses"])
    return share < F.lit(limit), F.format_string("share of key hits %f is under %f", share, F.lit(limit))


@query("ratio_rules", f"""
WITH s AS {_samples_sql('service', _RATIO_METRICS)},
w AS (SELECT entity || ':' || substr(tbl, strpos(tbl, '_') + 1) AS key, ts,
             {', '.join(f"max(CASE WHEN metric = '{m}' THEN value END) AS {m}" for m in _RATIO_METRICS)}
      FROM s GROUP BY entity, tbl, ts),
r AS (SELECT key, ts, used / nullif(total, 0) AS u, keyspace_hits / nullif(keyspace_hits + keyspace_misses, 0) AS k FROM w)
SELECT ts, key || '.used(0)' AS alarm_key, 0 AS level, key || ': ' || printf('share in use %f is over %f', u, 0.95) AS message
FROM r WHERE key GLOB '*:A' AND u > 0.95
UNION ALL
SELECT ts, key || '.keyspace(' || level || ')', level, key || ': ' || printf('share of key hits %f is under %f', k, lim)
FROM r JOIN (VALUES (0, 0.80), (1, 0.60)) AS l(level, lim) ON k < lim WHERE NOT key GLOB '*:A'""", "R2 T5 F4")
def ratio_rules(spark, d):
    s = service_samples(spark, d, {"service": _RATIO_METRICS})
    wide = s.groupBy("entity", "tbl", "ts").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in _RATIO_METRICS])
    return AL.predicate_alarms(spark, wide, [RU.LambdaRule("*:A", "used", _used, RATIO_LIMITS["used"]),
                                             RU.LambdaRule("*:*", "keyspace", _keyspace, RATIO_LIMITS["keyspace"])])


# ---------------------------------------------------------------- K1 ------
def _kind_rows() -> list[tuple[str, str, str]]:
    return [(plugin, metric, kind) for plugin, kinds in KINDS.items() for kind, metrics in kinds.items() for metric in metrics]


def _declared(plugin: str) -> list[str]:
    return [m for metrics in KINDS[plugin].values() for m in metrics]


@query("declared_kinds", f"""
WITH s AS ({' UNION ALL '.join(f'SELECT * FROM {_samples_sql(p, _declared(p))}' for p in KINDS)}),
c AS (SELECT * FROM (VALUES {', '.join(map(str, _kind_rows()))}) AS c(plugin, metric, kind))
SELECT entity, tbl, metric, kind, max(CASE WHEN kind = 'GAUGE' THEN value ELSE greatest(value - coalesce(prev, value), 0) END) AS most
FROM (SELECT s.*, c.kind, lag(value) OVER (PARTITION BY entity, tbl, s.metric ORDER BY ts) AS prev
      FROM s JOIN c ON c.plugin = split_part(s.tbl, '_', 1) AND c.metric = s.metric) x
GROUP BY entity, tbl, metric, kind""", "K1 W1")
def declared_kinds(spark, d):
    """The largest value of each gauge and the largest step of each counter, by the kinds that collectors declare."""
    samples = service_samples(spark, d, {plugin: _declared(plugin) for plugin in KINDS})
    catalog = spark.createDataFrame([(*r, HEARTBEAT_S, 0.0, None) for r in _kind_rows()],
                                    "plugin string, metric string, kind string, heartbeat_s int, min_v double, max_v double")
    steps = Wn.raw_delta(Wn.with_kind(samples, catalog).where(F.col("kind").isNotNull()), split_s=None)  # a sample a day at most
    return steps.groupBy("entity", "tbl", "metric", "kind").agg(
        F.max(F.when(F.col("kind") == "GAUGE", F.col("delta")).otherwise(F.greatest("delta", F.lit(0.0)))).alias("most"))
