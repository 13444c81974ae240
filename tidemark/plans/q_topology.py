"""Queries: topology lookups and reports, key placement, shard ids and
multi-key range fetches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import placement as PL
from ..operators import topology as TP
from ..operators.select import drill_down
from ..sources import testdata as T
from .q_normalize import parse_prefix as _parse_prefix
from .registry import query
from .sqlviews import register
from .sqlviews import with_views as V

LIVE_SINCE = "2001-01-01 00:00:00"
REMAP_BELOW_NATION = 5

register("topo", """
SELECT lower(replace(r_name, ' ', '-')) AS cluster, 'server-' || CAST(s_suppkey AS VARCHAR) AS node,
       '10.' || CAST(r_regionkey AS VARCHAR) || '.' || CAST(n_nationkey AS VARCHAR) || '.1' AS ip,
       CAST(s_suppkey AS VARCHAR) AS port, s_acctbal, s_suppkey, r_regionkey, n_nationkey
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
register("declared", """
SELECT cluster, node, ip, port, ip || ':' || port AS addr, s_acctbal, s_suppkey FROM topo WHERE s_acctbal >= 0""",
         ("topo",))
register("live", f"""
SELECT node, ip, port, ip || ':' || port AS addr FROM topo
WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '{LIVE_SINCE}')""", ("topo",))
register("node_map", """
SELECT DISTINCT CASE WHEN s_acctbal > 5000 THEN ip || ':' || port ELSE ip || ':0' END AS addr, cluster
FROM topo WHERE s_acctbal >= 0""", ("topo",))


def _topo(spark, d):
    s, n, r = (T.table(spark, d, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select(F.lower(F.regexp_replace("r_name", " ", "-")).alias("cluster"),
                    F.concat(F.lit("server-"), F.col("s_suppkey").cast("string")).alias("node"),
                    F.concat(F.lit("10."), F.col("r_regionkey").cast("string"), F.lit("."),
                             F.col("n_nationkey").cast("string"), F.lit(".1")).alias("ip"),
                    F.col("s_suppkey").cast("string").alias("port"), "s_acctbal", "s_suppkey",
                    "r_regionkey", "n_nationkey")


def _declared(spark, d):
    t = _topo(spark, d).where(F.col("s_acctbal") >= 0)
    return t.withColumn("addr", F.concat_ws(":", "ip", "port"))


def _live(spark, d):
    li = T.table(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit(LIVE_SINCE).cast("timestamp_ntz"))
    t = _topo(spark, d).join(li.select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_semi")
    return t.select("node", "ip", "port", F.concat_ws(":", "ip", "port").alias("addr"))


def _node_map(spark, d):
    t = _topo(spark, d).where(F.col("s_acctbal") >= 0)
    addr = F.when(F.col("s_acctbal") > 5000, F.concat_ws(":", "ip", "port")).otherwise(F.concat(F.col("ip"), F.lit(":0")))
    return t.select(addr.alias("addr"), "cluster").distinct()


# ---------------------------------------------------------------- J4 ------
@query("cluster_lookup", V("live", "node_map", body="""
SELECT l.node, l.ip, l.port, COALESCE(m1.cluster, m0.cluster) AS cluster
FROM live l LEFT JOIN node_map m1 ON m1.addr = l.ip || ':' || l.port
LEFT JOIN node_map m0 ON m0.addr = l.ip || ':0'"""), "J4")
def cluster_lookup(spark, d):
    return TP.cluster_lookup(_live(spark, d).select("node", "ip", "port"), _node_map(spark, d))


# ---------------------------------------------------------------- J5 ------
@query("reconcile_nodes", V("declared", "live", body="""
SELECT COALESCE(d.addr, l.addr) AS addr, d.cluster,
       CASE WHEN d.addr IS NOT NULL AND l.addr IS NOT NULL THEN 'active'
            WHEN l.addr IS NOT NULL THEN 'noport' ELSE 'dead' END AS state
FROM declared d FULL OUTER JOIN live l ON d.addr = l.addr"""), "J5")
def reconcile_nodes(spark, d):
    return TP.reconcile(_declared(spark, d), _live(spark, d))


# ---------------------------------------------------------------- J8 ------
@query("ip_remap", V("declared", "topo", body=f"""
WITH r AS (SELECT DISTINCT ip AS from_ip, '192.168.' || CAST(n_nationkey AS VARCHAR) || '.1' AS to_ip
           FROM topo WHERE n_nationkey < {REMAP_BELOW_NATION})
SELECT d.node, COALESCE(r.to_ip, d.ip) AS ip, d.port FROM declared d LEFT JOIN r ON d.ip = r.from_ip"""), "J8")
def ip_remap(spark, d):
    t = _topo(spark, d).where(F.col("n_nationkey") < REMAP_BELOW_NATION)
    remap = t.select(F.col("ip").alias("from_ip"),
                     F.concat(F.lit("192.168."), F.col("n_nationkey").cast("string"), F.lit(".1")).alias("to_ip")).distinct()
    return TP.remap_ip(_declared(spark, d).select("node", "ip", "port"), remap)


# ------------------------------------------------------------ S14b --------
CATALOG_CLUSTERS = ("asia", "europe")


@query("cluster_catalog", V("declared", body="""
SELECT cluster, addr FROM declared WHERE cluster IN ('asia', 'europe')"""), "S14b")
def cluster_catalog(spark, d):
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in CATALOG_CLUSTERS])).alias("cluster"))
    return _declared(spark, d).join(F.broadcast(wanted), "cluster", "left_semi").select("cluster", "addr")


# ---------------------------------------------------------------- S15 -----
@query("catalog_drill", V("declared", body="""
SELECT DISTINCT ip AS choice FROM declared WHERE cluster = 'asia'"""), "S15 O2")
def catalog_drill(spark, d):
    return drill_down(_declared(spark, d), ["cluster", "ip", "port"], ["asia"])


def _mem_nodes(spark, d):
    li = T.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").cast("bigint").alias("used_mb"))
    dec = _declared(spark, d)
    j = dec.join(li, dec.s_suppkey == li.l_suppkey)
    return j.select("cluster", "ip", "node", "used_mb",
                    (F.floor("s_acctbal") + 1000).cast("bigint").alias("limit_mb"))


register("mem_nodes", """
SELECT d.cluster, d.ip, d.node, CAST(SUM(l.l_quantity) AS BIGINT) AS used_mb,
       CAST(floor(d.s_acctbal) + 1000 AS BIGINT) AS limit_mb
FROM declared d JOIN lineitem l ON d.s_suppkey = l.l_suppkey
GROUP BY d.cluster, d.ip, d.node, d.s_acctbal""", ("declared",))


# ---------------------------------------------------------------- A11 -----
@query("memory_report", V("mem_nodes", body="""
SELECT ip, node, CAST(SUM(used_mb) AS BIGINT) AS used_mb, CAST(SUM(limit_mb) AS BIGINT) AS limit_mb,
       CAST(GROUPING(ip, node) AS INTEGER) AS level,
       floor(SUM(used_mb) * 100.0 / SUM(limit_mb) * 100 + 0.5) / 100 AS pct
FROM mem_nodes GROUP BY ROLLUP (ip, node)"""), "A11")
def memory_report(spark, d):
    return TP.memory_report(_mem_nodes(spark, d))


# ------------------------------------------------------------ A12, A14 ----
@query("cluster_brief", V("mem_nodes", body="""
SELECT cluster, CAST(COUNT(*) AS BIGINT) AS instances, CAST(SUM(used_mb) AS BIGINT) AS used_mb,
       CAST(GROUPING(cluster) AS INTEGER) AS level
FROM mem_nodes GROUP BY ROLLUP (cluster)"""), "A12 A14")
def cluster_brief(spark, d):
    return TP.cluster_brief(_mem_nodes(spark, d))


# ---------------------------------------------------------------- A13 -----
@query("prefix_merge", V("prefix_dumps", body=r"""
WITH dd AS (SELECT entity, tbl, ts, string_split_regex(text, '\r?\n') AS l FROM prefix_dumps),
e AS (SELECT entity, tbl, ts, string_split_regex(line, '\s+') AS a
      FROM (SELECT entity, tbl, ts, unnest(l) AS line FROM dd WHERE len(l) <= 32) x WHERE line <> 'END'),
b AS (SELECT a[2] AS prefix, a[3:] AS body FROM e WHERE len(a) >= 2),
kv AS (SELECT prefix, unnest(list_filter(body, lambda x, i: i % 2 = 1)) AS key,
              unnest(list_filter(body, lambda x, i: i % 2 = 0)) AS raw FROM b)
SELECT prefix, key, CAST(SUM(CAST(raw AS BIGINT)) AS BIGINT) AS total FROM kv
WHERE starts_with(prefix, 'S') AND key <> 'time'
GROUP BY prefix, key"""), "A13")
def prefix_merge(spark, d):
    stats = _parse_prefix(spark, d).withColumn("value", F.col("raw").cast("bigint"))
    return TP.merge_prefix_stats(stats, prefix_filter="S")


# ---------------------------------------------------------------- A17 -----
@query("process_rollup", """
SELECT 'server-' || CAST(l_suppkey AS VARCHAR) AS entity, l_shipdate AS ts, CAST(COUNT(*) AS BIGINT) AS n,
       CAST(SUM(l_quantity) AS DOUBLE) AS sum_threads, CAST(SUM(l_linenumber) AS BIGINT) AS sum_fds
FROM lineitem GROUP BY l_suppkey, l_shipdate""", "A17")
def process_rollup(spark, d):
    from ..operators.aggregate import per_sample_rollup
    li = T.table(spark, d, "lineitem").select(
        F.concat(F.lit("server-"), F.col("l_suppkey").cast("string")).alias("entity"), F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("threads"), F.col("l_linenumber").cast("bigint").alias("fds"))
    r = per_sample_rollup(li, ["entity", "ts"], ["threads", "fds"])
    return r.select("entity", "ts", "n", "sum_threads", "sum_fds")


# ------------------------------------------------------------ J9, A16 -----
register("ring", """
SELECT node, CAST(('0x' || substr(h, 8 * w + 7, 2) || substr(h, 8 * w + 5, 2) || substr(h, 8 * w + 3, 2)
                   || substr(h, 8 * w + 1, 2)) AS BIGINT) AS point
FROM (SELECT addr AS node, md5(addr || '-' || CAST(i AS VARCHAR)) AS h FROM declared, range(0, 40) t(i)) p,
     range(0, 4) u(w)""", ("declared",))
register("ring_keys", """
SELECT key, CAST(('0x' || substr(md5(key), 7, 2) || substr(md5(key), 5, 2) || substr(md5(key), 3, 2)
                  || substr(md5(key), 1, 2)) AS BIGINT) AS hash
FROM (SELECT 'part:' || CAST(p_partkey AS VARCHAR) AS key FROM part
      UNION SELECT 'order:' || CAST(o_orderkey AS VARCHAR) FROM orders) k""")
register("placed", """
SELECT k.key, k.hash, COALESCE(r.node, (SELECT arg_min(node, point) FROM ring)) AS node
FROM ring_keys k ASOF LEFT JOIN ring r ON k.hash < r.point""", ("ring", "ring_keys"))


def _keys(spark, d):
    p = T.table(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("key"))
    o = T.table(spark, d, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("key"))
    return p.unionByName(o)


def _placed(spark, d):
    return PL.place_keys(_keys(spark, d), PL.ring_points(_declared(spark, d)))


@query("ring_placement", V("placed", body="SELECT key, hash, node FROM placed"), "J9")
def ring_placement(spark, d):
    return _placed(spark, d)


@query("keys_per_node", V("placed", body="""
SELECT node, CAST(COUNT(*) AS BIGINT) AS n_keys, min(key) AS min_key, max(key) AS max_key
FROM placed GROUP BY node"""), "A16")
def keys_per_node(spark, d):
    return _placed(spark, d).groupBy("node").agg(F.count(F.lit(1)).alias("n_keys"), F.min("key").alias("min_key"),
                                                  F.max("key").alias("max_key"))


# ---------------------------------------------------------------- 2.8 -----
SHARDS = 4


def _crc_values(n: int) -> str:
    """(entity, crc32) of the first n entities, computed apart from Spark."""
    import zlib
    return "(VALUES " + ", ".join(f"('host-{i}', {zlib.crc32(f'host-{i}'.encode())})" for i in range(n)) + ") AS v(entity, crc)"


@query("shard_hash", V("gauge_long", body=f"""
SELECT entity, CAST(crc % {SHARDS} AS INTEGER) AS shard
FROM (SELECT DISTINCT entity FROM gauge_long) e LEFT JOIN {_crc_values(20_000)} USING (entity)"""), "hash crc32")
def shard_hash(spark, d):
    ents = T.gauge_long(spark, d).select("entity").distinct()
    return ents.select("entity", PL.shard_id(F.col("entity"), SHARDS).alias("shard"))


# ------------------------------------------------------------ J10, O4 -----
FETCH = dict(lo=1000, hi=9000, offset=10, count=100)
register("bop_items", """
SELECT 'cust-' || CAST(o_custkey AS VARCHAR) AS key, o_orderkey AS bkey, o_totalprice AS value FROM orders""")
register("bop_keys", """
SELECT DISTINCT 'cust-' || CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_mktsegment = 'BUILDING'
UNION SELECT DISTINCT 'cust-' || CAST(c_custkey * 7 AS VARCHAR) AS key FROM customer""")


def _bop(spark, d):
    o = T.table(spark, d, "orders")
    items = o.select(F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("key"),
                     F.col("o_orderkey").alias("bkey"), F.col("o_totalprice").alias("value"))
    c = T.table(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING")
    more = T.table(spark, d, "customer").select(F.concat(F.lit("cust-"), (F.col("c_custkey") * 7).cast("string")).alias("key"))
    keys = c.select(F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")).alias("key")).unionByName(more).distinct()
    return PL.multi_range_fetch(items, keys, FETCH["lo"], FETCH["hi"], offset=FETCH["offset"], count=FETCH["count"])


@query("multi_range_fetch", V("bop_items", "bop_keys", body=f"""
SELECT key, bkey, value FROM bop_items SEMI JOIN bop_keys USING (key)
WHERE bkey BETWEEN {FETCH['lo']} AND {FETCH['hi']}
ORDER BY bkey, key LIMIT {FETCH['count']} OFFSET {FETCH['offset']}"""), "J10 O4")
def multi_range_fetch(spark, d):
    return _bop(spark, d)[0]


@query("missing_keys", V("bop_items", "bop_keys", body="""
SELECT key FROM bop_keys ANTI JOIN (SELECT DISTINCT key FROM bop_items) i USING (key)"""), "J10")
def missing_keys(spark, d):
    return _bop(spark, d)[1]


# ------------------------------------------------------------ V4, V5 ------
_SUM_LAYOUT = [["cmd_get", "get_hits"], "bytes_sent"]
_SUM_LAYOUT_SQL = """(VALUES (0, 'cmd_get, get_hits', 0, 'cmd_get', 'cmd_get'),
                             (0, 'cmd_get, get_hits', 1, 'get_hits', 'get_hits'),
                             (1, 'bytes_sent', 0, 'bytes_sent', 'bytes_sent'))
        AS l(chart_ord, chart_title, item_ord, item_title, metric)"""


@query("cluster_sum", V("declared", "net_long", body=f"""
SELECT d.cluster, l.chart_ord, l.item_ord, min(l.chart_title) AS chart_title, min(l.item_title) AS item_title, n.ts,
       floor(CAST(SUM(CAST(n.value AS DECIMAL(18,2))) AS DOUBLE) * 10000 + 0.5) / 10000 AS value,
       CAST(COUNT(n.value) AS BIGINT) AS n_instances
FROM net_long n JOIN declared d ON n.entity = d.node JOIN {_SUM_LAYOUT_SQL} ON n.metric = l.metric
GROUP BY d.cluster, l.chart_ord, l.item_ord, n.ts"""), "V4 V5 A5 J4")
def cluster_sum(spark, d):
    from ..operators.aggregate import sum_instances
    from ..operators.select import apply_layout, layout_frame
    from .common import rnd
    nodes = _declared(spark, d).select(F.col("node").alias("entity"), "cluster")
    ser = apply_layout(T.net_long(spark, d), layout_frame(spark, _SUM_LAYOUT))
    ser = ser.join(nodes, "entity").withColumn("value", F.col("value").cast("decimal(18,2)"))
    out = sum_instances(ser, by=("cluster", "chart_ord", "item_ord"))
    return out.withColumn("value", rnd(F.col("value")))


DASHBOARD_CLUSTERS = ("asia", "europe", "atlantis")


@query("cluster_dashboard", V("declared", body="""
SELECT r.cluster, CASE WHEN c.n IS NULL THEN r.cluster || ' not found' ELSE r.cluster END AS title,
       COALESCE(c.n, 0) AS instances
FROM (VALUES ('asia'), ('europe'), ('atlantis')) AS r(cluster)
LEFT JOIN (SELECT cluster, CAST(COUNT(*) AS BIGINT) AS n FROM declared GROUP BY cluster) c USING (cluster)"""),
       "V5 A14 S14b")
def cluster_dashboard(spark, d):
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in DASHBOARD_CLUSTERS])).alias("cluster"))
    counts = _declared(spark, d).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    j = wanted.join(counts, "cluster", "left")
    title = F.when(F.col("n").isNull(), F.concat(F.col("cluster"), F.lit(" not found"))).otherwise(F.col("cluster"))
    return j.select("cluster", title.alias("title"), F.coalesce("n", F.lit(0)).cast("bigint").alias("instances"))


# ---------------------------------------------------------------- 2.8 -----
@query("name_rules", V("topo", body="""
WITH h AS (SELECT node, ip, port,
                  'cache' || CAST(s_suppkey AS VARCHAR) || '.' || lower(replace(cluster, '-', '')) || '.dc'
                    || CAST(r_regionkey AS VARCHAR) || '.corp' AS host,
                  CASE WHEN s_acctbal >= 0 THEN 'g' || CAST(n_nationkey AS VARCHAR) || '^M^' || ip || ':' || port
                       ELSE ip || ':' || port END AS znode,
                  'cachepool_' || port || CASE WHEN s_acctbal > 5000 THEN '-prefix' ELSE '' END AS tbl
           FROM topo)
SELECT node,
       CASE WHEN len(string_split(host, '.')) > 2
            THEN array_to_string(string_split(host, '.')[1:len(string_split(host, '.')) - 2], '.') ELSE host END
         AS short_host,
       CASE WHEN len(string_split(znode, '^')) = 3 THEN string_split(znode, '^')[3] ELSE znode END AS addr,
       split_part(substr(tbl, strpos(tbl, '_') + 1), '-', 1) AS instance,
       CASE WHEN strpos(substr(tbl, strpos(tbl, '_') + 1), '-') > 0
            THEN substr(substr(tbl, strpos(tbl, '_') + 1), strpos(substr(tbl, strpos(tbl, '_') + 1), '-') + 1)
            ELSE '' END AS prefix
FROM h"""), "2.8 string rules")
def name_rules(spark, d):
    from ..functions.patterns import instance_of, short_host, split_first, strip_replica
    t = _topo(spark, d)
    host = F.concat(F.lit("cache"), F.col("s_suppkey").cast("string"), F.lit("."),
                    F.lower(F.regexp_replace("cluster", "-", "")), F.lit(".dc"), F.col("r_regionkey").cast("string"),
                    F.lit(".corp"))
    znode = F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("g"), F.col("n_nationkey").cast("string"), F.lit("^M^"),
                                                     F.col("ip"), F.lit(":"), F.col("port"))) \
        .otherwise(F.concat_ws(":", "ip", "port"))
    tbl = F.concat(F.lit("cachepool_"), F.col("port"), F.when(F.col("s_acctbal") > 5000, F.lit("-prefix")).otherwise(F.lit("")))
    h = t.select("node", host.alias("host"), znode.alias("znode"), tbl.alias("tbl"))
    inst, prefix = split_first(instance_of("tbl"), "-")
    return h.select("node", short_host("host").alias("short_host"), strip_replica("znode").alias("addr"),
                    inst.alias("instance"), prefix.alias("prefix"))
