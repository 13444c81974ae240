"""Metric views derived from the driver's parquet tables.

Every view is a lazy DataFrame over the parquet scans, so filters and
column pruning reach the files.  Canonical long form:
``entity, tbl, metric, ts, value`` (+ ``seq`` = arrival order where known).
In ``gauge_series``, ``counter_long`` and the ``net`` views, a row without a key
column (user, event type, supplier, return flag) is a sample of no series and is
left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators.seqwindow import running_sums

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Bytes of a stored table whose rows one task takes when they are dealt by entity.
DEALT_BYTES = 2 << 20
NET_METRICS = ("bytes_sent", "bytes_recv", "cmd_get", "get_hits")
COUNTER_WRAP = 50000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keyed(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that have all keys."""
    return df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))


def named(prefix: str, column: str) -> Column:
    """A name made of a key column, for Spark never null (the rows are :func:`keyed`)."""
    return F.concat(F.lit(prefix), F.coalesce(F.col(column).cast("string"), F.lit("")))


def by_entity(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """``rows`` of the ``stored`` table, dealt by ``entity``.  What is grouped or ordered by entity and more
    columns later needs no other shuffle, and the number of tasks grows with the table, not their size."""
    n = int(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // DEALT_BYTES
    return rows.repartition(n, "entity") if n > rows.sparkSession.sparkContext.defaultParallelism else rows.repartition("entity")


def gauge_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> one gauge series per (user, event type)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.concat(F.lit("host-"), ev.user_id.cast("string")).alias("entity"),
        F.concat(F.lit("app_"), ev.event_type).alias("tbl"),
        F.lit("value").alias("metric"),
        ev.ts, ev.value, ev.event_id.alias("seq"))


def gauge_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`gauge_long` of rows that belong to a series, for ordered operators."""
    ev = keyed(table(spark, sf_dir, "events"), "user_id", "event_type")
    return ev.select(named("host-", "user_id").alias("entity"), named("app_", "event_type").alias("tbl"), F.lit("value").alias("metric"),
                     "ts", "value", F.col("event_id").alias("seq"))


def counter_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> a monotone counter per user (``requests``) and a wrapping
    variant with resets (``requests_wrap``)."""
    ev = keyed(table(spark, sf_dir, "events"), "user_id").select(
        "user_id", "ts", "event_id", F.round(F.col("value") * 100).cast("bigint").alias("inc"))
    run = running_sums(ev, "user_id", "ts", {"total": F.col("inc")}, tiebreak="event_id")
    base = run.select(named("host-", "user_id").alias("entity"),
                      F.lit("app_counter").alias("tbl"), "ts", F.col("event_id").alias("seq"), "total")
    vals = F.array(
        F.struct(F.lit("requests").alias("metric"), F.col("total").cast("double").alias("value")),
        F.struct(F.lit("requests_wrap").alias("metric"),
                 F.pmod(F.col("total"), F.lit(COUNTER_WRAP)).cast("double").alias("value")))
    return (base.select("entity", "tbl", "ts", "seq", F.inline(vals))
            .select("entity", "tbl", "metric", "ts", "value", "seq"))


def net_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> per (supplier, return flag, ship day) network/cache counters.

    A supplier ships few lines a day, so they are dealt by supplier before they are summed."""
    li = table(spark, sf_dir, "lineitem")
    lines = keyed(li, "l_suppkey", "l_returnflag").select(
        named("server-", "l_suppkey").alias("entity"), named("net_", "l_returnflag").alias("tbl"), F.col("l_shipdate").alias("ts"),
        "l_extendedprice", "l_quantity", "l_discount")
    return (by_entity(lines, li).groupBy("entity", "tbl", "ts")
            .agg(rnd(F.sum("l_extendedprice"), 2).alias("bytes_sent"),
                 F.sum("l_quantity").alias("bytes_recv"),
                 F.count(F.lit(1)).cast("double").alias("cmd_get"),
                 F.count_if(F.col("l_discount") > 0.045).cast("double").alias("get_hits")))


def net_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    # inline, as an unpivot would lose that the rows lie by entity
    rows = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in NET_METRICS]))
    return net_wide(spark, sf_dir).select("entity", "tbl", "ts", rows).select("entity", "tbl", "metric", "ts", "value")


def metric_catalog(spark: SparkSession) -> DataFrame:
    """Metric kinds of the derived views (GAUGE / DERIVE, heartbeat, bounds)."""
    rows = [
        ("app", "value", "GAUGE", 86400, None, None),
        ("app", "requests", "DERIVE", 86400, 0.0, None),
        ("app", "requests_wrap", "DERIVE", 86400, 0.0, None),
        ("net", "bytes_sent", "DERIVE", 86400, 0.0, None),
        ("net", "bytes_recv", "DERIVE", 86400, 0.0, None),
        ("net", "cmd_get", "DERIVE", 86400, 0.0, None),
        ("net", "get_hits", "DERIVE", 86400, 0.0, None),
    ]
    return spark.createDataFrame(
        rows, "plugin string, metric string, kind string, heartbeat_s int, min_v double, max_v double")
