"""Raw status dumps derived from the driver tables, one row per dump, in
the dialects the collectors read: ``STAT k v`` (stat), ``k:v`` (info),
``k = v`` (kv), positional rows (jstat) and ``PREFIX p k v ...`` (prefix)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .testdata import net_wide, table

CRLF = "\r\n"
JSTAT_HEADER = "S0 S1 E O M CCS YGC YGCT FGC FGCT"


def _s(c: Column) -> Column:
    return c.cast("bigint").cast("string")


def _millis_text(ms: Column) -> Column:
    """Integer milliseconds -> 'S.mmm' seconds text."""
    return F.concat(_s(F.floor(ms / 1000)), F.lit("."), F.lpad(_s(ms % 1000), 3, "0"))


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = net_wide(spark, sf_dir)
    flag = F.substring("tbl", 5, 1)
    cg, gh, br = _s(F.col("cmd_get")), _s(F.col("get_hits")), _s(F.col("bytes_recv"))
    cents = _s(F.floor(F.col("bytes_sent") * 100 + 0.5))
    stat = F.concat_ws(CRLF, F.concat(F.lit("STAT cmd_get "), cg),
                       F.when(F.col("cmd_get") % 2 == 0, F.concat(F.lit("STAT get_hits "), gh)),
                       F.concat(F.lit("STAT bytes_read "), br), F.concat(F.lit("STAT bytes_written "), cents),
                       F.lit("STAT threads 4"), F.when(F.col("get_hits") > 0, F.lit("END")))
    suffix = F.when(F.col("cmd_get") % 3 == 0, "K").when(F.col("cmd_get") % 3 == 1, "M").otherwise("G")
    info = F.concat_ws(CRLF, F.lit("# Stats"), F.concat(F.lit("total_commands_processed:"), cg),
                       F.concat(F.lit("keyspace_hits:"), gh),
                       F.concat(F.lit("keyspace_misses:"), _s(F.col("cmd_get") - F.col("get_hits"))),
                       F.concat(F.lit("used_memory_human:"), br, suffix),
                       F.concat(F.lit("cmdstat_get:calls="), cg, F.lit(",usec="), br, F.lit(",usec_per_call=0.50")),
                       F.lit(""))
    kv = F.concat_ws(CRLF, F.concat(F.lit("num_query_selects = "), cg),
                     F.concat(F.lit("num_data_page_fetches = "), br),
                     F.concat(F.lit("num_data_page_ioreads = "), gh), F.lit("*** DETAIL ***"),
                     F.lit("num_query_selects = 999"))
    vals = F.concat_ws("  ", cg, gh, br, _s(F.col("cmd_get") + F.col("get_hits")), _s(F.col("bytes_recv") + 1),
                       F.lit("0"), cg, _millis_text(F.col("bytes_recv").cast("bigint") * 13), gh,
                       _millis_text(F.col("get_hits").cast("bigint") * 17))
    jstat = F.concat_ws(CRLF, F.lit(JSTAT_HEADER), F.concat(F.lit(" "), vals),
                        F.when(F.col("get_hits") == 0, F.lit("1 2 3 4 5 6 7 8 9")))
    base = n.select("entity", flag.alias("flag"), "ts", stat.alias("stat"), info.alias("info"),
                    kv.alias("kv"), jstat.alias("jstat"))
    parts = [base.select("entity", F.concat(F.lit(p + "_"), "flag").alias("tbl"), "ts",
                         F.lit(dialect).alias("dialect"), F.col(dialect).alias("text"))
             for dialect, p in (("stat", "memcached"), ("info", "redis"), ("kv", "cubrid"), ("jstat", "jstat"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prefix_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ``stats detail dump`` per (supplier, month): a line per part type."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    month = F.make_timestamp_ntz(F.year("l_shipdate"), F.month("l_shipdate"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    j = li.join(part, li.l_partkey == part.p_partkey)
    g = j.groupBy("l_suppkey", month.alias("ts"), "p_type").agg(
        F.count(F.lit(1)).alias("g"), F.count_if(F.col("l_discount") > 0.045).alias("h"),
        F.sum("l_quantity").cast("bigint").alias("s"))
    line = F.concat(F.lit("PREFIX "), F.col("p_type"), F.lit(" get "), _s(F.col("g")), F.lit(" hit "),
                    _s(F.col("h")), F.lit(" set "), _s(F.col("s")))
    per_dump = g.groupBy("l_suppkey", "ts").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    text = F.concat(F.array_join("lines", CRLF), F.lit(CRLF + "END"))
    return per_dump.select(F.concat(F.lit("server-"), _s(F.col("l_suppkey"))).alias("entity"),
                           F.lit("memcached_prefix").alias("tbl"), "ts", text.alias("text"))
