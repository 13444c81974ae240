"""Streaming operators (file source, availableNow) equal their batch twins."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions.timecols import bucket_start
from tidemark.operators import alarms as AL
from tidemark.operators import combine as C
from tidemark.operators import windows as Wn
from tidemark.plans import q_alarms
from tidemark.sources import testdata as T
from tidemark.streaming import ingest as I
from tidemark.streaming import live as L
from tidemark.streaming import state as ST


@pytest.fixture(scope="module")
def scratch():
    return tempfile.mkdtemp(prefix="tidemark-stream-", dir="/tmp")


def _write_in_time_order(df, path, cuts, ts="ts"):
    """Write ``df`` as one parquet folder per time slice, oldest first."""
    lo = None
    for i, hi in enumerate(cuts + [None]):
        part = df
        if lo is not None:
            part = part.where(F.col(ts) >= F.lit(lo).cast("timestamp_ntz"))
        if hi is not None:
            part = part.where(F.col(ts) < F.lit(hi).cast("timestamp_ntz"))
        part.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, f"f{i:02d}"))
        lo = hi


def _split_late_and_flush(df, path, flush, ts="ts"):
    """Files whose rows overlap in time (a sample's rows stand in two files, one file comes
    twice, one comes late), then one row of another key far ahead that closes all times."""
    halves = [df.where(F.pmod(F.xxhash64(*df.columns), F.lit(3)) == i) for i in range(3)]
    for i, part in enumerate([halves[0], halves[1], halves[0], halves[2]]):
        part.coalesce(1).write.parquet(os.path.join(path, f"f{i:02d}"))
    _flush(df, path, flush)


def _flush(df, path, flush):
    df.sparkSession.createDataFrame([flush], df.schema).write.parquet(os.path.join(path, "zz"))


FAR = dt.datetime(2090, 1, 1)


def _collect(stream, scratch, name, mode="append"):
    out = []
    q = (stream.writeStream.outputMode(mode).foreachBatch(lambda b, i: out.extend(b.collect()))
         .option("checkpointLocation", os.path.join(scratch, "ck-" + name)).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def _src(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(path)


def test_ingest_unstack_unnest_dedup(spark, sf, scratch):
    net = T.net_long(spark, sf)
    wide = net.groupBy("entity", "ts", "tbl").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    samples = wide.groupBy("entity", "ts").agg(F.map_from_entries(F.collect_list(F.struct("tbl", "m"))).alias("tables"))
    stacks = samples.groupBy("entity", F.year("ts").alias("y")).agg(
        F.collect_list(F.struct(F.col("entity").alias("client"), F.col("ts").alias("datetime"), "tables")).alias("stack"),
        F.min("ts").alias("ts"))
    path = os.path.join(scratch, "stacks")
    _write_in_time_order(stacks.select("stack", "ts"), path, ["1997-01-01", "1999-01-01"])
    # the same batch delivered twice: duplicates must disappear
    stacks.where(F.col("ts") >= F.lit("1999-01-01").cast("timestamp_ntz")).select("stack", "ts") \
        .coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "f99"))
    stream = I.dedup(I.unnest(I.unstack(_src(spark, path, I.STACK_SCHEMA + ", ts timestamp_ntz"))), delay="3650 days")
    got = {(r["entity"], r["tbl"], r["metric"], r["ts"], r["value"]) for r in _collect(stream, scratch, "ingest")}
    rows = _collect(stream, scratch, "ingest")  # same checkpoint: the query resumes, nothing new
    assert rows == []
    want = {tuple(r) for r in net.select("entity", "tbl", "metric", "ts", "value").collect()}
    assert got == want


def test_tumbling_rollup_matches_batch(spark, sf, scratch):
    net = T.net_long(spark, sf).where(F.col("metric") == "cmd_get")
    path = os.path.join(scratch, "tumble")
    _write_in_time_order(net, path, ["1996-01-01", "1998-01-01", "2000-01-01"])
    s = I.tumbling_max(_src(spark, path, I.LONG_SCHEMA), "30 days", "0 seconds", points_per_bucket=30)
    got = {(r["entity"], r["tbl"], r["ts"]): r["value"] for r in _collect(s, scratch, "tumble")}
    batch = net.groupBy("entity", "tbl", bucket_start("ts", 30 * 86400).alias("ts")).agg(
        F.max("value").alias("mx"), F.count("value").alias("known"))
    want = {(r["entity"], r["tbl"], r["ts"]): (r["mx"] if r["known"] >= 15 else None) for r in batch.collect()}
    last = max(r["ts"] for r in net.select("ts").collect())
    closed = {k: v for k, v in want.items() if k[2] + dt.timedelta(days=30) <= last}   # the others are still open
    assert got and got.items() >= closed.items() and all(want[k] == v for k, v in got.items())


LONG = ("zz", "t", "m", FAR, 0.0)


def _changes(rows):
    return {(r["entity"], r["tbl"], r["metric"], r["ts"]): (r["diff_sec"], r["change_per_sec"]) for r in rows if r["entity"] != "zz"}


@pytest.mark.parametrize("how", ["ordered", "split"])
def test_stateful_change_per_second(spark, sf, scratch, how):
    src = T.counter_long(spark, sf).drop("seq")
    path = os.path.join(scratch, "changes-" + how)
    if how == "ordered":
        _write_in_time_order(src, path, ["2024-01-08", "2024-01-16", "2024-01-24"])
        _flush(src, path, LONG)
    else:
        _split_late_and_flush(src, path, LONG)
    stream = ST.change_per_second(_src(spark, path, I.LONG_SCHEMA), delay="10 seconds" if how == "ordered" else "3650 days")
    got, want = _changes(_collect(stream, scratch, "cps-" + how)), _changes(Wn.change_per_second(src).collect())
    assert got.keys() == want.keys() and got
    for k in want:
        assert got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1])


def test_state_of_a_vanished_client_goes(spark, scratch):
    t = dt.datetime(2024, 1, 1)
    path = os.path.join(scratch, "vanished")
    for i, (name, at) in enumerate([("a", t), ("b", t + dt.timedelta(days=2)), ("b", t + dt.timedelta(days=4)),
                                    ("a", t + dt.timedelta(days=6)), ("zz", FAR)]):
        spark.createDataFrame([(name, "t", "m", at, float(i))], I.LONG_SCHEMA).coalesce(1).write.parquet(os.path.join(path, f"f{i}"))
    got = _changes(_collect(ST.change_per_second(_src(spark, path, I.LONG_SCHEMA), idle="1 day"), scratch, "vanished"))
    assert all(k[0] != "a" for k in got)   # its previous sample was forgotten
    kept = _changes(_collect(ST.change_per_second(_src(spark, path, I.LONG_SCHEMA), idle="30 days"), scratch, "kept"))
    assert {k[0] for k in kept} == {"a", "b"}


@pytest.mark.parametrize("how", ["ordered", "split"])
def test_stateful_suppression(spark, sf, scratch, how):
    alarms = q_alarms._abs_alarms(spark, sf)
    path, flush = os.path.join(scratch, "alarms-" + how), (FAR, "zz", 0, "flush")
    if how == "ordered":
        _write_in_time_order(alarms, path, ["2024-01-10", "2024-01-20"])
        _flush(alarms, path, flush)
    else:
        _split_late_and_flush(alarms, path, flush)
    stream = ST.suppress(_src(spark, path, ST.ALARM_SCHEMA), delay="10 seconds" if how == "ordered" else "20000 days")
    got = {(r["alarm_key"], r["ts"]) for r in _collect(stream, scratch, "sup-" + how) if r["alarm_key"] != "zz"}
    assert got == {(r["alarm_key"], r["ts"]) for r in AL.suppress(alarms).collect()} and got


@pytest.mark.parametrize("how", ["ordered", "split"])
def test_stateful_membership(spark, sf, scratch, how):
    o = T.table(spark, sf, "orders")
    snaps = o.select(F.lit("all").alias("grp"), (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("int")
                     .alias("snap"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ts"),
                     F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("member")).distinct()
    path, flush = os.path.join(scratch, "snaps-" + how), ("zz", 0, FAR, "x")
    if how == "ordered":
        _write_in_time_order(snaps, path, ["1996-01-01", "1999-01-01"])
        _flush(snaps, path, flush)
    else:
        _split_late_and_flush(snaps, path, flush)
    src = _src(spark, path, "grp string, snap int, ts timestamp_ntz, member string")
    stream = ST.membership_changes(src, delay="10 seconds" if how == "ordered" else "3650 days")
    got = {(r["snap"], r["member"], r["change"]) for r in _collect(stream, scratch, "mem-" + how)}
    want = {tuple(r) for r in C.snapshot_changes(snaps.select("snap", "member").distinct(),
                                                 prev_snap_col=lambda s: s - 1).collect()}
    assert got == want and got


def test_fan_out_and_cursor(spark, sf, scratch):
    src_df = T.gauge_long(spark, sf).drop("seq")
    path = os.path.join(scratch, "fan")
    _write_in_time_order(src_df, path, ["2024-01-15"])
    a, b = os.path.join(scratch, "tier_a"), os.path.join(scratch, "tier_b")
    seen = []
    body = I.fan_out([I.parquet_target(a), I.parquet_target(b), lambda df, i: seen.append(df.count())])
    q = L.cursor(_src(spark, path, I.LONG_SCHEMA), body, os.path.join(scratch, "ck-fan"), available_now=True)
    q.awaitTermination()
    n = src_df.count()
    assert spark.read.parquet(a).count() == n == spark.read.parquet(b).count() == sum(seen)


def test_live_window(spark, sf, scratch):
    src_df = T.gauge_long(spark, sf).drop("seq")
    path = os.path.join(scratch, "live")
    _write_in_time_order(src_df, path, ["2024-01-15"])
    view = L.live_window(_src(spark, path, I.LONG_SCHEMA), "1 day", delay="0 seconds")
    got = {}
    for r in _collect(view, scratch, "live", mode="update"):   # a later row of a key and window replaces the earlier
        k = (r["entity"], r["tbl"], r["metric"], r["window_start"])
        got[k] = max(got.get(k, r), r, key=lambda x: x["ts"])
    day = bucket_start("ts", 86400)
    want = src_df.groupBy("entity", "tbl", "metric", day.alias("w")).agg(F.max("ts").alias("ts")).collect()
    assert {k: r["ts"] for k, r in got.items()} == {(r["entity"], r["tbl"], r["metric"], r["w"]): r["ts"] for r in want}


def test_stateful_counter_rate(spark, sf, scratch):
    src = T.counter_long(spark, sf).drop("seq")
    path = os.path.join(scratch, "rates")
    _split_late_and_flush(src, path, LONG)
    got = {(r["entity"], r["metric"], r["ts"]): r["rate"] for r in
           _collect(ST.counter_rate(_src(spark, path, I.LONG_SCHEMA), heartbeat_s=86400, delay="3650 days"), scratch, "rate")
           if r["entity"] != "zz"}
    kinded = src.withColumn("kind", F.lit("DERIVE")).withColumn("heartbeat_s", F.lit(86400)) \
        .withColumn("min_v", F.lit(0.0)).withColumn("max_v", F.lit(None).cast("double"))
    want = {(r["entity"], r["metric"], r["ts"]): r["rate"] for r in Wn.counter_rate(kinded).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k] is None and v is None) or got[k] == pytest.approx(v)


def test_collector_raw_and_rollup_tiers(spark, sf, scratch):
    from tidemark.streaming import collector as CO
    net = T.net_long(spark, sf)
    wide = net.groupBy("entity", "ts", "tbl").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    samples = wide.groupBy("entity", "ts").agg(F.map_from_entries(F.collect_list(F.struct("tbl", "m"))).alias("tables"))
    stacks = samples.groupBy("entity", F.year("ts").alias("y")).agg(
        F.collect_list(F.struct(F.col("entity").alias("client"), F.col("ts").alias("datetime"), "tables")).alias("stack"),
        F.min("ts").alias("ts"))
    src = os.path.join(scratch, "collector_src")
    _write_in_time_order(stacks.select("stack", "ts"), src, ["1997-01-01", "1999-01-01"])
    raw, roll, ck = (os.path.join(scratch, x) for x in ("store_raw", "store_rollup", "ck-collector"))
    CO.ingest_to_store(spark, src, raw, ck, delay="3650 days", available_now=True, recursive=True).awaitTermination()
    CO.rollup_to_store(spark, src, roll, ck, "30 days", delay="0 seconds", points_per_bucket=30,
                       available_now=True, recursive=True).awaitTermination()
    stored = spark.read.parquet(raw).select("entity", "tbl", "metric", "ts", "value")
    assert stored.exceptAll(net).count() == 0 and net.exceptAll(stored).count() == 0
    tier = {(r["entity"], r["tbl"], r["metric"], r["ts"]): r["value"] for r in spark.read.parquet(roll).collect()}
    batch = net.groupBy("entity", "tbl", "metric", bucket_start("ts", 30 * 86400).alias("ts")).agg(
        F.max("value").alias("mx"), F.count("value").alias("known"))
    want = {(r["entity"], r["tbl"], r["metric"], r["ts"]): (r["mx"] if r["known"] >= 15 else None)
            for r in batch.collect()}
    assert tier and all(want[k] == v for k, v in tier.items())


def test_alarm_stream_two_stages(spark, sf, scratch):
    from tidemark.operators import rules as RU
    from tidemark.streaming import alerting as AS
    src_df = T.counter_long(spark, sf).drop("seq")
    path = os.path.join(scratch, "alarm_src")
    _write_in_time_order(src_df, path, ["2024-01-10", "2024-01-20"])
    _flush(src_df, path, LONG)
    rules = RU.abs_rules_frame(spark, q_alarms.ABS_RULES)
    alarms, sink, ck = (os.path.join(scratch, x) for x in ("alarm_table", "alarm_sink", "ck-alarms"))
    AS.detect(_src(spark, path, I.LONG_SCHEMA), rules, alarms, ck, available_now=True).awaitTermination()
    spark.createDataFrame([(FAR, "zz", 0, "flush")], ST.ALARM_SCHEMA).write.parquet(os.path.join(alarms, "batch=999999999"))
    AS.notify(spark, alarms, sink, ck, available_now=True).awaitTermination()
    batch_alarms = AL.threshold_alarms(Wn.change_per_second(src_df), rules)
    want = {(r["alarm_key"], r["ts"]) for r in AL.suppress(batch_alarms).collect()}
    got = {(r["alarm_key"], r["ts"]) for r in spark.read.parquet(sink).collect()}
    assert {g for g in got if g[0] != "zz"} == want and want
