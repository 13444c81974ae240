"""Edge rules and brute-force restatements on small hand-made frames."""

import bisect
import datetime as dt
import fnmatch
import hashlib
import random
import zlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.bitmask import eflag_predicate
from tidemark.functions.patterns import glob_to_regex
from tidemark.operators import aggregate as A
from tidemark.operators import alarms as AL
from tidemark.operators import placement as PL
from tidemark.operators import rules as RU
from tidemark.operators import seqwindow as SW
from tidemark.operators import windows as Wn
from tidemark.operators.downsample import downsample_minmax

T0 = dt.datetime(2024, 1, 1)


def _frame(spark, rows, schema="entity string, tbl string, metric string, ts timestamp_ntz, value double"):
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------ aggregates --
def test_series_aggregate_null_rules(spark):
    rows = [("a", "t", "m", T0 + dt.timedelta(seconds=i), v) for i, v in enumerate([1.0, None, 3.0, -9.0])]
    rows += [("b", "t", "m", T0, None), ("b", "t", "m", T0 + dt.timedelta(seconds=5), None)]
    out = {r["entity"]: r for r in A.series_stats(_frame(spark, rows)).collect()}
    assert out["a"]["total"] == -5.0
    assert out["a"]["avg"] == pytest.approx(-5.0 / 4)       # nulls count in the denominator
    assert out["a"]["max"] == 3.0
    assert out["b"]["max"] == 0.0                            # floored at 0
    assert out["b"]["total"] == 0.0 and out["b"]["min"] is None and out["b"]["avg"] is None


def test_sum_instances_null_rules(spark):
    rows = [(0, "c", 0, "i", "e1", "t", T0, 1.0), (0, "c", 0, "i", "e2", "t", T0, None),
            (0, "c", 0, "i", "e1", "t", T0 + dt.timedelta(seconds=5), None),
            (0, "c", 0, "i", "e2", "t", T0 + dt.timedelta(seconds=5), None)]
    df = spark.createDataFrame(rows, "chart_ord int, chart_title string, item_ord int, item_title string, "
                                     "entity string, tbl string, ts timestamp_ntz, value double")
    got = {r["ts"]: r["value"] for r in A.sum_instances(df).collect()}
    assert got[T0] == 1.0 and got[T0 + dt.timedelta(seconds=5)] is None


def test_rollup_xff(spark):
    # 12 five-second points per minute; 5 known -> null, 6 known -> max
    rows = [("e", "t", "m", T0 + dt.timedelta(seconds=5 * i), float(i) if i < 5 else None) for i in range(12)]
    rows += [("e", "t", "m", T0 + dt.timedelta(seconds=60 + 5 * i), float(i) if i < 6 else None) for i in range(12)]
    out = A.rollup_tier(_frame(spark, rows), ["entity", "tbl", "metric"], 5, 60).orderBy("ts").collect()
    assert [r["value"] for r in out] == [None, 5.0]


def test_bucket_width_rule():
    assert A.bucket_width(1800) is None          # 360 steps of 5 s: raw points
    assert A.bucket_width(2001 * 5) == int(2001 * 5 / 400)


# ------------------------------------------------------------- sequences --
@pytest.fixture(scope="module")
def hot_series(spark):
    rnd = random.Random(7)
    rows = []
    for k, n in (("hot", 400), ("cold", 30)):
        t = T0
        for _ in range(n):
            t = t + dt.timedelta(seconds=rnd.choice([1, 60, 3600, 30000]))
            rows.append((k, t, rnd.choice([None, rnd.uniform(-5, 5)])))
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")


def test_skew_safe_helpers_equal_plain_windows(spark, hot_series):
    w = Window.partitionBy("k").orderBy("ts")
    plain = hot_series.select(
        "k", "ts", F.lag("ts").over(w).alias("pts"), F.lag("v").over(w).alias("pv"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("rs"),
        F.row_number().over(w).alias("pos"),
        F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cf"))
    a = SW.prev_row(hot_series, ["k"], "ts", ["v"], split_s=3600)
    a = SW.running_sums(a, ["k"], "ts", {"rs": F.col("v")}, split_s=7200)
    a = SW.position(a, ["k"], "ts", "pos", split_s=600)
    a = SW.carry_forward(a, ["k"], "ts", "v", name="cf", split_s=86400)
    got = {(r["k"], r["ts"]): (r["prev_ts"], r["prev_v"], r["rs"], r["pos"], r["cf"]) for r in a.collect()}
    for r in plain.collect():
        g = got[(r["k"], r["ts"])]
        assert g[0] == r["pts"] and g[1] == r["pv"] and g[3] == r["pos"] and g[4] == r["cf"]
        assert (g[2] or 0.0) == pytest.approx(r["rs"] or 0.0)


def test_building_ordered_queries_runs_no_job_on_the_data(spark, sf):
    from tidemark.plans.registry import load_all
    reg, sc = load_all(), spark.sparkContext
    tracker = sc.statusTracker()
    for name in ("delta", "counter_rate", "change_per_sec", "locf", "history_expr", "downsample_minmax",
                 "threshold_alarms", "predicate_alarms", "suppressed_alarms", "quiet_hours"):
        sc.setJobGroup("build-" + name, name)
        reg[name][0](spark, sf)
        schemas = sum(len(tracker.getStageInfo(s).name) > 0 and "parquet at" in tracker.getStageInfo(s).name
                      for j in tracker.getJobIdsForGroup("build-" + name) for s in tracker.getJobInfo(j).stageIds)
        assert len(tracker.getJobIdsForGroup("build-" + name)) == schemas, name   # only footers are read
    sc.setJobGroup(None, None)


def test_counter_rate_nulls(spark):
    rows = [("e", "c_x", "m", T0, 100.0), ("e", "c_x", "m", T0 + dt.timedelta(seconds=10), 150.0),
            ("e", "c_x", "m", T0 + dt.timedelta(seconds=20), 40.0),          # reset -> negative -> null
            ("e", "c_x", "m", T0 + dt.timedelta(seconds=200), 60.0)]         # gap > heartbeat -> null
    df = _frame(spark, rows).withColumn("kind", F.lit("DERIVE")).withColumn("heartbeat_s", F.lit(60)) \
        .withColumn("min_v", F.lit(0.0)).withColumn("max_v", F.lit(None).cast("double"))
    got = [r["rate"] for r in Wn.counter_rate(df).orderBy("ts").collect()]
    assert got == [None, 5.0, None, None]
    d = [r["delta"] for r in Wn.raw_delta(df).orderBy("ts").collect()]
    assert d == [0.0, 50.0, -110.0, 20.0]


# ------------------------------------------------------------ downsample --
def _ref_downsample(points, r):
    n = len(points)
    if n < 2 * r:
        return points
    per = n // r
    out, mn, mx = [], None, None
    for idx, (t, v) in enumerate(points, 1):
        if v is not None:
            if mn is None or v < mn[1]:
                mn = (t, v)
            if mx is None or v > mx[1]:
                mx = (t, v)
        if idx % per == 0:
            if mn is not None:
                out += sorted({mn, mx})
            mn = mx = None
    return points if len(out) < r / 2 else out


def test_downsample_equals_restatement(spark):
    rnd = random.Random(3)
    rows, expect = [], {}
    for s in range(8):
        n = rnd.choice([15, 40, 97, 260])
        pts = []
        for i in range(n):
            v = None if rnd.random() < (0.9 if s == 5 else 0.1) else float(rnd.randint(0, 9))
            pts.append((T0 + dt.timedelta(minutes=7 * i), v))
        expect[f"s{s}"] = sorted(_ref_downsample(pts, 20), key=lambda p: p[0])
        rows += [(f"s{s}", t, v) for t, v in pts]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double")
    got = {}
    for r in downsample_minmax(df, ["k"], resolution=20, split_s=3600).collect():
        got.setdefault(r["k"], []).append((r["ts"], r["value"]))
    for k, pts in expect.items():
        assert sorted(got.get(k, []), key=lambda p: p[0]) == pts, k


# ------------------------------------------------------------ suppression --
def test_suppress_equals_greedy(spark):
    rnd = random.Random(11)
    rows = []
    for key in ("a", "b", "c"):
        t = T0
        for _ in range(rnd.randint(5, 60)):
            t += dt.timedelta(seconds=rnd.choice([60, 3600, 7200, 21600, 30000]))
            rows.append((t, key, 0, "m"))
    df = spark.createDataFrame(rows, "ts timestamp_ntz, alarm_key string, level int, message string")
    want = set()
    for key in ("a", "b", "c"):
        last = None
        for t in sorted(r[0] for r in rows if r[1] == key):
            if last is None or t >= last + dt.timedelta(seconds=21600):
                want.add((key, t))
                last = t
    got = {(r["alarm_key"], r["ts"]) for r in AL.suppress(df, 21600).collect()}
    assert got == want


def test_quiet_hours_crossing_midnight(spark):
    times = [dt.datetime(2024, 1, 1, h, m) for h, m in ((21, 59), (22, 0), (22, 1), (3, 0), (7, 0), (6, 59))]
    df = spark.createDataFrame([(t, "k", 0, "m") for t in times], "ts timestamp_ntz, alarm_key string, level int, message string")
    kept = sorted(r["ts"].time() for r in AL.quiet_hours(df, "22:00", "07:00").collect())
    assert kept == [dt.time(7, 0), dt.time(21, 59), dt.time(22, 0)]


# ------------------------------------------------------------------ rules --
def test_glob_translation_matches_fnmatch():
    rnd = random.Random(5)
    pats = ["*:net-*", "host-?:*", "h[0-3]*", "*", "a.b*", "x[!ab]y", "*-9?:*"]
    words = ["".join(rnd.choice("ab0123h-.:xyt*?") for _ in range(rnd.randint(0, 8))) for _ in range(400)]
    import re
    for p in pats:
        rx = re.compile(glob_to_regex(p).replace("\\:", ":"))
        for w in words + ["host-1:cpu", "a.bc", "xcy", "s-91:z"]:
            assert bool(rx.match(w)) == fnmatch.fnmatchcase(w, p), (p, w)


def test_rule_first_match(spark):
    rules = RU.abs_rules_frame(spark, [RU.AbsRule("*:c", {"m": (1, 2, 3)}, ignore="h9*"),
                                       RU.AbsRule("h9:*", {"m": (4, 5, 6)}),
                                       RU.AbsRule("h1:c", {"m": (7, 8, 9)})])
    keys = spark.createDataFrame([("h1:c",), ("h2:c",), ("h9:c",), ("zz",)], "key string")
    got = dict(RU.match_first(keys, RU.rule_heads(rules)).collect())
    assert got == {"h1:c": 2, "h2:c": 0, "h9:c": 1}


# -------------------------------------------------------------- placement --
def _le32(b: bytes, i: int) -> int:
    return b[4 * i] | b[4 * i + 1] << 8 | b[4 * i + 2] << 16 | b[4 * i + 3] << 24


def test_ring_placement_equals_bisect(spark):
    nodes = [f"10.0.0.{i}:112{i}" for i in range(7)]
    ring = sorted((_le32(hashlib.md5(f"{n}-{r}".encode()).digest(), w), n) for n in nodes for r in range(40)
                  for w in range(4))
    hashes = [p for p, _ in ring]
    keys = [f"key:{i}" for i in range(3000)]
    want = {}
    for k in keys:
        h = _le32(hashlib.md5(k.encode()).digest(), 0)
        idx = bisect.bisect_right(hashes, h)
        want[k] = ring[idx if idx < len(ring) else 0][1]
    kdf = spark.createDataFrame([(k,) for k in keys], "key string")
    ndf = spark.createDataFrame([(n,) for n in nodes], "addr string")
    got = {r["key"]: r["node"] for r in PL.place_keys(kdf, PL.ring_points(ndf), bits=6).collect()}
    assert got == want


def test_shard_id_equals_zlib(spark):
    names = [f"host-{i}" for i in range(200)] + ["데이터-1", "ümlaut"]
    df = spark.createDataFrame([(n,) for n in names], "entity string")
    got = dict(df.select("entity", PL.shard_id(F.col("entity"), 7).alias("s")).collect())
    assert got == {n: zlib.crc32(n.encode("utf-8")) % 7 for n in names}


def test_bitmask_filters(spark):
    flags = [f"{k:04X}" for k in range(200, 401)] + ["01", "F1"]
    df = spark.createDataFrame([(f,) for f in flags], "flag string")

    def ref(f, off, op, mask, cmp, rhs):
        w = len(rhs) - 2 if mask is None else len(mask) - 2
        seg = f[off * 2: off * 2 + w]
        if len(f) < off * 2 + w:
            return False
        v = int(seg, 16)
        if mask:
            v = {"&": v & int(mask, 16), "|": v | int(mask, 16), "^": v ^ int(mask, 16)}[op]
        r = int(rhs, 16)
        return {"==": v == r, "!=": v != r, ">": v > r, "<": v < r, ">=": v >= r, "<=": v <= r}[cmp]

    cases = [("EFLAG & 0x00ff == 0x0001", 0, "&", "0x00ff", "==", "0x0001"),
             ("EFLAG & 0x00ff > 0x0010", 0, "&", "0x00ff", ">", "0x0010"),
             ("EFLAG[1:] | 0x0f != 0x3f", 1, "|", "0x0f", "!=", "0x3f"),
             ("EFLAG >= 0x0150", 0, None, None, ">=", "0x0150")]
    for expr, *spec in cases:
        got = {r["flag"] for r in df.where(eflag_predicate(expr, "flag")).collect()}
        assert got == {f for f in flags if ref(f, *spec)}, expr


# ------------------------------------------------- cache-client fixtures ---
def test_btree_range_count_and_multi_key_merge(spark):
    """Fixture shapes of the cache client's functional script: keyed b-tree
    items, a range count, a multi-key merged range fetch with missing keys."""
    items = [("k1", b, b) for b in range(0, 1000)] + [("k2", b, b) for b in range(1000, 2000)] \
        + [("k3", b, b) for b in range(2000, 3000)]
    df = spark.createDataFrame(items, "key string, bkey long, value long")
    one = df.where(F.col("key") == "k1")
    assert one.where(F.col("bkey").between(200, 400)).count() == 201
    assert one.where(F.col("bkey").between(100, 199)).count() == 100
    keys = spark.createDataFrame([("k1",), ("k2",), ("k3",), ("nope1",), ("nope2",)], "key string")
    page, missing = PL.multi_range_fetch(df, keys, 500, 2500, offset=0, count=3000)
    got = [(r["key"], r["bkey"]) for r in page.collect()]
    assert got == [(("k1", "k2", "k3")[b // 1000], b) for b in range(500, 2501)]
    assert sorted(r["key"] for r in missing.collect()) == ["nope1", "nope2"]
    page2, _ = PL.multi_range_fetch(df, keys, 500, 2500, offset=10, count=5)
    assert [r["bkey"] for r in page2.collect()] == [510, 511, 512, 513, 514]
    flagged = df.withColumn("flag", F.lpad(F.hex("bkey"), 4, "0"))
    assert flagged.where((F.col("key") == "k1") & F.col("bkey").between(200, 400)) \
        .where(eflag_predicate("EFLAG & 0x00ff == 0x0001", "flag")).count() == 1


def test_every_level_of_a_rule_fires_alone(spark):
    from tidemark.operators import alarms as AL
    from tidemark.operators import rules as RU
    ch = spark.createDataFrame([("e", "p_x", "m", T0, 100.0)], "entity string, tbl string, metric string, ts timestamp_ntz, change_per_sec double")
    four = RU.abs_rules_frame(spark, [RU.AbsRule("e:*", {"m": (1, None, 50, 99)})])
    assert sorted(r["level"] for r in AL.threshold_alarms(ch, four).collect()) == [0, 2, 3]
    one = RU.abs_rules_frame(spark, [RU.AbsRule("e:*", {"m": (1,)})])
    assert [r["level"] for r in AL.threshold_alarms(ch, one).collect()] == [0]


def test_long_prefix_dumps_and_repeated_keys(spark):
    from tidemark.operators import normalize as N
    text = "\r\n".join(f"PREFIX p{i} a {i} b 1 a {i + 1}" for i in range(60)) + "\r\nEND"
    df = spark.createDataFrame([("e", "t", T0, text)], "entity string, tbl string, ts timestamp_ntz, text string")
    got = {(r["prefix"], r["key"]): r["raw"] for r in N.parse_prefix(df).collect()}
    assert len(got) == 120 and got["p7", "a"] == "8" and got["p59", "b"] == "1"


def test_flag_filters_are_read_word_by_word():
    from tidemark.functions.bitmask import parse_eflag
    assert parse_eflag("EFLAG & 0x00ff == 0x0001") == (0, "&", "0x00ff", "==", "0x0001")
    assert parse_eflag(" EFLAG[2:]>=0x30 ") == (2, None, None, ">=", "0x30")
    assert parse_eflag("EFLAG [:] ^ 0x1 != 0x0") == (0, "^", "0x1", "!=", "0x0")
    for bad in ("", "FLAG == 0x1", "EFLAG", "EFLAG & 0x1", "EFLAG = 0x1", "EFLAG == 12", "EFLAG[1] == 0x1", "EFLAG == 0x1 0x2", "EFLAG[1:2:] == 0x1"):
        with pytest.raises(ValueError):
            parse_eflag(bad)


def test_fleet_search_tests_keys_without_the_metric(spark):
    from tidemark.operators.search import derive, fleet_search
    rows = [("a", "t", "cmd_get", T0, 3.0), ("a", "t", "x", T0, 0.0), ("b", "t", "other", T0, 9.0), ("c", "t", "cmd_get", T0, 7.0)]
    df = _frame(spark, rows)
    keys, series = fleet_search(df, lambda m: m.max("cmd_get") < 5, output=lambda s: s.groupBy("entity").count())
    assert sorted(r["entity"] for r in keys.collect()) == ["a", "b"] and sorted(map(tuple, series.collect())) == [("a", 2), ("b", 1)]
    assert [r["value"] for r in derive(df.where(F.col("entity") == "a"), "r", lambda m: m["cmd_get"] / m["x"]).collect()] == [None]


def test_suppression_against_a_plain_walk(spark):
    from tidemark.operators import alarms as AL
    rnd = random.Random(3)
    rows = [(T0 + dt.timedelta(seconds=rnd.randrange(0, 40) * 100), f"k{rnd.randrange(4)}", i % 3, f"m{i}") for i in range(400)]
    got = sorted(map(tuple, AL.suppress(spark.createDataFrame(rows, "ts timestamp_ntz, alarm_key string, level int, message string"), 750).collect()))
    last, want = {}, []
    for r in sorted(rows, key=lambda x: (x[1], x[0])):
        if r[1] not in last or r[0] == last[r[1]] or (r[0] - last[r[1]]).total_seconds() >= 750:
            last[r[1]] = r[0]
            want.append(r)
    assert got == sorted(want)


def test_suppression_of_a_hot_key_is_cut_into_slices(spark):
    """One key has nearly all alarms, with no gap of a window: no task gets them all, and the result is that of a plain walk."""
    from tidemark.operators import alarms as AL
    rnd = random.Random(8)
    rows = [(T0 + dt.timedelta(seconds=i * 7 + rnd.randrange(7) - 9000), "hot", 0, f"m{i}") for i in range(6000)]
    rows += [(T0 + dt.timedelta(seconds=rnd.randrange(42000)), f"k{i % 3}", 0, f"n{i}") for i in range(120)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, alarm_key string, level int, message string")
    last, want = {}, []
    for r in sorted(rows, key=lambda x: (x[1], x[0])):
        if r[1] not in last or r[0] == last[r[1]] or (r[0] - last[r[1]]).total_seconds() >= 100:
            last[r[1]] = r[0]
            want.append(r)
    fired = AL.suppress(df, 100)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "50"}
    before = {c: spark.conf.get(c) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        assert sorted(map(tuple, fired.collect())) == sorted(want)
        tasks = fired.where("alarm_key = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert max(r["count"] for r in tasks) < 0.6 * sum(r["count"] for r in tasks)


def test_ordered_operators_keep_null_keys_and_clashing_names(spark):
    """A null key stays a series of its own slice; columns named like the helpers' own survive; empty frames pass."""
    from pyspark.sql import functions as F

    from tidemark.operators.seqwindow import carry_forward, position, prev_row, running_sums
    rows = [("a", i, f"2024-01-{1 + i:02d} 00:00:00", float(i), "s", "r", "e") for i in range(20)] \
        + [(None, 100 + i, "2024-01-01 00:00:00", 1.0, "s", "r", "e") for i in range(3)]
    df = spark.createDataFrame(rows, "k string, n int, t string, v double, __split string, __row string, __end string") \
        .withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    prev = prev_row(df, "k", "ts", ["v", "k", "n"], tiebreak="n")
    assert prev.columns == [*df.columns, "prev_ts", "prev_v", "prev_k", "prev_n"]
    got = {r["n"]: (r["prev_n"], r["prev_k"], r["__split"], r["__row"], r["__end"]) for r in prev.collect()}
    assert got[0] == (None, None, "s", "r", "e") and got[102][0] == 101 and len(got) == 23
    assert all(got[i] == (i - 1, "a", "s", "r", "e") for i in range(1, 20))
    sums = {r["n"]: (r["upto"], r["pos"], r["total"]) for r in position(
        running_sums(df, "k", "ts", {"upto": F.col("v")}, tiebreak="n"), "k", "ts", tiebreak="n", total_name="total").collect()}
    assert all(sums[i] == (i * (i + 1) / 2, i + 1, 20) for i in range(20)) and sums[102] == (3.0, 3, 3)
    holes = df.withColumn("v", F.when(F.col("n") % 10 == 3, F.col("v")))
    filled = {r["n"]: r["v"] for r in carry_forward(holes, "k", "ts", "v", tiebreak="n").collect()}
    assert [filled[i] for i in (2, 3, 12, 13, 19)] == [None, 3.0, 3.0, 13.0, 13.0]
    for op in (prev_row(df.limit(0), "k", "ts", ["v"]), position(df.limit(0), "k", "ts")):
        assert op.collect() == []


def test_short_series_are_ordered_whole(spark):
    """``split_s=None`` gives what slices give, also for rows without a time and tied rows."""
    rnd = random.Random(5)
    rows = [(f"s{k}", f"t{k % 2}", "m", None if i % 17 == 16 else T0 + dt.timedelta(hours=i), i, rnd.choice([None, *range(9)]))
            for k in range(6) for i in range(10 + 25 * k)]
    df = spark.createDataFrame([(*r[:5], None if r[5] is None else float(r[5])) for r in rows],
                               "entity string, tbl string, metric string, ts timestamp_ntz, n int, value double")
    keys = ["entity", "tbl", "metric"]

    def same(op):
        got, want = (op(x) for x in (None, 7200))
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count()

    same(lambda x: SW.prev_row(df, keys, "ts", ["value", "entity", "n"], tiebreak="n", split_s=x))
    for now in (True, False):
        same(lambda x: SW.running_sums(df, keys, "ts", {"a": F.col("value"), "b": F.lit(1)}, tiebreak="n", include_current=now, split_s=x))
    same(lambda x: SW.position(df, keys, "ts", "p", tiebreak="n", total_name="all", split_s=x))
    timed = df.where(F.col("ts").isNotNull()).drop("n")
    same(lambda x: downsample_minmax(timed, keys, 20, split_s=x))
    same(lambda x: Wn.change_per_second(timed.where("value > 1"), split_s=x))
