"""Typed streaming state: results do not depend on how rows fall into files and micro-batches, and survive a restart."""

import datetime as dt
import os
import sys
import tempfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql import functions as F

from tests.test_streaming import FAR, LONG, _changes, _collect, _flush, _split_late_and_flush, _src
from tidemark.operators import absence as AB
from tidemark.operators import aggregate as A
from tidemark.operators import alarms as AL
from tidemark.operators import windows as Wn
from tidemark.plans import q_alarms
from tidemark.sources import testdata as T
from tidemark.streaming import alerting as AS
from tidemark.streaming import ingest as I
from tidemark.streaming import state as ST

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests
KEYS = ["entity", "tbl", "metric"]


@pytest.fixture(scope="module")
def scratch():
    return tempfile.mkdtemp(prefix="tidemark-state-", dir="/tmp")


def _cut(df, path, n, flush=LONG):
    """``n`` files of equal numbers of rows, in time order; a moment may stand in two files."""
    rows = df.orderBy("ts").collect()
    for i in range(n):
        part = rows[i * len(rows) // n:(i + 1) * len(rows) // n]
        df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.parquet(os.path.join(path, f"f{i:02d}"))
    _flush(df, path, flush)


@pytest.fixture(scope="module")
def counters(spark, sf):
    """Counter samples of some clients, read once."""
    rows = T.counter_long(spark, sf).drop("seq").where("entity like 'host-1%'").collect()
    return spark.createDataFrame(rows, I.LONG_SCHEMA)


@pytest.mark.parametrize("idle", [None, "12 hours"])
def test_changes_do_not_depend_on_micro_batches(spark, scratch, counters, idle):
    want = _changes(Wn.change_per_second(counters).collect())
    if idle:  # what is longer ago than idle is no previous sample, in one batch or in two
        want = {k: v for k, v in want.items() if v[0] <= 12 * 3600}
    assert want
    for n in (1, 2, 4, 16):
        path = os.path.join(scratch, f"cuts-{idle}-{n}")
        _cut(counters, path, n)
        got = _changes(_collect(ST.change_per_second(_src(spark, path, I.LONG_SCHEMA), idle=idle), scratch, f"cuts-{idle}-{n}"))
        assert got.keys() == want.keys(), n
        assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_state_survives_a_restart(spark, scratch, counters):
    """The second run of a query goes on from the checkpoint of the first."""
    path, out = os.path.join(scratch, "restart"), []
    days = ["2024-01-01", "2024-01-12", "2024-02-01"]
    for i, (a, z) in enumerate(zip(days, days[1:])):
        part = counters.where((F.col("ts") >= F.lit(a).cast("timestamp_ntz")) & (F.col("ts") < F.lit(z).cast("timestamp_ntz")))
        part.coalesce(1).write.parquet(os.path.join(path, f"f{i}"))
        if i:
            _flush(counters, path, LONG)
        out += _collect(ST.change_per_second(_src(spark, path, I.LONG_SCHEMA)), scratch, "restart")
    want = _changes(Wn.change_per_second(counters.where("ts < timestamp_ntz'2024-02-01'")).collect())
    got = _changes(out)
    assert got.keys() == want.keys() and got


class _CountingAbsence(ST.Absence):
    """The next version of a processor: its state has one more column."""

    def declare(self, handle):
        self.state = handle.getValueState("state", "us long, down boolean, times int")

    def deadline(self):
        got = self.state.get()
        return None if got is None or got[1] else got[0] + self.gap_us

    def work(self, key, rows):
        got = self.state.get()
        old = None if got is None else got[2]
        last = rows[-1][0]
        self.state.update((last, False, (old or 0) + len(rows)))
        yield Row(entity=key[0], ts=ST.moment(last), change="seen" if old is None else "counted", silent_s=float(got[0] if got else -1))

    def overdue(self, key, us):
        return iter(())


@pytest.fixture
def evolving(spark):
    ST.use_rocksdb(spark, evolving=True)
    yield
    ST.use_rocksdb(spark)


def test_state_gains_a_column(spark, scratch, evolving):
    t = dt.datetime(2024, 1, 1)
    path = os.path.join(scratch, "evolve")
    schema = "entity string, ts timestamp_ntz, one int"

    def write(i, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(path, f"f{i}"))

    write(0, [("a", t, 1), ("b", t + dt.timedelta(hours=3), 1)])
    src = _src(spark, path, schema)
    _collect(ST.absences(src, "1 day"), scratch, "evolve")
    write(1, [("a", t + dt.timedelta(hours=2, minutes=59), 1), ("b", t + dt.timedelta(hours=9), 1)])
    later = ST.stateful(src, ["entity"], ["one"], _CountingAbsence(86400 * 10**6), ST.ABSENCE_SCHEMA, "2 hours")
    write(2, [("zz", FAR, 1)])
    got = {(r.entity, r.change) for r in _collect(later, scratch, "evolve")}
    assert ("b", "seen") in got  # the state of the first run is read, its new column is null


@pytest.mark.parametrize("how", ["ordered", "split"])
def test_absence_fires_when_nothing_comes(spark, sf, scratch, how):
    src = T.gauge_long(spark, sf).select("entity", "ts")
    path, flush = os.path.join(scratch, "absence-" + how), ("zz", FAR)
    if how == "ordered":
        _cut(src, path, 5, flush)
    else:
        _split_late_and_flush(src, path, flush)
    stream = ST.absences(_src(spark, path, "entity string, ts timestamp_ntz"), "1 day", delay="10 seconds" if how == "ordered" else "3650 days")
    got = {(r.entity, r.ts, r.change, r.silent_s) for r in _collect(stream, scratch, "absence-" + how) if r.entity != "zz"}
    assert got == {tuple(r) for r in AB.absences(src, 86400, "2080-01-01").collect()} and got


def test_absence_against_a_walk(spark):
    t = dt.datetime(2024, 1, 1)
    hours = {"a": [0, 1, 5, 5, 30], "b": [2], "c": [0, 3, 6, 9]}
    df = spark.createDataFrame([(e, t + dt.timedelta(hours=h)) for e, hs in hours.items() for h in hs], "entity string, ts timestamp_ntz")
    got = {(r.entity, (r.ts - t).total_seconds() / 3600, r.change, r.silent_s) for r in AB.absences(df, 3 * 3600, t + dt.timedelta(hours=12), split_s=7200).collect()}
    assert got == {("a", 4.0, "down", 10800.0), ("a", 5.0, "up", 14400.0), ("a", 8.0, "down", 10800.0), ("a", 30.0, "up", 90000.0), ("b", 5.0, "down", 10800.0)}
    assert AB.absences(df.where("false"), 60, t).count() == 0


@pytest.mark.parametrize("what", ["predicates", "overlay"])
def test_rules_on_values_of_a_stream(spark, sf, scratch, what):
    """Samples whose rows come in several files meet the rules as in the batch query."""
    net = T.net_long(spark, sf).where("entity in ('server-1', 'server-5')")
    path, out = os.path.join(scratch, "rules-" + what), os.path.join(scratch, "alarms-" + what)
    _split_late_and_flush(net, path, ("zz", "net_R", "cmd_get", FAR, 1.0))
    src = _src(spark, path, I.LONG_SCHEMA)
    if what == "predicates":
        q = AS.detect_predicates(src, q_alarms.LAMBDA_RULES, ["get_hits", "cmd_get"], out, scratch, delay="20000 days", available_now=True)
    else:
        q = AS.detect_overlay(src, q_alarms.overlay_entries(spark), out, scratch, delay="20000 days", available_now=True)
    q.awaitTermination()
    samples = {}
    for r in net.collect():
        samples.setdefault((r.entity, r.ts), {}).setdefault(r.tbl, {})[r.metric] = r.value
    times = sorted(samples)
    rows = [(e, tbl, ts, m, v) for (pe, pts), (e, ts) in zip(times, times[1:]) if pe == e
            for tbl, ms in samples[e, ts].items() if tbl in samples[pe, pts] for m, v in ms.items()]
    held = spark.createDataFrame(rows, "entity string, tbl string, ts timestamp_ntz, metric string, value double")
    if what == "predicates":
        want = AL.predicate_alarms(spark, held.groupBy("entity", "tbl", "ts").pivot("metric", ["get_hits", "cmd_get"]).agg(F.first("value")), q_alarms.LAMBDA_RULES)
    else:
        want = AL.overlay_alarms(held, q_alarms.overlay_entries(spark))
    got = {tuple(r) for r in spark.read.parquet(out).select("ts", "alarm_key", "level", "message").collect()}
    assert got == {tuple(r) for r in want.collect()} and got


def test_chained_tiers_of_a_stream(spark, sf, scratch):
    net = T.net_long(spark, sf).where("metric = 'cmd_get' and entity in ('server-1', 'server-2')")
    path = os.path.join(scratch, "tiers")
    _cut(net, path, 3)
    day, tiers = 86400, (7 * 86400, 28 * 86400, 84 * 86400)
    levels = I.chained_tiers(_src(spark, path, I.LONG_SCHEMA), day, tiers, delay="10 seconds", xff=0.1)
    batch = A.chained_tiers(net, KEYS, day, tiers, xff=0.1).collect()
    for step, level in zip(tiers, levels):
        got = {(r.entity, r.tbl, r.ts): (r.value, r.known) for r in _collect(level, scratch, f"tiers-{step}") if r.entity != "zz"}
        assert got == {(r.entity, r.tbl, r.ts): (r.value, r.known) for r in batch if r.step_s == step} and got
    with pytest.raises(ValueError):
        I.chained_tiers(net, day, (60, 100))
