"""Stored tiers with late samples, the min/max pyramid, history states across slices."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.downsample import downsample_minmax
from tidemark.operators.history import history
from tidemark.operators.pyramid import minmax_points, pyramid, read_pyramid, write_pyramid
from tidemark.sources import tierstore as TS
from tidemark.sources.store import append_samples

T0 = dt.datetime(2024, 1, 1)
SERIES = "entity string, tbl string, metric string, ts timestamp_ntz, value double"
KEYS = ["entity", "tbl", "metric"]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = [("h1", "a_x", "m", T0 + dt.timedelta(minutes=7 * i), None if i % 11 == 0 else float(r.randint(0, 40))) for i in range(1280)]
    return out + [("h2", "a_x", "m", T0 + dt.timedelta(hours=i), float(i % 5)) for i in range(60)]


def test_pyramid_equals_downsampling_on_aligned_buckets(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SERIES).where(" AND ".join(f"{k} IS NOT NULL" for k in KEYS))
    how = {"base": 4, "factor": 2, "levels": 6}
    path = str(tmp_path / "p")
    write_pyramid(pyramid(df, KEYS, **how), path, KEYS)
    stored = read_pyramid(spark, path)
    points = minmax_points(stored, KEYS, 40, **how)  # 1280 // 40 = 32 = 4 * 2**3
    h1 = F.col("entity") == "h1"
    want = downsample_minmax(df.where(h1), KEYS, 40)
    got = points.where(h1)
    assert sorted(map(tuple, got.drop("level").collect())) == sorted(map(tuple, want.collect()))
    assert {r.level for r in got.collect()} == {3}
    assert points._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 0
    assert sum(r.n for r in stored.where(h1 & (F.col("level") == 5)).collect()) == 1280
    # a range: only points of the range, of a finer level
    part = minmax_points(stored.where(h1), KEYS, 40, start=T0, end=T0 + dt.timedelta(days=2), **how).collect()
    assert part and all(T0 <= r.ts < T0 + dt.timedelta(days=2) and r.level == 1 for r in part)


def test_late_samples_and_reruns_give_the_same_store(spark, rows, tmp_path):
    raw, store, whole = (str(tmp_path / x) for x in ("raw", "store", "whole"))
    df = spark.createDataFrame(rows, SERIES)
    steps, late = (3600, 86400, 7 * 86400), (F.to_date("ts") == "2024-01-03") & (F.col("entity") == "h1")
    append_samples(df.where(~late), raw)
    TS.write_tiers(spark.read.parquet(raw), store, KEYS, 420, steps, 0.01)
    TS.write_tiers(df, whole, KEYS, 420, steps, 0.01)

    def of(path):
        return sorted(map(str, TS.read_tiers(spark, path).select(*KEYS, "step_s", "ts", "value", "known").collect()))

    assert of(store) != of(whole)
    append_samples(df.where(late), raw)
    for _ in range(2):  # a rerun changes nothing
        days = TS.repair_tiers(spark.read.parquet(raw), df.where(late), store, KEYS, 420, steps, 0.01)
        assert of(store) == of(whole)
    assert min(days) == dt.date(2023, 12, 28) and max(days) == dt.date(2024, 1, 4)  # the week's bucket and the day itself
    assert TS.repair_tiers(spark.read.parquet(raw), df.limit(0), store, KEYS, 420, steps, 0.01) == [] and of(store) == of(whole)


def test_expired_folders_go(spark, rows, tmp_path):
    store = str(tmp_path / "s")
    TS.write_tiers(spark.createDataFrame(rows, SERIES), store, KEYS, 420, (3600, 86400), 0.01)
    keep, now = {3600: 48, 86400: 400}, dt.datetime(2024, 1, 6, 12)
    want = sorted(map(str, TS.read_tiers(spark, store, keep, now).collect()))
    gone = TS.expire_tiers(spark, store, keep, now)
    assert gone == [f"step_s=3600/day=2024-01-0{i}" for i in (1, 2, 3)]
    assert sorted(map(str, TS.read_tiers(spark, store, keep, now).collect())) == want
    assert TS.expire_tiers(spark, store, keep, now) == []


@pytest.mark.parametrize("split_s", [600, 3600, 7 * 86400])
def test_history_against_brute_force(spark, rows, split_s):
    half, series = 5400.0, {}
    df = spark.createDataFrame(rows[:150] + rows[1280:], SERIES).where(" AND ".join(f"{k} IS NOT NULL" for k in KEYS))
    got = {(r.entity, r.ts): r for r in history(df, KEYS, "ts", "value", back=(1, 2, 5), half_life_s=half, split_s=split_s).collect()}
    for e, *_, ts, v in rows[:150] + rows[1280:]:
        before = series.setdefault(e, [])
        r, known = got[e, ts], [x for _, x in before if x is not None]
        assert (r.prev_min, r.prev_max) == (min(known, default=None), max(known, default=None))
        for k in (1, 2, 5):
            assert r[f"back_{k}"] == (before[-k][1] if len(before) >= k else None)
        want = sum(x * 2 ** (-(ts - t).total_seconds() / half) for t, x in before if x is not None)
        assert abs(r.decayed_sum - want) < 1e-9 * max(1.0, want)
        before.append((ts, v))
    assert len(got) == 210
