"""Alarms: thresholds on per-second change, predicate rules on raw values,
suppression, quiet hours and the daily heartbeat (batch twins of the
streaming path in :mod:`tidemark.streaming`)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timecols import epoch_us, minute_of_day
from .rules import LambdaRule, key_of, match_first, overlay, rule_heads

DEFAULT_SUPPRESS_S = 21600  # 6 hours
SLICE_WINDOWS = 16          # suppression windows in one slice of a key


# ---------------------------------------------------------------- T4 ------
def threshold_alarms(changes: DataFrame, rules: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Every level whose limit is set (not null, not 0) and exceeded by the
    per-second change fires; one row per level.

    ``changes``: ``entity, tbl, metric, ts, change_per_sec``;
    ``rules``: :func:`rules.abs_rules_frame`; ``tables``: rows that tell all
    (entity, tbl), where they are had for less than the changes.
    """
    limits = rules.where(F.col("limit").isNotNull() & (F.col("limit") != 0))
    # changes that are in no rule above a limit go before keys are joined
    least = limits.groupBy("metric").agg(F.min("limit").alias("__least"))
    c = changes.join(F.broadcast(least), "metric").where(F.col("change_per_sec") > F.col("__least")).drop("__least").withColumn("key", key_of())
    keys = (changes if tables is None else tables).select("entity", "tbl").distinct().select(key_of().alias("key")).distinct()
    chosen = match_first(keys, rule_heads(rules))
    lim = limits.select("rule_ord", "metric", "level", "limit", "limit_text")
    j = c.join(chosen, "key").join(F.broadcast(lim), ["rule_ord", "metric"])
    hit = j.where(F.col("change_per_sec") > F.col("limit"))
    msg = F.format_string("%s: %s changed by %d a second, limit %s", F.col("key"), F.col("metric"),
                          F.col("change_per_sec").cast("bigint"), F.col("limit_text"))
    return hit.select("ts", F.concat_ws("", F.col("key"), F.lit("."), F.col("metric"), F.lit("("),
                                        F.col("level").cast("string"), F.lit(")")).alias("alarm_key"),
                      "level", msg.alias("message"))


# ---------------------------------------------------------------- T5 ------
def predicate_alarms(spark: SparkSession, current: DataFrame, rules: Sequence[LambdaRule],
                     tables: DataFrame | None = None) -> DataFrame:
    """Predicate rules on raw current values.  ``current`` is wide: one row
    per (entity, tbl, ts) sample that also existed in the previous sample,
    with one column per metric.  A failing expression (null) means no alarm.
    ``tables``: as for :func:`threshold_alarms`.
    """
    from ..functions.patterns import glob_to_regex
    heads = spark.createDataFrame(
        [(i, r.pattern, glob_to_regex(r.pattern), glob_to_regex(r.ignore) if r.ignore else None)
         for i, r in enumerate(rules)],
        "rule_ord int, pattern string, regex string, ignore_regex string")
    c = current.withColumn("key", key_of())
    keys = (current if tables is None else tables).select("entity", "tbl").distinct().select(key_of().alias("key")).distinct()
    # one pass: every (rule, level) candidate as an array element, exploded and filtered
    cands, any_hit = [], F.lit(False)
    for i, r in enumerate(rules):
        for lvl, lim in enumerate(r.limits):
            if not lim:
                continue
            pred, msg = r.fn(_Row(), float(lim))
            any_hit = any_hit | F.coalesce(pred, F.lit(False))
            hit = (F.col("rule_ord") == i) & F.coalesce(pred, F.lit(False))
            cands.append(F.when(hit, F.struct(F.lit(f".{r.name}({lvl})").alias("suffix"), F.lit(lvl).alias("level"),
                                              msg.alias("msg"))))
    j = c.where(any_hit).join(match_first(keys, heads), "key")  # samples that no rule would tell of go before keys are joined
    e = j.select("ts", "key", F.explode(F.array(*cands)).alias("a")).where(F.col("a").isNotNull())
    return e.select("ts", F.concat(F.col("key"), F.col("a.suffix")).alias("alarm_key"), F.col("a.level").alias("level"),
                    F.concat(F.col("key"), F.lit(": "), F.col("a.msg")).alias("message"))


class _Row:
    def __getitem__(self, name: str) -> Column:
        return F.col(f"`{name}`")


# ---------------------------------------------------------------- J3 ------
def overlay_alarms(values: DataFrame, entries: DataFrame, key: str = "entity") -> DataFrame:
    """Raw values above the limits that overlaid rules give their key: one row per level.

    Patterns are matched on distinct keys; the limits join the values on (key, metric).
    """
    limits = overlay(values.select(F.col(key).alias("key")).distinct(), entries)
    limits = limits.where(F.col("limit").isNotNull() & (F.col("limit") != 0)).withColumnRenamed("key", key)
    hit = values.join(limits, [key, "metric"]).where(F.col("value") > F.col("limit"))
    name = F.concat(F.col(key), F.lit(":"), F.substring_index("tbl", "_", -1), F.lit("."), F.col("metric"), F.lit("("), F.col("level").cast("string"), F.lit(")"))
    return hit.select("ts", name.alias("alarm_key"), "level",
                      F.format_string("%s: %s is %.2f, limit %.2f", F.col(key), F.col("metric"), F.col("value"), F.col("limit")).alias("message"))


# ---------------------------------------------------------------- T6 ------
def _coded(b: pa.RecordBatch, names: Sequence) -> tuple:
    """The distinct keys of a batch's first column, and arrays: its codes and the other columns."""
    key, *rest = (b.column(i if isinstance(i, int) else b.schema.get_field_index(i)) for i in names)
    keys = key.dictionary_encode()
    return keys.dictionary, keys.indices.to_numpy(zero_copy_only=False), *(c.to_numpy(zero_copy_only=False) for c in rest)


def _cuts(code: np.ndarray, piece: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal key and piece begin and end; ``more``: rows that begin a run, too."""
    new = np.r_[True, (code[1:] != code[:-1]) | (piece[1:] != piece[:-1])]
    at = np.flatnonzero(new if more is None else new | more)
    return at, np.r_[at[1:], len(code)]


def suppress(alarms: DataFrame, window_s: int = DEFAULT_SUPPRESS_S, key: str = "alarm_key") -> DataFrame:
    """Keep an alarm only if at least ``window_s`` passed since the last
    *fired* alarm of the same key (greedy, exact); alarms of a fired moment
    stay together.

    A key's alarms are cut into slices of ``SLICE_WINDOWS`` windows, so that no
    task has all alarms of a key.  Where a slice ends depends only on which of
    its moments fires first, and that is one of its first window or the one
    after: each slice makes a table of (first fired, last fired), a walk over
    these tables gives the last fired moment before every slice, and then each
    slice is walked on its own, by binary searches.
    """
    w_us = int(window_s) * 1_000_000
    if w_us <= 0:  # every alarm fires
        return alarms
    span = SLICE_WINDOWS * w_us

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None

        def table() -> pa.RecordBatch:
            us = np.unique(np.concatenate(held))
            n = len(us)
            to = np.append(np.searchsorted(us, us + w_us), n)  # the moment that fires next; n: none
            end = np.arange(n)
            while (on := to[end] < n).any():  # a slice has few windows
                end = np.where(on, to[end], end)
            first = min(n, int(np.searchsorted(us, now[1] * span + w_us)) + 1)
            keep = np.append(end[1:first] != end[:first - 1], True)  # of equal ends the greatest first
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * int(keep.sum()), pa.string()), pa.array(np.full(keep.sum(), now[1])),
                                               pa.array(us[:first][keep]), pa.array(us[end[:first][keep]])], ["key", "slice", "first", "last"])

        for b in batches:
            if not b.num_rows:
                continue
            keys, code, piece, us = _coded(b, ("__key", "__slice", "__us"))
            at, to = _cuts(code, piece)
            # slices of one moment, as most of a sparse key, at once; those at a batch's edges may go on in the next
            one = us[at] == us[to - 1]
            one[0] = one[-1] = False
            if one.any():
                alone = pa.array(us[at[one]])
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(code[at[one]])).cast(pa.string()), pa.array(piece[at[one]]), alone, alone],
                                                 ["key", "slice", "first", "last"])
            for a, z in zip(at[~one].tolist(), to[~one].tolist(), strict=True):
                if (here := (keys[int(code[a])].as_py(), int(piece[a]))) != now:
                    if held:
                        yield table()
                    now, held = here, []
                held.append(us[a:z])
        if held:
            yield table()

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, known, most = (None, None), None, False, None
        for b in batches:
            if not b.num_rows:
                continue
            keys, code, piece, first, end = _coded(b, range(4))
            at, to = _cuts(code, piece)
            start, same = (keys[int(code[0])].as_py(), int(piece[0])), np.r_[False, code[at[1:]] == code[at[:-1]]]
            ends_at = np.maximum.reduceat(end, at)
            if start == now:
                ends_at[0] = max(ends_at[0], most)
            # a slice whose first moment is a window after all that may have fired before goes on from its first row
            sure = ~same
            sure[1:] |= first[at[1:]] >= ends_at[:-1] + w_us
            sure[0] = False
            out, known_now = end[at].copy(), True
            names, pieces, marks = [], [], []
            for i in np.flatnonzero(~sure).tolist():
                before, known_now = int(out[i - 1]), False
                if i == 0:
                    before = last if start[0] == now[0] else None
                    known_now = known and start == now
                    if start != now and before is not None:
                        names, pieces, marks = [start[0]], [start[1]], [before]
                if not known_now:
                    k = 0 if before is None else int(np.searchsorted(first[at[i]:to[i]], before + w_us))
                    if k < to[i] - at[i]:
                        before, known_now = end[at[i] + k], True
                out[i] = before
            known_now = known_now or bool(sure[-1])
            now, last, known, most = (keys[int(code[-1])].as_py(), int(piece[-1])), int(out[-1]), known_now, int(ends_at[-1])
            on = np.flatnonzero(same)
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(pieces, pa.int64()), pa.array(marks, pa.int64())], ["key", "slice", "us"])
            if len(on):
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(code[at[on]])).cast(pa.string()), pa.array(piece[at[on]]), pa.array(out[on - 1])],
                                                 ["key", "slice", "us"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys, code, piece, us, real = _coded(b, ("__key", "__slice", "__us", "__real"))
            # a moment that is a window after the one before fires whatever fired before: only what lies between is walked
            free = np.r_[False, real[1:] & (us[1:] - us[:-1] >= w_us)]
            cuts, to = _cuts(code, piece, free)
            one = real[cuts] & (us[cuts] == us[to - 1])
            one[0] = False
            keep = np.repeat(one, to - cuts)
            start = (keys[int(code[0])].as_py(), int(piece[0]))
            for i in np.flatnonzero(~one).tolist():
                if i or start != now:
                    last = None
                at, stop = int(cuts[i]), int(to[i])
                while at < stop:
                    if not real[at]:  # the last fired moment before the slice
                        last = us[at]
                        at += 1
                        continue
                    if last is not None and us[at] != last and us[at] < last + w_us:
                        at += int(np.searchsorted(us[at:stop], last + w_us))
                        continue
                    last = us[at]
                    same = at + int(np.searchsorted(us[at:stop], last, "right"))
                    keep[at:same] = True
                    at = same
            now = (keys[int(code[-1])].as_py(), int(piece[-1]))
            if one[-1]:
                last = us[-1]
            yield b.filter(pa.array(keep)).drop_columns(["__key", "__slice", "__us", "__real"])

    timed = alarms.withColumn("__key", F.col(key).cast("string")).withColumn("__us", epoch_us("ts")) \
        .withColumn("__slice", F.expr(f"(__us - pmod(__us, {span}L)) div {span}L")).withColumn("__real", F.lit(True))
    dealt = timed.repartition("__key", "__slice")
    # whole alarms on both ways, or Spark would see two different shuffles
    tables = dealt.sortWithinPartitions("__key", "__slice", "__us").mapInArrow(ends, "key string, slice long, first long, last long")
    before = tables.repartition("key").sortWithinPartitions("key", "slice", "first").mapInArrow(entries, "key string, slice long, us long")
    marks = before.select(F.col("key").alias("__key"), F.col("slice").alias("__slice"), F.col("us").alias("__us"), F.lit(False).alias("__real"))
    rows = dealt.unionByName(marks, allowMissingColumns=True).repartition("__key", "__slice")
    return rows.sortWithinPartitions("__key", "__slice", "__real", "__us").mapInArrow(walk, alarms.schema)


# ---------------------------------------------------------------- T7 ------
def quiet_hours(alarms: DataFrame, start_hhmm: str, end_hhmm: str) -> DataFrame:
    """Drop alarms whose minute of day is inside the block window (both ends
    exclusive; the window may cross midnight)."""
    sh, sm_ = (int(x) for x in start_hhmm.split(":"))
    eh, em_ = (int(x) for x in end_hhmm.split(":"))
    s, e = sh * 60 + sm_, eh * 60 + em_
    cm = minute_of_day("ts")
    blocked = ((cm > s) & (cm < e)) if e > s else ((cm > s) | (cm < e))
    return alarms.where(~blocked)


# ---------------------------------------------------------------- T8 ------
def daily_heartbeat(samples: DataFrame, hhmm: str = "12:00", gap_s: int = 120) -> DataFrame:
    """One health event per day: the first sample arriving in minute HH:MM
    (later ones in the same minute fall inside the 2-minute guard)."""
    h, m = (int(x) for x in hhmm.split(":"))
    hit = samples.where((F.hour("ts") == h) & (F.minute("ts") == m))
    day = F.to_date("ts")
    del gap_s  # a one-minute window can never hold two events 120 s apart
    return hit.groupBy(day.cast("string").alias("day")).agg(F.min("ts").alias("ts")) \
        .withColumn("message", F.lit(f"alarm health check ({hhmm})"))
