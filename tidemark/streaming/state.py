"""Keyed streaming state (``transformWithState``, RocksDB).

Rows may come in any number of files and micro-batches, split anywhere and up
to the watermark late: an operator keeps a key's open rows in a list state and
works on them, in time order, when an event-time timer tells that the watermark
has passed them.  Rows later than the watermark are dropped by Spark; a moment
that was already worked on is not worked on again.  So results depend on the
rows and the watermark only, not on how rows fall into micro-batches, and are
those of the batch twins in :mod:`tidemark.operators`.

Beside the open rows, every operator has typed state of its own:

* change per second: of a client, the previous sample (a map of table and
  metric to value, and its time);
* suppression: of an alarm key, the last fired time;
* membership: of a cluster, the number of the last snapshot and its members;
* counter rate: of a series, the previous point;
* absence: of a client, its last time and whether it is down;
* samples: of a client, the time and the tables of its previous sample.

``idle`` (None: never) forgets a key of which no row came for so long.  It is a
rule between any two neighbouring moments of a key, in one micro-batch or in
two; a timer frees the state of a key that never comes back.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.timecols import epoch_us
from ..operators.alarms import DEFAULT_SUPPRESS_S
from .ingest import to_instant

DELAY = "10 seconds"
EPOCH = dt.datetime(1970, 1, 1)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession, evolving: bool = False) -> None:
    """State with timers needs the RocksDB store.  ``evolving``: queries started from now on code their
    state as Avro, so that it may gain columns between two runs (windows and dedup cannot be coded so)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    spark.conf.set("spark.sql.streaming.stateStore.encodingFormat", "avro" if evolving else "unsaferow")


def microseconds(span: str | None) -> int | None:
    return None if span is None else int(pd.Timedelta(span).total_seconds() * 1_000_000)


def moment(us: int) -> dt.datetime:
    return EPOCH + dt.timedelta(microseconds=us)


def whole_seconds(us: int) -> int:
    """Whole seconds of a difference, toward zero."""
    return us // 1_000_000 if us >= 0 else -(-us // 1_000_000)


class Ordered(StatefulProcessor):
    """Works on a key's rows in time order.  ``columns``: DDL of a row's columns after ``us``.

    A subclass declares its state in ``declare``, drops it in ``forget`` and yields result rows from
    ``work(key, rows)``; rows are tuples (us, *columns) of moments that are complete.  ``deadline()``
    is a time at which ``overdue(key, us)`` is asked, should no row come before.
    """

    columns = ""

    def __init__(self, idle_us: int | None = None):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", f"us long, {self.columns}")
        self.seen = handle.getValueState("seen", "us long")
        self.declare(handle)

    def declare(self, handle: StatefulProcessorHandle) -> None:
        pass

    def forget(self) -> None:
        pass

    def work(self, key, rows: list[tuple]) -> Iterator[Row]:
        raise NotImplementedError

    def deadline(self) -> int | None:
        return None

    def overdue(self, key, us: int) -> Iterator[Row]:
        return iter(())

    def _last(self) -> int | None:
        got = self.seen.get()
        return None if got is None else got[0]

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def apart(self, before: int | None, now: int) -> bool:
        """Whether what was before is forgotten at ``now``."""
        return before is not None and self.idle_us is not None and now - before > self.idle_us

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen = self._last()
        width = 2 + self.columns.count(",")  # what follows in a row: the key and the event time
        new = [tuple(r)[:width] for r in rows if seen is None or r[0] > seen]
        if new:
            self.open.appendList(new)
            self._wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        ready = sorted({r for r in rows if r[0] < mark}, key=lambda r: (r[0], repr(r)))
        rest = [r for r in rows if r[0] >= mark]
        if ready:
            if self.apart(self._last(), ready[0][0]):
                self.forget()
            yield from self.work(key, ready)
            self.seen.update((ready[-1][0],))
            if rest:
                self.open.put(rest)
                self._wake(min(r[0] for r in rest))
            else:
                self.open.clear()
        due = self.deadline()
        if due is not None and due < mark:
            yield from self.overdue(key, due)
        elif due is not None and ready:
            self._wake(due)
        last = self._last()
        if last is not None and self.idle_us is not None:
            if not rest and last + self.idle_us < mark:
                self.forget()
                self.seen.clear()
            elif ready:
                self._wake(last + self.idle_us)

    def close(self) -> None:
        pass


def moments(rows: list[tuple]) -> Iterator[tuple[int, list[tuple]]]:
    """Sorted rows by moment."""
    a = 0
    while a < len(rows):
        z = a
        while z < len(rows) and rows[z][0] == rows[a][0]:
            z += 1
        yield rows[a][0], rows[a:z]
        a = z


def stateful(stream: DataFrame, keys: list[str], columns: list[str], processor: Ordered, schema: str, delay: str, ts: str = "ts") -> DataFrame:
    """``processor`` over the rows (us, *columns) of each key."""
    if stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STORE:
        use_rocksdb(stream.sparkSession)
    rows = stream.select(epoch_us(ts).alias("us"), *columns, *keys, to_instant(ts).alias("__time")).withWatermark("__time", delay)
    return rows.groupBy(*keys).transformWithState(processor, schema, "append", "eventTime")


# ---------------------------------------------------------------- T3 ------
CHANGE_SCHEMA = ("entity string, tbl string, metric string, ts timestamp_ntz, prev_ts timestamp_ntz, "
                 "diff_sec bigint, change_per_sec double")


class Changes(Ordered):
    columns = "tbl string, metric string, value double"

    def declare(self, handle) -> None:
        self.values = handle.getMapState("values", "tbl string, metric string", "value double")
        self.time = handle.getValueState("time", "us long")

    def forget(self) -> None:
        self.values.clear()
        self.time.clear()

    def work(self, key, rows):
        (entity,) = key
        at = self.time.get()
        before = {tuple(k): v[0] for k, v in self.values.iterator()} if at else {}
        before_us = at[0] if at else None
        for us, sample in moments(rows):
            now = {(tbl, metric): value for _, tbl, metric, value in sample}
            if self.apart(before_us, us):
                before, before_us = {}, None
            gap = 0 if before_us is None else whole_seconds(us - before_us)
            if gap:
                for (tbl, metric), value in now.items():
                    if (tbl, metric) in before:
                        old = before[tbl, metric]
                        change = None if value is None or old is None else (value - old) / gap
                        yield Row(entity=entity, tbl=tbl, metric=metric, ts=moment(us), prev_ts=moment(before_us), diff_sec=gap, change_per_sec=change)
            before, before_us = now, us
        self.values.clear()
        for k, value in before.items():
            self.values.updateValue(k, (value,))
        self.time.update((before_us,))


def change_per_second(stream: DataFrame, delay: str = DELAY, idle: str | None = None) -> DataFrame:
    """Current vs previous sample per client (entity): for each
    (tbl, metric) in both samples, ``(v - v_prev) / whole seconds``; samples
    with a zero whole-second gap are skipped but still become the previous
    sample."""
    return stateful(stream, ["entity"], ["tbl", "metric", "value"], Changes(microseconds(idle)), CHANGE_SCHEMA, delay)


# ---------------------------------------------------------------- T6 ------
ALARM_SCHEMA = "ts timestamp_ntz, alarm_key string, level int, message string"


class Suppression(Ordered):
    columns = "level int, message string"

    def __init__(self, window_us: int, idle_us: int | None):
        super().__init__(idle_us)
        self.window_us = window_us

    def declare(self, handle) -> None:
        self.fired = handle.getValueState("fired", "us long")

    def forget(self) -> None:
        self.fired.clear()

    def work(self, key, rows):
        (name,) = key
        got = self.fired.get()
        last = got[0] if got else None
        for us, alarms in moments(rows):
            if last is None or us >= last + self.window_us:
                last = us
                for _, level, text in alarms:
                    yield Row(ts=moment(us), alarm_key=name, level=level, message=text)
        self.fired.update((last,))


def suppress(alarms: DataFrame, window_s: int = DEFAULT_SUPPRESS_S, delay: str = DELAY, idle: str | None = None) -> DataFrame:
    """Fire an alarm only if ``window_s`` passed since the key's last fired one; alarms of a fired moment
    stay together.  A key is forgotten after two windows without alarms, which changes no result."""
    idle_us = max(microseconds(idle) or 0, 2 * int(window_s) * 1_000_000)
    return stateful(alarms, ["alarm_key"], ["level", "message"], Suppression(int(window_s) * 1_000_000, idle_us), ALARM_SCHEMA, delay)


# ---------------------------------------------------------------- T9 ------
MEMBER_SCHEMA = "grp string, snap int, member string, change string"


class Membership(Ordered):
    columns = "snap int, member string"

    def declare(self, handle) -> None:
        self.snap = handle.getValueState("snap", "snap int")
        self.members = handle.getListState("members", "member string")

    def forget(self) -> None:
        self.snap.clear()
        self.members.clear()

    def work(self, key, rows):
        (grp,) = key
        got = self.snap.get()
        last = got[0] if got else None
        before = {m for (m,) in self.members.get()} if got and self.members.exists() else set()
        for _, snapshot in moments(rows):
            for snap in sorted({r[1] for r in snapshot}):
                now = {r[2] for r in snapshot if r[1] == snap}
                if last is not None and snap == last + 1:
                    for change, members in (("up", now - before), ("down", before - now)):
                        for m in sorted(members):
                            yield Row(grp=grp, snap=snap, member=m, change=change)
                last, before = snap, now
        self.snap.update((last,))
        self.members.put([(m,) for m in sorted(before)])


def membership_changes(snapshots: DataFrame, delay: str = DELAY, idle: str | None = None) -> DataFrame:
    """``(grp, snap, ts, member)`` snapshots -> up / down events between
    consecutive snapshots of each group; all rows of a snapshot have its ``ts``."""
    return stateful(snapshots, ["grp"], ["snap", "member"], Membership(microseconds(idle)), MEMBER_SCHEMA, delay)


# ---------------------------------------------------------------- W3 ------
RATE_SCHEMA = "entity string, tbl string, metric string, ts timestamp_ntz, value double, rate double"


class Rates(Ordered):
    columns = "value double"

    def __init__(self, heartbeat_s: float, min_v: float | None, max_v: float | None, idle_us: int | None):
        super().__init__(idle_us)
        self.heartbeat_s, self.min_v, self.max_v = heartbeat_s, min_v, max_v

    def declare(self, handle) -> None:
        self.point = handle.getValueState("point", "us long, value double")

    def forget(self) -> None:
        self.point.clear()

    def rate(self, seconds: float, delta: float) -> float | None:
        if not 0 < seconds <= self.heartbeat_s:
            return None
        r = delta / seconds
        low = self.min_v is not None and r < self.min_v
        return None if low or (self.max_v is not None and r > self.max_v) else r

    def work(self, key, rows):
        entity, tbl, metric = key
        got = self.point.get()
        before_us, before = got if got else (None, None)
        for us, value in rows:
            known = before_us is not None and before is not None and value is not None
            rate = self.rate((us - before_us) / 1e6, value - before) if known else None
            yield Row(entity=entity, tbl=tbl, metric=metric, ts=moment(us), value=value, rate=rate)
            before_us, before = us, value
        self.point.update((before_us, before))


def counter_rate(stream: DataFrame, heartbeat_s: float, min_v: float | None = 0.0,
                 max_v: float | None = None, delay: str = DELAY) -> DataFrame:
    """DERIVE rates on a stream: per series the previous (ts, value) is kept
    as state; ``dv / dt`` is null without a predecessor, when ``dt`` exceeds
    the heartbeat or is 0, or when it leaves ``[min_v, max_v]``.  A point is
    forgotten when its heartbeat is over, which changes no result."""
    idle = int(heartbeat_s * 1_000_000) + 1_000_000
    return stateful(stream, ["entity", "tbl", "metric"], ["value"], Rates(heartbeat_s, min_v, max_v, idle), RATE_SCHEMA, delay)


# ------------------------------------------------------------- T8, T9 -----
ABSENCE_SCHEMA = "entity string, ts timestamp_ntz, change string, silent_s double"


class Absence(Ordered):
    columns = "one int"

    def __init__(self, gap_us: int):
        super().__init__(None)
        self.gap_us = gap_us

    def declare(self, handle) -> None:
        self.state = handle.getValueState("state", "us long, down boolean")

    def deadline(self) -> int | None:
        got = self.state.get()
        return None if got is None or got[1] else got[0] + self.gap_us

    def down(self, entity: str, last: int) -> Row:
        return Row(entity=entity, ts=moment(last + self.gap_us), change="down", silent_s=self.gap_us / 1e6)

    def overdue(self, key, us):
        last = self.state.get()[0]
        self.state.update((last, True))
        yield self.down(key[0], last)

    def work(self, key, rows):
        got = self.state.get()
        last, down = got if got else (None, False)
        for us, _ in moments(rows):
            if last is not None and us - last > self.gap_us:
                if not down:
                    yield self.down(key[0], last)
                yield Row(entity=key[0], ts=moment(us), change="up", silent_s=(us - last) / 1e6)
            last, down = us, False
        self.state.update((last, down))


def absences(stream: DataFrame, gap: str, delay: str = DELAY) -> DataFrame:
    """A client is ``down`` when nothing came for ``gap`` (told at that time by a timer, though no row
    comes), and ``up`` with its next row; twin: :func:`tidemark.operators.absence.absences`."""
    return stateful(stream.withColumn("one", F.lit(1)), ["entity"], ["one"], Absence(microseconds(gap)), ABSENCE_SCHEMA, delay)


# ---------------------------------------------------------------- T5 ------
SAMPLE_SCHEMA = "entity string, tbl string, ts timestamp_ntz, prev_ts timestamp_ntz, metrics map<string,double>"


class Samples(Ordered):
    columns = "tbl string, metric string, value double"

    def declare(self, handle) -> None:
        self.time = handle.getValueState("time", "us long")
        self.tables = handle.getListState("tables", "tbl string")

    def forget(self) -> None:
        self.time.clear()
        self.tables.clear()

    def work(self, key, rows):
        (entity,) = key
        got = self.time.get()
        last = got[0] if got else None
        before = {t for (t,) in self.tables.get()} if got and self.tables.exists() else set()
        for us, sample in moments(rows):
            if self.apart(last, us):
                before = set()
            now: dict[str, dict] = {}
            for _, tbl, metric, value in sample:
                now.setdefault(tbl, {})[metric] = value
            for tbl in sorted(before & now.keys()):
                yield Row(entity=entity, tbl=tbl, ts=moment(us), prev_ts=moment(last), metrics=now[tbl])
            last, before = us, set(now)
        self.time.update((last,))
        self.tables.put([(t,) for t in sorted(before)])


def samples(stream: DataFrame, delay: str = DELAY, idle: str | None = None) -> DataFrame:
    """Long rows -> whole samples: one row for each table of a client's sample that was in the
    client's sample before too, with all its metrics, wherever its rows came from."""
    return stateful(stream, ["entity"], ["tbl", "metric", "value"], Samples(microseconds(idle)), SAMPLE_SCHEMA, delay)
