"""Operator 10, mixing sources to target weights: cube-method balanced sampling.

Each source's target is a multiple of its size.  A document is taken the whole
part of that multiple for certain, and once more with the fractional part as
inclusion probability.  The cube method decides the fractions: probabilities
move along the null space of the balancing constraints (documents and words),
so that both totals stay exact until a constraint's worth of undecided units
is left.  It runs in blocks of one source; what blocks leave undecided is
dealt into fewer blocks, until one block a source is left.  About a quarter of a
block of each source, chosen by hash, waits for that block, as large texts stay
undecided longest and only smaller ones can make up for them.  There the last
two units land on whole numbers, and a few units of the block change places (one
taken for one left, or one more or less) while that brings the words nearer to
the target.

Defined cases: null text or no word: size 0, taken 0; null source: a source of
its own, ordered last; equal rows count as separate units; empty table: no rows.
Nothing depends on partitions or on row order, so reruns agree.
"""

from __future__ import annotations

import bisect
import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, record, saved, sorted_groups

WEIGHTS = (5.0, 2.0, 1.0)
#: No source's target exceeds so many times its size.
MOST = 3.0
#: Undecided units in one block of a flight.
BLOCK = 4096
EPS = 1e-9


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, m (rows), target from (source, size, n).  Shares by weight; those above
    ``most`` times their size stop there and the excess is shared again."""
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum("n").alias("m"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(nth, F.lit(len(weights))) + 1).cast("int"))
    per = saved(per.withColumn("weight", weight), "sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:  # one pass over the sources for each time that the set of stopped sources grows
        over = F.col("weight") * F.lit(level) >= F.col("source_size") * F.lit(most) if stopped >= 0 else F.lit(False)
        n, held, rest = per.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("source_size") * most)), F.lit(0.0)),
                                F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if n == stopped or rest <= 0:
            break
        stopped, level = n, max(0.0, total - held) / rest
    target = F.least(F.col("weight") * F.lit(level), F.col("source_size") * F.lit(most))
    return per.select("source", "source_size", "m", (target if rest > 0 else F.col("source_size") * F.lit(most)).alias("target"))


def flight(p: list[float], x: list[float], rng: random.Random) -> list[int]:
    """Moves ``p`` in place, keeping sum(p) and sum(p * x), until two units or fewer
    are undecided; returns their places."""
    held: list[int] = []
    for nxt in range(len(p)):
        if EPS < p[nxt] < 1 - EPS:
            held.append(nxt)
        while len(held) == 3:
            a, b, c = held
            u, v, w = x[b] - x[c], x[c] - x[a], x[a] - x[b]  # orthogonal to (1,1,1) and to the sizes
            if u == 0 and v == 0 and w == 0:
                u, v, w = 1.0, -1.0, 0.0
            up = down = math.inf
            for i, d in ((a, u), (b, v), (c, w)):
                if d > 0:
                    up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
                elif d < 0:
                    up, down = min(up, p[i] / -d), min(down, (1 - p[i]) / -d)
            step = up if rng.random() * (up + down) < down else -down
            for i, d in ((a, u), (b, v), (c, w)):
                p[i] += step * d
                if p[i] < EPS or p[i] > 1 - EPS:
                    p[i] = float(round(p[i]))
            held = [i for i in held if EPS < p[i] < 1 - EPS]
    return held


def landing(p: list[float], x: list[float], held: list[int]) -> None:
    """The one or two undecided units of a source: the choice that leaves the words nearest."""
    want = sum(p[i] * x[i] for i in held)
    best = min(range(1 << len(held)), key=lambda m: (abs(sum(x[i] for j, i in enumerate(held) if m >> j & 1) - want), m))
    for j, i in enumerate(held):
        p[i] = float(best >> j & 1)


def settle(p: list[float], x: list[int], want: float) -> None:
    """Changes decided units in place while the words taken come nearer to ``want``:
    of all exchanges of one taken unit for one left, and of all single changes,
    the one that comes nearest, exchanges first, as they keep the number of documents."""
    over = sum(x[i] for i in range(len(p)) if p[i]) - want

    def nearest(places: list[int], size: float) -> list[int]:
        at = bisect.bisect_left(places, size, key=x.__getitem__)
        return places[max(0, at - 1):at + 1]

    while abs(over) > EPS:
        order = sorted(range(len(p)), key=lambda i: (x[i], i))
        taken, left = [i for i in order if p[i]], [i for i in order if not p[i]]
        moves = [(abs(over - x[i] + x[j]), 0, i, j) for i in taken for j in nearest(left, x[i] - over)]
        moves += [(abs(over - x[i]), 1, i, i) for i in nearest(taken, over)] + [(abs(over + x[j]), 1, j, j) for j in nearest(left, -over)]
        best = min(moves, default=(math.inf,))
        if best[0] >= abs(over) - EPS:
            return
        for i in set(best[2:]):
            over += x[i] if not p[i] else -x[i]
            p[i] = 1.0 - p[i]


def cube_blocks(seed: int, last: bool):
    """mapInArrow function over rows (sid, block, ord, size, p) sorted by these."""
    schema = pa.schema([("uid", pa.int64()), ("sid", pa.int64()), ("m", pa.int64()), ("size", pa.int64()), ("p", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (sid, block), t in sorted_groups(it, ["sid", "block"]):
            p, size = t.column("p").to_pylist(), t.column("size").to_pylist()
            want = math.fsum(a * b for a, b in zip(p, size))
            held = flight(p, [float(s) for s in size], random.Random(f"{seed}:{sid}:{block}"))
            if last:
                landing(p, size, held)
                settle(p, size, want)
            yield record(schema, uid=t.column("uid").combine_chunks(), sid=np.full(len(p), sid), m=t.column("m").combine_chunks(), size=size, p=p)

    return run


def cube_sample(units: DataFrame, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """(uid, sid, size, taken) for units (uid, sid, m, size, p), balanced within each sid
    on the number of units and on their sizes; m: units of the sid, at least.  A block
    leaves two units, so the number of blocks of the next turn follows without counting."""
    now, done, turn = units.select("uid", "sid", "m", "size", "p"), None, 0
    most = now.agg(F.max("m")).first()[0] or 0
    waits = F.pmod(F.xxhash64("uid", F.lit(seed + 1009)), F.col("m")) < (block // 4 if most > block else 0)
    waiting, now = now.where(waits), now.where(~waits)
    while True:
        last = most <= block
        blocks = F.lit(1).cast("long") if last else F.ceil(F.col("m") / F.lit(block)).cast("long")
        dealt = (now.unionByName(waiting) if last else now).withColumn("block", F.pmod(F.xxhash64("uid", F.lit(seed + turn)), blocks)) \
            .withColumn("m", blocks * 2).withColumn("ord", F.xxhash64("uid", F.lit(seed - 1 - turn)))
        flown = dealt.repartition("sid", "block").sortWithinPartitions("sid", "block", "ord", "uid") \
            .mapInArrow(cube_blocks(seed + turn, last), "uid long, sid long, m long, size long, p double")
        flown = saved(flown, f"flight{turn}")
        sure = flown.where((F.col("p") == 0) | (F.col("p") == 1)).select("uid", "sid", "size", F.col("p").cast("int").alias("taken"))
        done = sure if done is None else done.unionByName(sure)
        if last:
            return done
        now, most, turn = flown.where((F.col("p") > 0) & (F.col("p") < 1)), 2 * -(-most // block), turn + 1


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, text_hash, copy (number among equal
    rows, from 0), size, source_size, target, times (how often the mix takes it), taken."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", F.xxhash64(text).alias("text_hash"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    # equal rows become one with a count, so that they spread by their number afterwards
    rows = saved(rows.groupBy("doc_id", "source", "text_hash", "size").agg(F.count("*").alias("n")), "sizes")
    goal = targets(rows, weights, most)
    goal = goal.withColumn("sid", F.xxhash64(F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()))
    multiple = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(F.lit(0.0))
    units = rows.alias("r").join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))) \
        .select("doc_id", "r.source", "text_hash", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"),
                "size", "source_size", "target", "sid", "m", multiple.alias("multiple")) \
        .withColumn("uid", F.xxhash64("doc_id", F.col("doc_id").isNull(), "sid", "text_hash", "size", "copy")) \
        .withColumn("p", F.col("multiple") - F.floor("multiple"))
    units = saved(units, "units")
    drawn = cube_sample(units.where((F.col("p") > EPS) & (F.col("p") < 1 - EPS) & (F.col("size") > 0)), block, seed)
    whole = F.floor(F.col("multiple") + EPS)
    times = (whole + F.when(F.col("size") > 0, F.coalesce(F.col("extra"), F.lit(0))).otherwise(0)).cast("int")
    return units.join(drawn.withColumnRenamed("taken", "extra"), ["uid", "sid", "size"], "left") \
        .withColumn("times", times) \
        .select("doc_id", "source", "text_hash", "copy", "size", "source_size", "target", "times",
                (F.col("times") * F.col("size")).cast("long").alias("taken"))
