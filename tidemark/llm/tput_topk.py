"""Operator 9, exact top-k search: three-phase uniform threshold.

A vector's dimensions are dealt to fragments; a candidate's score is the sum of
its fragments' scores, and each fragment sees its own part alone.
1. Every fragment of every row block lists its best candidates for a query;
   the full scores of those on the lists give a k-th best that is safe (the
   cutoff) and the least score of each fragment makes scores non-negative.
2. With m fragments, a candidate at or above the cutoff reaches a uniform m-th
   part of it in one fragment at least; fragments collect such entries, and a
   candidate whose parts and the threshold for missing parts don't reach the
   cutoff goes.
3. What is left is scored exactly, and the k best are taken.
Queries meet all rows in blocks of queries by blocks of rows; no pair leaves a
block before it has passed a threshold.

Of equal vectors only the k + 1 with the smallest ids can be among a query's k
best, so the others are not candidates (they stay queries).

Defined cases: null vectors, and vectors holding a null or a component that is
not finite, take no part; shorter vectors count as padded with zeros; equal ids
are separate rows and only the query's own row is left out; ties go to the
smaller id; fewer than k candidates: all; empty table: no rows.  Scores are
64-bit integers; large ones are computed without floats, and one that needs more
than 64 bits has no defined result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, parts, record, saved, sorted_groups

K = 5
SCALE = 256
FRAGMENTS = 2
ROW_BLOCK = 4096
QUERY_BLOCK = 512
SALTS = 64


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id, v (floor(scale * x) of every component), for vectors that are whole and finite."""
    x = F.col(vector_col)
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return vectors.select(F.col(id_col).alias("vec_id"), x.alias("x")).where(F.col("x").isNotNull()) \
        .where(F.forall("x", fine)).select("vec_id", F.transform("x", lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long")).alias("v"))


def matrix(col: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros on the right."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat, ends = col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())
    out = np.zeros((len(col), width), np.int64)
    out[np.arange(width)[None, :] < ends[:, None]] = flat
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floats where they are exact, else by integers."""
    most = float(max(1, np.abs(a).max(initial=0))) * float(max(1, np.abs(b).max(initial=0))) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def fragments(width: int, m: int) -> list[slice]:
    cut = [round(i * width / m) for i in range(m + 1)]
    return [slice(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a] or [slice(0, 0)]


def _pairs(it, width: int) -> Iterator[tuple]:
    """(queries, candidates) of each pair of blocks; ``side`` 0 sorts queries first."""
    for _, t in sorted_groups(it, ["qb", "rb"]):
        side = t.column("side").to_numpy()
        q, c = t.slice(0, int((side == 0).sum())), t.slice(int((side == 0).sum()))
        if q.num_rows and c.num_rows:
            yield q, c, matrix(q.column("v"), width), matrix(c.column("v"), width)


def _own(q: pa.Table, c: pa.Table) -> np.ndarray:
    return q.column("uid").to_numpy()[:, None] == c.column("uid").to_numpy()[None, :]


def listed(k: int, width: int, m: int):
    """Phase 1: the candidates on any fragment's list, with full scores, and each fragment's least score."""
    schema = pa.schema([("quid", pa.int64()), ("uid", pa.int64()), ("score", pa.int64()), ("least", pa.list_(pa.int64()))])

    def run(it):
        for q, c, a, b in _pairs(it, width):
            own, parts = _own(q, c), [product(a[:, s], b[:, s]) for s in fragments(width, m)]
            total, least = sum(parts), np.stack([p.min(axis=1) for p in parts], 1)
            n = min(k + 1, total.shape[1])
            on = np.zeros(total.shape, bool)
            for p in parts:
                np.put_along_axis(on, np.argpartition(p, -n, axis=1)[:, -n:], True, axis=1)
            on &= ~own
            i, j = np.nonzero(on)
            quid, uid = q.column("uid").to_numpy(), c.column("uid").to_numpy()
            yield record(schema, quid=quid[i], uid=uid[j], score=total[i, j], least=[None] * len(i))
            yield record(schema, quid=quid, uid=[None] * len(quid), score=[None] * len(quid), least=least.tolist())

    return run


def collected(width: int, m: int):
    """Phase 2: entries that reach the uniform threshold in a fragment and may reach the cutoff in all."""
    schema = pa.schema([("quid", pa.int64()), ("qid", pa.int64()), ("uid", pa.int64()), ("vec_id", pa.int64()),
                        ("known", pa.int64()), ("missing", pa.list_(pa.int32()))])

    def run(it):
        for q, c, a, b in _pairs(it, width):
            cut = q.column("cutoff").to_numpy(zero_copy_only=False).astype(np.float64)  # nan: no cutoff, all count
            cut = np.where(np.isnan(cut), -np.inf, cut)
            least = matrix(q.column("least"), m)
            share = (cut - least.sum(axis=1)) / m  # of the cutoff above the sum of the least scores
            known, seen, upper = None, [], 0.0
            for f, s in enumerate(fragments(width, m)):
                p = product(a[:, s], b[:, s])
                bar = least[:, f].astype(np.float64) + share
                hit = p >= bar[:, None]
                seen.append(hit)
                known = np.where(hit, p, 0) if known is None else known + np.where(hit, p, 0)
                upper = upper + np.where(hit, p, bar[:, None])
            keep = np.logical_or.reduce(seen) & (upper >= cut[:, None] - 1e-6 * np.maximum(1, np.abs(cut[:, None]))) & ~_own(q, c)
            keep |= np.isinf(cut)[:, None] & ~_own(q, c)
            i, j = np.nonzero(keep)
            lacks = np.stack([~h[i, j] for h in seen], 1)
            yield record(schema, quid=q.column("uid").to_numpy()[i], qid=q.column("vec_id").combine_chunks().take(pa.array(i)),
                         uid=c.column("uid").to_numpy()[j], vec_id=c.column("vec_id").combine_chunks().take(pa.array(j)),
                         known=known[i, j], missing=[np.flatnonzero(x).tolist() for x in lacks])

    return run


def top_k(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = SCALE, m: int = FRAGMENTS, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score; ``is_query``: condition on ``vec_id``."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = saved(scaled(vectors, id_col, vector_col, scale).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    near = Window.partitionBy("v", "salt").orderBy(F.col("vec_id").asc_nulls_last(), "uid")
    nearest = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last(), "uid")
    few = rows.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS))) \
        .withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= k + 1) \
        .withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= k + 1).select("vec_id", "uid", "v")
    queries = saved(rows.where(is_query), "queries")
    few = saved(few, "candidates")
    n_q, n_r = queries.count(), few.count()
    if not n_q or not n_r:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    qbs, rbs = -(-n_q // query_block), -(-n_r // row_block)
    qside = queries.withColumn("qb", F.pmod(F.xxhash64("uid"), F.lit(qbs))).withColumn("side", F.lit(0))
    rside = few.withColumn("rb", F.pmod(F.xxhash64("uid"), F.lit(rbs))).withColumn("side", F.lit(1)) \
        .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qbs - 1).cast("long"))))

    def meet(q: DataFrame) -> DataFrame:
        q = q.withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rbs - 1).cast("long"))))
        both = q.unionByName(rside, allowMissingColumns=True)
        return both.repartition(min(qbs * rbs, 4 * parts(vectors)), "qb", "rb").sortWithinPartitions("qb", "rb", "side")

    first = saved(meet(qside).mapInArrow(listed(k, width, m), "quid long, uid long, score long, least array<long>"), "listed")
    m_is = len(fragments(width, m))
    least = first.where(F.col("least").isNotNull()).groupBy("quid").agg(F.array(*[F.min(F.col("least")[f]) for f in range(m_is)]).alias("least"))
    best = Window.partitionBy("quid").orderBy(F.col("score").desc())
    cutoff = first.where(F.col("score").isNotNull()).withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k) \
        .select("quid", F.col("score").alias("cutoff"))
    told = qside.join(least.join(cutoff, "quid", "left").withColumnRenamed("quid", "uid"), "uid")
    entries = meet(told).mapInArrow(collected(width, m_is), "quid long, qid long, uid long, vec_id long, known long, missing array<int>")
    fragment_of = F.array(*[F.lit(s.start) for s in fragments(width, m)]), F.array(*[F.lit(s.stop - s.start) for s in fragments(width, m)])
    inner = lambda f: F.aggregate(
        F.zip_with(F.slice("a", F.element_at(fragment_of[0], f + 1) + 1, F.element_at(fragment_of[1], f + 1)),
                   F.slice("b", F.element_at(fragment_of[0], f + 1) + 1, F.element_at(fragment_of[1], f + 1)),
                   lambda x, y: F.coalesce(x, F.lit(0)) * F.coalesce(y, F.lit(0))), F.lit(0).cast("long"), lambda t, x: t + x)
    whole = F.col("known") + F.aggregate(F.transform("missing", inner), F.lit(0).cast("long"), lambda t, x: t + x)
    scored = entries.join(few.select("uid", F.col("v").alias("b")), "uid") \
        .join(queries.select(F.col("uid").alias("quid"), F.col("v").alias("a")), "quid") \
        .select("quid", "qid", "vec_id", "uid", whole.alias("score"))
    order = Window.partitionBy("quid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "uid")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select(F.col("qid").alias("query_id"), "rank", "vec_id", "score")
