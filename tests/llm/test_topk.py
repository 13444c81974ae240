import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.tput_topk import top_k


def brute(rows, step=50, k=5):
    fine = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(fine):
        if q is None or q % step:
            continue
        scores = [(-sum(s * t for s, t in zip(x, y)), i is None, i) for b, (i, y) in enumerate(fine) if b != a]
        out += [(q, n + 1, i, -s) for n, (s, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, uid string, v int")


def test_embeddings(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert got(top_k(df, F.col("vec_id") % 50 == 0)) == brute([(r.vec_id, r.embedding) for r in df.collect()])


def test_many_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 20])).tolist()) for i in range(400)]
    want = brute(rows, 10)
    for m in (1, 2, 3):
        assert got(top_k(frame(spark, rows), F.col("vec_id") % 10 == 0, m=m, row_block=64, query_block=7)) == want


def test_equal_vectors_and_odd_rows(spark):
    rows = [(i, [0.5, -0.25, 0.125]) for i in range(300)] + [(300, None), (301, [1.0, None, 2.0]), (302, [float("nan"), 0.0, 0.0]),
            (303, [float("inf"), 0.0, 0.0]), (304, []), (350, [0.5]), (400, [0.1, 0.2, 0.3, 0.4]), (400, [0.1, 0.2, 0.3, 0.4]),
            (None, [9.0, 9.0, 9.0])]
    assert got(top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, row_block=64)) == brute(rows)
    assert got(top_k(frame(spark, []), F.col("vec_id") % 50 == 0)) == []
    few = [(0, [1.0]), (1, [2.0]), (50, [-1.0])]
    assert got(top_k(frame(spark, few), F.col("vec_id") % 50 == 0)) == brute(few)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2 ** 21 + i), float(-(2 ** 20) + 3 * i)]) for i in range(60)]
    want = brute(rows)
    assert got(top_k(frame(spark, rows), F.col("vec_id") % 50 == 0)) == want
