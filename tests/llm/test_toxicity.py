import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import TEXTS
from tidemark.llm.queries import op2
from tidemark.llm.weak_toxicity import LabelModel, ToxicityModel, features, logistic, thresholds, weak_toxicity

MORE = "/root/testdata/sf0.01"


def test_held_out_rows(spark):
    rows = op2(spark, MORE).join(spark.read.parquet(f"{MORE}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    hit = sum(r.predicted and r.toxic for r in held)
    assert hit >= 0.7 * sum(r.toxic for r in held)
    assert sum(r.predicted and not r.toxic for r in held) <= 0.03 * len(held)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{MORE}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({(r.doc_id): r.score for r in weak_toxicity(docs, x).collect()} for x in (labels, other))
    assert a == b


def test_every_row_has_one_score(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    rows = op2(spark, MORE).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(9, 1), (9, 0), (3, 0), (10, 0), (None, 1), (12, None), (99, 1)], "doc_id long, toxic int")
    rows = weak_toxicity(odd, labels).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.text_hash, r.score) == r.score
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in weak_toxicity(odd, none).collect()} == {0.0}
    assert weak_toxicity(empty, labels).collect() == []
    scored = ToxicityModel(odd, labels).scored(odd, "toxicity")
    assert scored.columns == [*odd.columns, "toxicity"] and scored.count() == len(odd_rows) and len(TEXTS) == 13


def test_label_model_tells_good_voters_from_bad():
    rng = np.random.default_rng(5)
    y = (rng.random(4000) < 0.2).astype(int)
    right = lambda p: np.where(rng.random(4000) < p, y, 1 - y) + 1
    copy = right(0.8)
    votes = np.stack([right(0.95), right(0.9), copy, copy, copy], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = LabelModel(patterns, counts, votes[:200], y[:200])
    found = model.posterior(votes, np.full(4000, -1))
    assert ((found > 0.5) == y).mean() > 0.93
    assert model.share[2:].max() < 0.6 < model.share[0]


def test_a_capped_sample_keeps_the_share_of_toxic_rows(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(900):
        toxic = int(rng.random() < 0.1)
        words = [f"word{w}" for w in rng.integers(0, 300, 40)]
        for _ in range(int(rng.integers(1, 5)) if toxic else int(rng.random() < 0.03)):
            words[rng.integers(0, 40)] = "scum"
        rows.append((i, " ".join(words), toxic))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, toxic int"), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    whole, capped = (ToxicityModel(docs, labels, sample=n) for n in (10_000, 20))
    assert whole.weights is not None and capped.weights is not None
    assert abs(capped.constant - whole.constant) < 1e-9 and whole.constant < 0.15
    means = [np.mean([r.s for r in m.measured.select(m.score_of(F.col("x")).alias("s")).collect()]) for m in (whole, capped)]
    assert abs(means[0] - means[1]) < 0.04


def test_a_weighted_row_counts_as_so_many_rows():
    rng = np.random.default_rng(3)
    y = np.arange(300) % 2
    x = np.abs(rng.normal(0, 0.2, (300, 9)) + 0.9 * y[:, None] * rng.random((300, 9)))
    times = np.where(y == 1, 1, 9)
    more, one = np.repeat(np.arange(300), times), np.ones(times.sum())
    a, b = thresholds(x, y, times.astype(float)), thresholds(x[more], y[more], one)
    assert a and np.allclose(a, b) and not np.array_equal(a, thresholds(x, y, np.ones(300)))
    assert np.allclose(logistic(features(x), y, times.astype(float)), logistic(features(x[more]), y[more], one))
