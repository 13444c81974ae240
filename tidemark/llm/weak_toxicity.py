"""Operator 2, toxicity: weak supervision with a generative label model.

1. Lexicon: words and word beginnings that mark toxic rows among at most
   ``SAMPLE`` labelled training rows of each label.
2. One pass over all texts turns each into a few numbers (lexicon hits, their
   density, their concentration, shouting and punctuation patterns).
3. Voters are thresholds on these numbers that vote 1, 0 or not at all.
4. The label model estimates from the votes of all texts (how often each
   pattern of votes occurs: at most 3**voters rows) how accurate each voter is;
   the given labels take part as one more voter where a training row has one.
   Which voters repeat each other is taken once, from the labelled sample, and
   repeating voters share one voice.  Voters are at most nine sums: no lexicon
   entry votes itself.
5. A linear classifier on the numbers is trained on the posterior labels of the
   sampled rows and gives the score.

A sampled row stands for as many training rows of its label as there are to each
sampled one, in the voters' cuts, the label model and the classifier: the share of
toxic rows is that of all training rows, whatever the sample.

Labels are read from training rows only; language, source and id are no inputs.

Defined cases: null and empty texts are texts without hits and get the score of
such; equal texts get equal scores; rows of ``labels`` with nulls are not used
and of several labels of an id the largest counts; without any toxic training
row no lexicon exists and every score is the share of toxic rows (0.0).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, bounded_batches, crc_of_id, free_name, record, saved

#: Labelled training rows of each label that lexicon, voters and classifier are fitted on.
SAMPLE = 10_000
FOLDS, HELD_OUT = 3, 1
CUT = 0.7
TERMS = 400
#: Lengths of word beginnings that can be lexicon entries.
BEGINNINGS = (4, 5, 6)
#: Words of a window in which hits are counted together.
WINDOW = 60
WORDS = re.compile(r"\w+")
NUMBERS = ("hits", "kinds", "density", "window", "first_half", "second_half", "strong", "shouted", "marks")


def terms_of(words: set[str]) -> set[str]:
    return {"=" + w for w in words}.union(*({"^" + w[:n] for w in words if len(w) >= n} for n in BEGINNINGS))


def lexicon(train: DataFrame, terms: int = TERMS) -> list[tuple[str, float]]:
    """(term, log-odds) of words ("=word") and beginnings ("^begin") that mark toxic rows, strongest first."""
    schema = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches(it):
            for text, label in zip(b["text"].to_pylist(), b["label"].to_pylist(), strict=True):
                found[label].update(terms_of(set(WORDS.findall((text or "").lower()))))
        names = list(found[0] | found[1])
        for a in range(0, len(names), 50_000):
            some = names[a:a + 50_000]
            yield record(schema, term=some, toxic=[found[1][t] for t in some], clean=[found[0][t] for t in some])

    n_toxic, n_clean = train.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if not n_toxic:
        return []
    per = train.select("text", "label").mapInArrow(count, "term string, toxic long, clean long").groupBy("term") \
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    sure = F.col("odds") / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))  # in standard errors
    best = per.where(F.col("toxic") >= max(3, round(0.004 * n_toxic))).withColumn("odds", odds).where((F.col("odds") >= 1.5) & (sure >= 2.5)) \
        .orderBy((F.col("odds") * F.sqrt("toxic")).desc(), F.length("term").desc(), "term").limit(terms).collect()
    out, seen = [], set()
    for r in best:  # a beginning speaks for the words and longer beginnings under it
        if not any(("^" + r.term[1:n + 1]) in seen for n in BEGINNINGS if n < len(r.term) - 1 + (r.term[0] == "=")):
            out.append((r.term, r.odds))
            seen.add(r.term)
    return out


def numbers(docs: DataFrame, words: list[tuple[str, float]], name: str = "x") -> DataFrame:
    """``docs`` with a column of the numbers of each text."""
    exact = {t[1:] for t, _ in words if t[0] == "="}
    begin = {n: {t[1:] for t, _ in words if t[0] == "^" and len(t) == n + 1} for n in BEGINNINGS}
    strong = {t[1:] for t, o in words if o >= 4.0}
    lengths = [n for n in BEGINNINGS if begin[n]]

    def measure(text: str) -> list[float]:
        found = WORDS.findall(text.lower())
        n = len(found)
        at = [i for i, w in enumerate(found) if w in exact]
        for k in lengths:
            own = begin[k]
            at += [i for i, w in enumerate(found) if w[:k] in own]
        at = sorted(set(at))
        hits = [found[i] for i in at]
        most, a = 0, 0
        for z in range(len(at)):
            while at[z] - at[a] >= WINDOW:
                a += 1
            most = max(most, z - a + 1)
        half = sum(i < n / 2 for i in at)
        sure = sum(w in strong or any(w[:k] in strong for k in lengths) for w in hits)
        letters = max(1, len(text))
        shouted = sum(map(str.isupper, text)) / letters if at else 0.0
        return [len(hits), len(set(hits)), len(hits) / (n + 1), most, 2 * half / (n + 1), 2 * (len(at) - half) / (n + 1),
                sure / (n + 1), shouted, (text.count("!") + text.count("?")) / letters]

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(v) for v in measure(t or "")])

    return docs.withColumn(name, of(F.col("text")))


def quantiles(x: np.ndarray, weight: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """np.quantile of ``x`` with each value as often as its weight says."""
    order = np.argsort(x, kind="stable")
    x, upto = x[order], np.cumsum(weight[order])
    at = asked * max(0.0, upto[-1] - 1)
    low, high = (x[np.searchsorted(upto, np.floor(at) + k, "right").clip(0, len(x) - 1)] for k in (0, 1))
    return low + (high - low) * (at - np.floor(at))


def thresholds(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[tuple[int, float, float]]:
    """Voters (number, low, high): vote 0 up to low, 1 from high, abstain between.  high and low
    are where votes become mostly right on the weighted sample; numbers that never do have no voter."""
    out = []
    for i in range(x.shape[1]):
        values = np.unique(quantiles(x[:, i], weight, np.linspace(0, 1, 201)))
        middle = (values[1:] + values[:-1]) / 2
        toxic = [(x[:, i] >= m, m) for m in middle]
        right = [(np.average(y[up], weights=weight[up]), np.average(y[~up], weights=weight[~up]), m) for up, m in toxic]
        high = next((m for up, _, m in right if up >= 0.85), None)
        low = next((m for _, down, m in reversed(right) if down <= 0.02), None)
        if high is None and low is None:
            continue
        out.append((i, -math.inf if low is None else float(low), math.inf if high is None else float(high)))
    return out


def votes_of(x: np.ndarray, voters: list[tuple[int, float, float]]) -> np.ndarray:
    """0: no vote, 1: clean, 2: toxic."""
    return np.stack([np.where(x[:, i] >= max(low, high), 2, np.where(x[:, i] < low, 1, 0)) for i, low, high in voters], 1)


class LabelModel:
    """Two classes; a voter's vote has a distribution of its own in each; voters that
    repeat each other beyond the class share one voice (their weights add up to one)."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, gold: np.ndarray, gold_y: np.ndarray, rounds: int = 30,
                 gold_weight: np.ndarray | None = None):
        votes = np.concatenate([patterns, gold])
        weight = np.concatenate([counts.astype(float), np.ones(len(gold)) if gold_weight is None else gold_weight])
        label = np.concatenate([np.full(len(patterns), -1), gold_y])
        self.m = votes.shape[1]
        self.share = np.ones(self.m)
        self.accuracy = 0.98  # of a given label
        post = np.where(label >= 0, label, 0.5).astype(float)
        seen = label >= 0
        self._fit(votes[seen], weight[seen], post[seen])
        if seen.any():  # by given labels: a crowd of repeating voters cannot pass for the class itself
            self.share = self._shares(votes[seen], weight[seen], post[seen])
        for _ in range(rounds):
            post = self._posterior(votes, label)
            self._fit(votes, weight, post)

    def _fit(self, votes, weight, post):
        one, zero = weight * post, weight * (1 - post)
        self.prior = float((one.sum() + 1) / (weight.sum() + 2))
        self.table = np.array([[[(zero[votes[:, i] == v].sum() + 1) / (zero.sum() + 3) for v in range(3)],
                                [(one[votes[:, i] == v].sum() + 1) / (one.sum() + 3) for v in range(3)]] for i in range(self.m)])

    def _posterior(self, votes, label):
        odds = np.full(len(votes), math.log(self.prior / (1 - self.prior)))
        for i in range(self.m):
            odds += self.share[i] * np.log(self.table[i, 1] / self.table[i, 0])[votes[:, i]]
        odds += np.where(label >= 0, (2 * label - 1) * math.log(self.accuracy / (1 - self.accuracy)), 0)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def _shares(self, votes, weight, post):
        """1 / (1 + sum of the squared correlations that the class does not explain)."""
        v = votes - np.where(votes == 0, 0, 1.5)
        mean = np.array([[np.average(v[:, i], weights=w) for w in (weight * (1 - post) + 1e-9, weight * post + 1e-9)] for i in range(self.m)])
        rest = v - (mean[:, 0] + np.outer(post, mean[:, 1] - mean[:, 0]))
        cov = (rest * weight[:, None]).T @ rest / weight.sum()
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = cov / np.outer(scale, scale)
        return 1 / (corr ** 2).clip(0, 1).sum(1).clip(1)

    def posterior(self, votes, label):
        return self._posterior(votes, label)


def features(x: np.ndarray) -> np.ndarray:
    """Numbers on a scale that a linear classifier can use."""
    hits, kinds, density, window, first, second, strong, shouted, marks = x.T
    return np.stack([np.ones(len(x)), np.minimum(hits, 8), np.minimum(kinds, 6), np.log1p(400 * density), np.minimum(window, 6),
                     np.log1p(400 * first), np.log1p(400 * second), np.log1p(400 * strong), np.minimum(100 * density, 5), hits >= 1, hits >= 2,
                     shouted, np.minimum(100 * marks, 5)], 1).astype(float)


def logistic(f: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Newton's method on soft labels of weighted rows."""
    w, penalty = np.zeros(f.shape[1]), np.full(f.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        step = np.linalg.solve((f * (weight * p * (1 - p))[:, None]).T @ f + np.diag(penalty + 1e-9), f.T @ (weight * (y - p)) - penalty * w)
        w += step * min(1.0, 4 / (1e-9 + np.abs(step).max()))
    return w


def training_rows(labels: DataFrame, folds: int, held_out: int) -> DataFrame:
    """doc_id, label of each labelled row that may be used."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")) \
        .where("doc_id IS NOT NULL AND label IN (0, 1)").where(crc_of_id() % folds != held_out) \
        .groupBy("doc_id").agg(F.max("label").alias("label"))


def sample_of(known: DataFrame, sample: int) -> DataFrame:
    """doc_id, label: at most ``sample`` training rows of each label, by a hash of their id."""
    return reduce(DataFrame.unionByName, [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for v in (0, 1)])


class ToxicityModel:
    """Fitted on ``docs`` and ``labels``; scores any texts."""

    def __init__(self, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, held_out: int = HELD_OUT):
        bounded_batches(docs.sparkSession)
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        known = saved(training_rows(labels, folds, held_out), "known")
        chosen = F.broadcast(saved(sample_of(known, sample), "labels"))  # at most 2 * sample rows of two numbers
        train = saved(own.join(chosen, "doc_id").repartition(F.xxhash64("doc_id", "text")), "train")
        self.words, self.weights, self.constant = lexicon(train), None, 0.0
        #: the numbers of all rows, with a hash of their text
        self.measured = saved(numbers(own, self.words).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "x"), "numbers")
        if not self.words:
            return
        gold = self.measured.join(chosen, "doc_id").dropDuplicates(["doc_id", "text_hash"]).orderBy("doc_id", "text_hash").limit(2 * sample).toPandas()
        x, y = np.stack(gold["x"].to_numpy()), gold["label"].to_numpy()
        #: training rows of a label to each sampled one
        stands = {r["label"]: r["count"] / min(sample, r["count"]) for r in known.groupBy("label").count().collect()}
        weight = np.array([stands[v] for v in y.tolist()])
        self.constant, voters = float(np.average(y, weights=weight)), thresholds(x, y, weight)
        if not voters:
            return
        vote = [F.when(F.col("x")[i] >= F.lit(max(low, high)), 2).when(F.col("x")[i] < F.lit(low), 1).otherwise(0) for i, low, high in voters]
        code = reduce(add, [v * 3**k for k, v in enumerate(vote)])
        patterns = self.measured.groupBy(code.alias("code")).count().orderBy("code").toPandas()  # at most 3 ** len(voters) rows
        of_code = np.stack([patterns["code"].to_numpy() // 3**k % 3 for k in range(len(voters))], 1)
        model = LabelModel(of_code, patterns["count"].to_numpy(), votes_of(x, voters), y, gold_weight=weight)
        self.weights = logistic(features(x), model.posterior(votes_of(x, voters), y), weight)

    def score_of(self, x: Column) -> Column:
        """Score of a column of numbers."""
        if self.weights is None:
            return F.lit(self.constant)
        w = self.weights

        @F.pandas_udf("double")
        def score(xs: pd.Series) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-np.clip(features(np.stack(xs.to_numpy())) @ w, -30, 30)))) if len(xs) else pd.Series([], dtype=float)

        return score(x)

    def scored(self, docs: DataFrame, name: str = "score") -> DataFrame:
        """``docs`` with a score column, in one pass and without a shuffle."""
        x = free_name(docs, "__x")
        return numbers(docs, self.words, x).withColumn(name, self.score_of(F.col(x))).drop(x)


def weak_toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, text_hash, score of each row of ``docs``."""
    model = ToxicityModel(docs, labels, **how)
    return model.measured.select("doc_id", "text_hash", model.score_of(F.col("x")).alias("score"))
