import hashlib

import numpy as np
import pytest

from tidemark.llm.suffix_levels import Levels, suffix_dedup


def cover(docs, length=50):
    """Covered bytes of each row, from all strings of rows with smaller ids."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
    seen, out, at = set(), {}, 0
    while at < len(order):
        same = [i for i in order if docs[i][0] == docs[order[at]][0]]
        texts = {i: (docs[i][1] or "").encode() for i in same}
        for i, b in texts.items():
            c = np.zeros(len(b), bool)
            for s in range(len(b) - length + 1):
                if b[s:s + length] in seen:
                    c[s:s + length] = True
            out[i] = c
        for b in texts.values():
            seen.update(b[s:s + length] for s in range(len(b) - length + 1))
        at += len(same)
    return out


def brute(docs):
    out = []
    for i, c in cover(docs).items():
        b = np.frombuffer((docs[i][1] or "").encode(), np.uint8)
        spans = int((c & ~np.r_[False, c[:-1]]).sum()) if len(c) else 0
        out.append((str(docs[i][0]), len(b), int(c.sum()), spans, hashlib.sha256(b[~c].tobytes()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df).collect())


def test_documents(documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    assert got(documents) == brute(docs)


def test_planted_passages(spark):
    rng = np.random.default_rng(9)
    word = lambda n: " ".join("".join(rng.choice(list("abcdeé"), rng.integers(2, 9))) for _ in range(n))
    shared, docs = [word(60), word(12), "x" * 300], []
    for i in range(400):
        text = word(rng.integers(1, 60))
        for s in shared:
            if rng.random() < 0.4:
                cut = rng.integers(0, len(s) - 40)
                text += s[cut:] + word(2)
        docs.append((int(rng.integers(0, 300)), text))
    docs += [(900 + i, docs[3][1]) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(df) == brute(docs)


def test_odd_rows(odd, odd_rows, empty):
    assert got(odd) == brute([r[:2] for r in odd_rows])
    assert suffix_dedup(empty).collect() == []
    whole = suffix_dedup(odd, whole_rows=True, removed="gone")
    assert whole.columns == [*odd.columns, "gone"] and whole.count() == len(odd_rows)
    assert {tuple(r[5:-1]) for r in whole.collect()} == {r[5:] for r in odd_rows}
    with pytest.raises(ValueError):
        suffix_dedup(odd, whole_rows=True)


def test_levels_stay_logarithmic():
    rng, levels, all_marks = np.random.default_rng(1), Levels(), np.zeros(0, np.uint64)
    for i in range(64):
        new = np.setdiff1d(np.unique(rng.integers(0, 10 ** 9, 100).astype(np.uint64)), all_marks)
        levels.add(new, np.full(len(new), i), np.arange(len(new)))
        all_marks = np.union1d(all_marks, new)
    assert len(levels.levels) <= 8 and sum(len(x[0]) for x in levels.levels) == len(all_marks)
    ids, _ = levels.find(all_marks)
    assert (ids < 64).all()


def agreeing_texts():
    """Two texts of 4,096 bytes that share no 50-byte string, but any hash that sums up powers of an odd
    base modulo 2^64 (their difference is a Thue-Morse sequence)."""
    rng = np.random.default_rng(3)
    turn = np.array([bin(i).count("1") & 1 for i in range(4096)])
    letters = 97 + 2 * rng.integers(0, 12, 4096)
    one, two = (bytes((letters + t).astype(np.uint8)).decode() for t in (turn, 1 - turn))
    weights = np.full(4096, 0x9E3779B97F4A7C15, np.uint64)
    weights[0] = 1
    with np.errstate(over="ignore"):
        weights = np.multiply.accumulate(weights)
        sums = [(np.frombuffer(x.encode(), np.uint8).astype(np.uint64) * weights).sum() for x in (one, two)]
    assert sums[0] == sums[1] and not {one[i:i + 50] for i in range(4047)} & {two[i:i + 50] for i in range(4047)}
    return one, two


def test_texts_that_agree_in_a_polynomial_hash(spark):
    one, two = agreeing_texts()
    df = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup(df).collect()}
    assert got == {1: 0, 2: 0, 3: 4096}
