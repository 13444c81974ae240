import re

import numpy as np

from tests.llm.test_suffix import agreeing_texts
from tidemark.llm.lsh_forest import jaccard_join, prefix_length, similar


def grams(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    """(id, class name, links) of each row, by comparing all rows."""
    sets = [grams(t) for _, t in docs]
    links, root = [0] * len(docs), list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or a and b and 10 * len(a & b) >= 8 * len(a | b):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            names[find(i)] = min(d, names.get(find(i), d))
    return sorted((str(d), str(names.get(find(i))), n) for i, ((d, _), n) in enumerate(zip(docs, links)))


def got(df, **how):
    return sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in jaccard_join(df, **how).collect())


def test_documents(documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    want = brute(docs)
    assert any(n for *_, n in want) and got(documents) == want


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in rng.integers(0, 500, 120)]
    docs = []
    for i in range(150):
        w = list(base)
        for at in rng.integers(0, 120, 3):
            w[at] = f"x{i}"
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, docs[0][1]) for i in range(200)]
    docs += [(5000 + i, " ".join(f"u{x}" for x in rng.integers(0, 10 ** 6, 40))) for i in range(50)]
    assert got(spark.createDataFrame(docs, "doc_id long, text string"), block=32) == brute(docs)


def test_odd_rows(odd, odd_rows, empty):
    assert got(odd) == brute([r[:2] for r in odd_rows])
    assert jaccard_join(empty).collect() == []


def test_prefix_is_shortened_until_the_recall():
    for s, target in ((0.8, 0.9999), (0.8, 0.9), (0.6, 0.99)):
        k = prefix_length(s, target)
        assert 1 - (1 - s ** k) ** 32 >= target > 1 - (1 - s ** (k + 1)) ** 32 or k == 8


def test_similar_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 40)).astype(np.uint64)) for _ in range(60)]
    for a, b in ((sets, sets), (sets[:20], sets[20:])):
        for i, near in similar(a, b, 0.7):
            want = [j for j, x in enumerate(b) if len(np.intersect1d(a[i], x)) >= 0.7 * len(np.union1d(a[i], x))]
            assert [j for j in near if not (a is b and i == j)] == [j for j in want if not (a is b and i == j)]


def test_words_that_agree_in_a_polynomial_hash(spark):
    one, two = agreeing_texts()
    docs = [(1, one), (2, two), (3, f"{one} a b c d e f"), (4, f"{two} a b c d e f")]
    assert got(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)
