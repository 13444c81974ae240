import re
from collections import defaultdict

from tidemark.llm.mix_sources import mix_sources


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """sizes: {source: words}; shares by weight, stopping at ``most`` times the size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, free, out = sum(sizes.values()), set(names), {}
    while free:
        left = total - sum(out.values())
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > most * sizes[s]]
        if not over:
            out.update({s: left * weight[s] / w for s in free})
            break
        out.update({s: most * sizes[s] for s in over})
        free -= set(over)
    return out


def check(rows, docs):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in docs]
    key = lambda *x: tuple((v is None, v) for v in x)
    assert sorted(key(r.doc_id, r.source, r["size"]) for r in rows) == sorted(key(d, s, n) for (d, _, s), n in zip(docs, size))
    sizes, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for (_, _, s), n in zip(docs, size):
        sizes[s] += n
        largest[s] = max(largest[s], n)
    want = brute_targets(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source])
        assert r.taken == r.times * r["size"] and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6, s


def test_mix_documents(documents, spark):
    docs = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    rows = mix_sources(documents).collect()
    check(rows, docs)
    again = mix_sources(documents.repartition(7)).collect()
    assert sorted((r.doc_id, r.times) for r in again) == sorted((r.doc_id, r.times) for r in rows)


def test_many_blocks_stay_balanced(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    check(mix_sources(docs, block=16).collect(), [(r.doc_id, r.text, r.source) for r in docs.collect()])


def test_odd_rows(odd, odd_rows, empty):
    check(mix_sources(odd).collect(), [(r[0], r[1], r[3]) for r in odd_rows])
    assert mix_sources(empty).collect() == []


def test_hot_group_of_equal_rows(spark):
    docs = [(1, "a b c", "s")] * 500 + [(i, "a b " * (i % 9 + 1), "t") for i in range(700)]
    check(mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string"), block=32).collect(), docs)


def test_words_come_near_the_targets(spark, sf):
    """Sources of 50 documents and more, none above a tenth of the target: within 2 %, in one block and over several turns."""
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    for block in (4096, 64):
        taken, want, n, largest = defaultdict(int), {}, defaultdict(int), defaultdict(int)
        for r in mix_sources(docs, block=block).collect():
            taken[r.source] += r.taken
            want[r.source] = r.target
            n[r.source] += 1
            largest[r.source] = max(largest[r.source], r["size"])
        fit = [s for s in want if n[s] >= 50 and largest[s] <= want[s] / 10]
        assert fit and all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in fit), block


def test_settle_makes_up_for_a_large_unit():
    from tidemark.llm.mix_sources import settle
    sizes = [900] + [7, 9, 11, 13] * 20
    for want in (300.0, 411.5, 905.0, 0.0):
        p = [1.0] + [0.0] * 80
        settle(p, sizes, want)
        assert set(p) <= {0.0, 1.0} and abs(sum(x for x, t in zip(sizes, p) if t) - want) <= 4
    p = []
    settle(p, [], 0.0)
    assert p == []
