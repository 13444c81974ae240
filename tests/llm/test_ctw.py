import math
import re
import zlib

from tests.llm.test_suffix import agreeing_texts
from tidemark.llm.ctw_score import ctw_score


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode()


def kt(a, b):
    return math.lgamma(a + .5) + math.lgamma(b + .5) - math.log(math.pi) - math.lgamma(a + b + 1)


def brute(docs, depth):
    """Plain recursive context-tree weighting over (context, decision) counts."""
    train = [lower(t) for i, t in docs if zlib.crc32(b"" if i is None else str(i).encode()) % 10]
    counts = {}

    def steps(text):
        for at, byte in enumerate([*text, 255]):
            context = bytes(text[at - 1 - d] if at - 1 - d >= 0 else 255 for d in range(depth))
            for j in range(8):
                yield context, (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1

    children = {}
    for text in train:
        for context, node, bit in steps(text):
            for d in range(depth + 1):
                counts.setdefault((context[:d], node), [0, 0])[bit] += 1
                if d < depth:
                    children.setdefault((context[:d], node), set()).add(context[:d + 1])
    memo = {}

    def weighted(context, node):
        if (context, node) not in memo:
            own = kt(*counts[context, node])
            if len(context) < depth:
                rest = sum(weighted(c, node) for c in children[context, node])
                top = max(own, rest)
                own = top + math.log(math.exp(own - top) + math.exp(rest - top)) - math.log(2)
            memo[context, node] = own
        return memo[context, node]

    def p(context, node, bit):
        out = 0.5
        for d in range(depth, -1, -1):
            c = counts.get((context[:d], node))
            if c is None:
                continue
            share = 1.0 if d == depth else math.exp(kt(*c) - math.log(2) - weighted(context[:d], node))
            out = share * (c[bit] + .5) / (sum(c) + 1) + (1 - share) * out
        return out

    words = {}
    for text in train:
        for w in [*re.findall(rb"[^\x20\x09-\x0D]+", text), None]:
            words[w] = words.get(w, 0) + 1
    n, v = sum(words.values()), len(words)
    out = {}
    for i, t in docs:
        text = lower(t)
        tokens = [*re.findall(rb"[^\x20\x09-\x0D]+", text), None]
        base = sum(math.log10((words.get(w, 0) + .1) / (n + .1 * (v + 1))) for w in tokens)
        out[i, t] = (len(tokens), sum(words.get(w, 0) > 0 for w in tokens), n, base, sum(math.log10(p(*s)) for s in steps(text)))
    return out


def check(df, docs, depth):
    want = brute(docs, depth)
    rows = df.collect()
    assert len(rows) == len(docs)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    assert sorted((str(r.doc_id), r.held_out) for r in rows) == sorted((str(i), held(i)) for i, _ in docs)
    found = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows)
    for a, (b, w) in zip(found, sorted((str(i), want[i, t]) for i, t in docs)):
        assert a[:4] == (b, *w[:3])
        assert abs(a[4] - w[3]) < 1e-6 * max(1, abs(w[3])) and abs(a[5] - w[4]) < 1e-4 * max(1, abs(w[4]))


def test_small_texts_against_plain_recursion(spark, documents):
    docs = [(r.doc_id, r.text[:400]) for r in documents.limit(40).collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(ctw_score(df, depth=3), docs, 3)


def test_odd_rows(odd, odd_rows, empty):
    check(ctw_score(odd, depth=2), [r[:2] for r in odd_rows], 2)
    assert ctw_score(empty).collect() == []


def test_held_out_texts_beat_a_uniform_byte(documents):
    rows = [r for r in ctw_score(documents).collect() if r.held_out and r.n_bytes > 200]
    assert rows and sum(r.bits_per_byte for r in rows) / len(rows) < 3.5


def test_words_that_agree_in_a_polynomial_hash(spark):
    one, two = agreeing_texts()
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    learn = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10)
    docs = [(learn, one), (held, two)]
    rows = {r.doc_id: r for r in ctw_score(spark.createDataFrame(docs, "doc_id long, text string"), depth=2).collect()}
    assert rows[held].n_known == 1 and abs(rows[held].base_score - (math.log10(.1 / 2.3) + math.log10(1.1 / 2.3))) < 1e-9
