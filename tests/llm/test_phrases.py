"""Operator 13 against a plain restatement of its contract."""

import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import phrase_parsing
from tidemark.llm.phrase_parsing import collocations, phrase_counts


def counted(rows):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", text):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][" ".join(words[i:i + k])] += 1
    return f, n


def plain(rows, least, first):
    f, n = counted(rows)
    out = set()
    for lang, own in f.items():
        often = {p: a for p, a in own.items() if a >= least and " " in p}
        held = Counter()
        for p, a in often.items():
            w = p.split(" ")
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    s = " ".join(w[i:i + m])
                    held[s] = max(held[s], a)
        scored = []
        for p, a in often.items():
            w = p.split(" ")
            cuts = [(2000000 * a // (own[" ".join(w[:k])] + own[" ".join(w[k:])]), k, own[" ".join(w[:k])], own[" ".join(w[k:])]) for k in range(1, len(w))]
            if 100 * held[p] < 80 * a or not held[p]:
                scored.append((p, a, min(cuts)))
        scored.sort(key=lambda x: (-x[2][0], -x[1], x[0].encode()))
        out |= {(lang, i, p, a, c[2], c[3], n[lang], c[0]) for i, (p, a, c) in enumerate(scored[:first], 1)}
    return out


def mined(df, **how):
    rows = [tuple(r) for r in collocations(df, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_documents(documents):
    rows = [(r.text, r.lang) for r in documents.collect()]
    assert mined(documents) == plain(rows, 30, 2000)
    assert mined(documents, least=6, first=25) == plain(rows, 6, 25)


@pytest.mark.parametrize("period", [1, 2, 1000])
def test_chunks_of_any_length_count_once(documents, period):
    f, n = counted([(r.text, r.lang) for r in documents.collect()])
    want = {(lang, p): a for lang, own in f.items() for p, a in own.items() if a >= 20} | {(lang, ""): x for lang, x in n.items()}
    assert {(r.lang, r.phrase): r.n for r in phrase_counts(documents, 20, period=period, gather=1 << 12 * (period % 3)).collect()} == want


def test_odd_rows(odd, odd_rows, empty):
    rows = [(r[1], r[2]) for r in odd_rows]
    for least in (2, 30):
        assert mined(odd, least=least) == plain(rows, least, 2000)
    assert collocations(empty).count() == 0
    with pytest.raises(ValueError):
        phrase_counts(odd, longest=5)


def test_pairs_counted_in_other_blocks(spark, monkeypatch):
    """A counted phrase may end in a pair that its block holds at uncounted places only."""
    monkeypatch.setattr(phrase_parsing, "BLOCK_BYTES", 1 << 8)
    rows = [(f"u{i} u{i + 1} a b c d e f g h v{i}", "en") for i in range(60)]
    df = spark.createDataFrame(rows, "text string, lang string")
    f, n = counted(rows)
    want = {("en", p): a for p, a in f["en"].items() if a >= 30} | {("en", ""): n["en"]}
    for period in (2, 5):
        assert {(r.lang, r.phrase): r.n for r in phrase_counts(df, 30, period=period).collect()} == want


def test_blocks_report_a_message_a_part():
    """Phrases travel packed: a block sends at most a message a part, whatever the number of its phrases; parts sum them up as text."""
    import numpy as np
    from tidemark.llm.blocks import packed_keys
    text = [b" ".join(b"w%d" % (i * j % 50) for i in range(40)) for j in range(1, 30)]
    payload = phrase_parsing.packed(*phrase_parsing.numbered(["en", "de"] * 14 + ["en"], text, [False] * 29, [2] * 29))
    chunks = phrase_parsing.Chunks(payload)
    keys = [np.unique(np.concatenate([h for lang in chunks.langs.values() for k, _, h, _ in phrase_parsing.grown(lang, chunks.counts()[0], 4) if which(k)]))
            for which in (lambda k: k <= 2, lambda k: k > 2)]
    n = 3
    got = {0: packed_keys(keys[0]), n: packed_keys(keys[1])}
    sent = list(phrase_parsing.phrases(n, 4)(5, payload, got))
    assert sorted(b.column("part")[0].as_py() for b in sent) == [0, 1, 2] and all(b.num_rows == 1 for b in sent)
    f, words = counted([(t.decode(), lang) for t, lang in zip(text, ["en", "de"] * 14 + ["en"], strict=True)])
    want = {(lang, p): 4 * a for lang, own in f.items() for p, a in own.items() if 4 * a >= 12} | {(lang, ""): 4 * x for lang, x in words.items()}
    found = [r for b in sent for out in phrase_parsing.counted(12)(0, [5, 6], [b.column("payload")[0].as_py()] * 2) for r in out.to_pylist()]
    assert len(found) == len(want) and {(r["lang"], r["phrase"]): r["n"] for r in found} == want
