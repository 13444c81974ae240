"""Operator 11 against a plain restatement of its contract."""

import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.term_transducer import Transducer, divergence_audit, share


def plain(rows, least, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)
        n = {s: sum(counts[lang, s][t] for t in kept) for s in sources}

        def p(count, total):
            return 1 + 10**9 * (count + 5) // (total + 5 * len(kept))

        for s in sources:
            pairs = [(o, sum(abs(p(counts[lang, s][t], n[s]) - p(counts[lang, o][t], n[o])) for t in kept)) for o in sources if o != s]
            terms = [(t, p(counts[lang, s][t], n[s]) - p(sum(counts[lang, o][t] for o in sources), sum(n.values()))) for t in kept if counts[lang, s][t]]
            for part, items, most in (("pair", pairs, None), ("term", [x for x in terms if x[1] > 0], top)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def audited(df, **how):
    rows = divergence_audit(df, **how).collect()
    got = {(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in rows}
    assert len(got) == len(rows)
    return got, rows


def test_documents(documents):
    got, _ = audited(documents)
    assert got == plain([(r.text, r.lang, r.source) for r in documents.collect()], 30, 50)


def test_small_shards_and_ordinals(documents):
    rows = [(r.text, r.lang, r.source) for r in documents.collect()]
    got, out = audited(documents, min_docs=5, top=7, shard=11)
    assert got == plain(rows, 5, 7)
    for lang in {r.lang for r in out}:
        terms = {(r.ordinal, r.item.encode()) for r in out if r.part == "term" and r.lang == lang}
        assert [t for _, t in sorted(terms)] == sorted(t for _, t in terms)


def test_odd_rows(odd, odd_rows, empty):
    got, _ = audited(odd, min_docs=2)
    assert got == plain([(r[1], r[2], r[3]) for r in odd_rows], 2, 50)
    bare, _ = audited(odd, min_docs=1000)  # no kept terms: value 0 for every other source
    assert bare == plain([(r[1], r[2], r[3]) for r in odd_rows], 1000, 50) and {r[4] for r in bare} == {0}
    assert divergence_audit(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), min_size=1, max_size=60), st.sets(st.binary(max_size=6), max_size=20))
def test_transducer(terms, others):
    terms = sorted(terms)
    t = Transducer.load(Transducer.build(terms).dump())
    assert [t.ordinal(x) for x in terms] == list(range(len(terms))) and [t.term(i) for i in range(len(terms))] == terms
    assert all(t.ordinal(x) == -1 for x in others - set(terms))
    assert len(set(t.states[:-1])) == len(t.states) - 1  # minimal: no two states alike


def test_share_is_exact_beyond_64_bits():
    n = np.array([0, 10**13, 7 * 10**12 + 3])
    assert share(n, 10**14 + 7, 10**6).tolist() == [1 + 10**9 * (x + 5) // (10**14 + 7 + 5 * 10**6) for x in n.tolist()]
