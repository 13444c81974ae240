import hashlib

from tidemark.llm.lz_fingerprint import KEEP, Parsed, fingerprints, lz_neighbours


def phrases(text):
    known, out, w = set(), [], ""
    for c in text:
        w += c
        if w not in known:
            known.add(w)
            out.append(w)
            w = ""
    return out + [w] * bool(w)


def check(rows, docs):
    assert len(rows) == len(docs)
    n_of = {}
    prints = {}
    for r in rows:
        n_of.setdefault(r.doc_id, []).append(r.n_chars)
        prints[r.doc_id] = r.fingerprint
    texts = {}
    for i, t in docs:
        texts.setdefault(i, []).append(t or "")
    assert {i: sorted(n) for i, n in n_of.items()} == {i: sorted(map(len, t)) for i, t in texts.items()}
    return texts


def test_documents(documents):
    docs = sorted(((r.doc_id, r.text) for r in documents.collect()), reverse=True)
    rows = {r.doc_id: r for r in lz_neighbours(documents, blocks=6).collect()}
    check(list(rows.values()), docs)
    for (i, t), (j, u) in zip(docs, docs[1:] + docs[:1]):
        edited = t[:len(t) - len(t) // 3] + u[:len(t) // 3]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i].edited_fingerprint == Parsed(edited).print.astype(">u4").tobytes().hex()
        for text, mark in ((t, rows[i].fingerprint), (edited, rows[i].edited_fingerprint)):
            assert len(mark) == 8 * min(KEEP, len(set(phrases(text))))
        if t == u:
            assert rows[i].near_next == 1.0
    long = [r for r in rows.values() if r.n_chars > 300]
    assert sum(r.near_edited for r in long) / len(long) > 0.45 > 0.3 > sum(r.near_next for r in long) / len(long)


def test_likeness_is_near_the_share_of_phrases(documents):
    docs = sorted(((r.doc_id, r.text) for r in documents.collect()), reverse=True)
    rows = {r.doc_id: r for r in lz_neighbours(documents).collect()}
    off = []
    for (i, t), (_, u) in zip(docs, docs[1:] + docs[:1]):
        a, b = set(phrases(t)), set(phrases(u))
        off.append(abs(len(a & b) / max(1, len(a | b)) - rows[i].near_next))
    assert sum(off) / len(off) < 0.05


def test_odd_rows(spark, odd, odd_rows, empty):
    rows = lz_neighbours(odd, blocks=3).collect()
    texts = check(rows, [r[:2] for r in odd_rows])
    of_text = {}
    for r in rows:
        if len(texts[r.doc_id]) == 1:
            assert of_text.setdefault(texts[r.doc_id][0], r.fingerprint) == r.fingerprint
    # the last in order (no id) is followed by the largest id
    last, = [r for r in rows if r.doc_id is None]
    t, u = "no id here", next(r[1] for r in odd_rows if r[0] == 12)
    assert last.edited_sha256 == hashlib.sha256((t[:len(t) - len(t) // 3] + u[:len(t) // 3]).encode()).hexdigest()
    assert lz_neighbours(empty).collect() == []
    alone = lz_neighbours(spark.createDataFrame([(5, "abcabc")], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert fingerprints(odd).count() == len(odd_rows)
