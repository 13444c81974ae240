import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.test_forest import brute as near_brute
from tests.llm.test_suffix import cover
from tidemark.llm.queries import op2


def stages(spark, docs, sf):
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.cache()
        out.append(docs)
    return out


def test_stages_against_plain_python(spark, sf, documents):
    columns = documents.columns
    clean, single, cut, mixed, packed = stages(spark, documents, sf)
    assert all(x.columns == columns for x in (clean, single, cut, mixed))
    # toxicity: the rows that op2 does not predict
    keep = {r.doc_id for r in op2(spark, sf).collect() if not r.predicted}
    assert sorted(clean.collect()) == sorted(r for r in documents.collect() if r.doc_id in keep)
    # near duplicates: the smallest id of each class
    rows = sorted(clean.collect())
    kept = {int(c) for _, c, _ in near_brute([(r.doc_id, r.text) for r in rows])}
    assert sorted(single.collect()) == [r for r in rows if r.doc_id in kept] and len(kept) < len(rows)
    # repeated passages
    rows = sorted(single.collect())
    covered, want = cover([(r.doc_id, r.text) for r in rows]), []
    for i, r in enumerate(rows):
        b = r.text.encode()
        text = bytes(x for x, c in zip(b, covered[i]) if not c).decode("utf-8", "ignore")
        if text or not b:
            want.append((r.doc_id, text, len(text) if covered[i].any() else r.n_chars))
    assert sorted((r.doc_id, r.text, r.n_chars) for r in cut.collect()) == want
    # mixture: whole rows, at most three times, sources near their targets
    before, after = Counter(cut.collect()), Counter(mixed.collect())
    assert set(after) <= set(before) and max(after.values()) <= 3
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total = sum(words(r.text) * n for r, n in before.items())
    assert abs(sum(words(r.text) * n for r, n in after.items()) - total) < 0.2 * total
    # packing: every row's ids
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sum((len(library.encode(r.text, add_special_tokens=False).ids) + 1) * n for r, n in after.items())
    assert sum(r.length for r in packed.collect()) == tokens


def test_run_is_the_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) > 0


def test_odd_rows(odd, empty, spark, sf):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
            docs = out.cache()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()
