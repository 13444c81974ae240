import random

import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm.bpe_counts import Merger, bpe_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def check(df, docs, library):
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t in docs)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in bpe_counts(df, PATH).collect()) == want


def test_documents(documents, library):
    check(documents, [(r.doc_id, r.text) for r in documents.collect()], library)


def test_odd_rows(odd, odd_rows, empty, library):
    check(odd, [r[:2] for r in odd_rows], library)
    assert bpe_counts(empty, PATH).collect() == []


def test_random_texts_and_long_words(library):
    rng, some = random.Random(4), ["a", "b", "th", "in", " ", "  ", "\n", "▁", "é", "漢", "🙂", "er", "###", "1", "\t", "\x00", "ing", "A"]
    texts = ["".join(rng.choice(some) if rng.random() < 0.9 else chr(rng.randrange(32, 0x3000)) for _ in range(rng.randrange(0, 60))) for _ in range(1500)]
    texts += [" " * 700, "ab" * 900, "x" * 2000 + " y", "漢字" * 700, "the" * 400 + "\n" + "▁" * 600, "".join(rng.choice("abcdefgh") for _ in range(3000))]
    assert Merger(PATH).texts(texts) == [len(x) for x in library.encode(texts)]
