import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.ffd_packing import Encoder, ffd_packing, first_fit_decreasing
from tidemark.llm.queries import packing

JSON, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def check(rows, docs, library, length=2048):
    ids = [np.append(np.array(library.encode(t or "", add_special_tokens=False).ids, np.uint32), np.uint32(1)).astype("<u4") for _, t in docs]
    want = sorted((str(d), a, len(x[a:a + length]), zlib.crc32(x[a:a + length].tobytes()), len(x))
                  for (d, _), x in zip(docs, ids) for a in range(0, len(x), length))
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        assert at <= length
    return len(sequences), sum(map(len, ids))


def test_documents(documents, library):
    n, tokens = check(packing(documents).collect(), [(r.doc_id, r.text) for r in documents.collect()], library)
    assert tokens > 0.95 * 2048 * (n - 1)


def test_odd_rows(odd, odd_rows, empty, library):
    check(packing(odd).collect(), [r[:2] for r in odd_rows], library)
    assert packing(empty).collect() == []


def test_many_groups_and_ids(documents, library):
    rows = ffd_packing(documents, JSON, RANKS, public_tokenizers.PATTERN, length=512, group=64, with_ids=True).collect()
    n, tokens = check(rows, [(r.doc_id, r.text) for r in documents.collect()], library, 512)
    assert tokens > 0.93 * 512 * n
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)


def test_encoder_is_the_library(library):
    encoder = Encoder(JSON, RANKS, public_tokenizers.PATTERN)
    rng = np.random.default_rng(1)
    texts = ["", "<|endoftext|> a<|endoftext|>", "it's I'LL we’re", " \t \n x", "a" * 3000, " " * 300_000, "é漢🙂\x00"]
    texts += ["".join(map(chr, rng.integers(32, 0xD000, 50))) for _ in range(200)]
    for t in texts:
        assert encoder.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_first_fit_decreasing_by_hand():
    rng = np.random.default_rng(2)
    for sizes in (np.array([6, 5, 4, 3, 2]), rng.integers(1, 10, 200), np.array([1]), np.array([9] * 8)):
        bins, offsets = first_fit_decreasing(sizes, 10)
        rooms, want = [], np.zeros(len(sizes), int)
        for i in np.argsort(-sizes, kind="stable"):
            at = next((b for b, room in enumerate(rooms) if room >= sizes[i]), len(rooms))
            rooms += [10] * (at == len(rooms))
            rooms[at] -= sizes[i]
            want[i] = at
        assert bins.tolist() == want.tolist()
