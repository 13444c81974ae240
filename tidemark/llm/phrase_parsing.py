"""Operator 13, phrase collocations by prefix-free parsing.

A piece (text between punctuation) is a run of words.  Wherever the hash of a
window of three words is divisible by ``PERIOD``, a new chunk begins, and the
chunk before it goes on to the end of that window: chunks overlap by three
words, so each phrase of up to four words lies in the chunk in which it begins,
and is counted there alone.  Equal stretches of text are cut alike, so copies
and repeated passages become one dictionary entry with a frequency; phrases are
counted inside distinct chunks only, weighted by it.

Counting has three rounds.  Blocks of the dictionary, whose words are numbered
once for all rounds, send the keyed hashes of
their distinct words and word pairs with weighted counts to parts, which answer
which of them are frequent; then the same for longer phrases of which all pairs
are frequent, as no other can be.  Blocks then send the phrases that are left,
as text, a message a part, and the parts sum these up: the hashes prune and deal,
they never count.  The number of parts grows with the number of
blocks.

A candidate's cut is found by joins of the count table with itself, arithmetic
is decimal; candidates inside a longer one that is nearly as frequent go.

Defined cases: null text is empty, null lang is ``und``; equal rows count each;
very long texts and pieces without a trigger are whole chunks; ties go by
phrase; empty table: no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCKS, dealt, each_part, packed, packed_keys, part_of, summed, unpacked, unpacked_keys
from .byte_bpe import Numbers, message, words_packed, words_unpacked
from .common import MULT, bounded_batches, mix, parts, saved, sorted_groups

BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]+")
WINDOW = 3
LONGEST = WINDOW + 1
#: A chunk begins at one window in so many.
PERIOD = 16
MIN_COUNT = 30
FIRST = 2000
#: Bytes of chunks in one block.
BLOCK_BYTES = 12 << 20
#: Bytes of text whose chunks are gathered before they are sent.
GATHER = 6 << 20
#: Chunks whose words are numbered at once.
SOME = 1 << 12


class Hashes(dict):
    """Keyed 64-bit hashes of words, each made once."""

    def __init__(self, salt: str = ""):
        self.key = hashlib.blake2b(salt.encode(), digest_size=16).digest()

    def __missing__(self, word: bytes) -> int:
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=self.key).digest(), "little")
        return h

    def of(self, words) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a pair from the hashes of its parts."""
    with np.errstate(over="ignore"):
        return mix(a * MULT + b)


def starts(h: np.ndarray, ends: np.ndarray, period: int) -> np.ndarray:
    """Where chunks begin: pieces, and windows (within one piece) whose hash is divisible."""
    start = np.zeros(len(h), bool)
    if len(h) >= WINDOW:
        start[:len(h) - WINDOW + 1] = then(then(h[:-2], h[1:-1]), h[2:]) % np.uint64(period) == 0
        for back in range(1, WINDOW):
            start[ends - back] = False
    start[np.r_[0, ends[:-1]]] = True
    return np.flatnonzero(start)


def parsed(period: int, gather: int):
    """(lang, text, follows, freq): the chunks of a task's texts; follows: another chunk shares the last window."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, (words, lengths) in held.items():
                ends = np.cumsum(lengths)
                a = starts(Hashes().of(words), ends, period)
                nxt = np.r_[a[1:], len(words)]
                end = ends[np.searchsorted(ends, a, "right")]
                follows = nxt < end
                stop = np.where(follows, nxt + WINDOW, end)
                found = Counter(zip([b" ".join(words[x:y]) for x, y in zip(a.tolist(), stop.tolist(), strict=True)], follows.tolist(), strict=True))
                text, follow = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(text), pa.string()), pa.array(text, pa.binary()), pa.array(follow, pa.bool_()),
                                                  pa.array(list(found.values()), pa.int64())], names=["lang", "text", "follows", "freq"])

        for b in it:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words, lengths = held.setdefault(lang, ([], []))
                for piece in BREAK.split(text.lower()):
                    if own := piece.split():
                        words += own
                        lengths.append(len(own))
                size += len(text)
                if not words:
                    del held[lang]
                if size >= gather:
                    yield from flushed()
                    held, size = {}, 0
        yield from flushed()

    return run


def numbered(langs: list, text: list, follows: list, freq: list) -> list[np.ndarray]:
    """The chunks of a block as arrays, by language: its name, its words and their hashes, word numbers of its chunks, the
    words from each place to the end of the chunk, and how often a phrase that begins there counts."""
    rows: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        rows.setdefault(lang, []).append(i)
    out: list[np.ndarray] = []
    for lang in sorted(rows):
        number, own = Numbers(), [text[i] for i in rows[lang]]
        n = np.array([c.count(b" ") + 1 for c in own], np.int32)
        # words are numbered a few chunks at a time: as objects they take ten times their bytes
        codes = np.concatenate([number.of(b" ".join(own[s:s + SOME]).split(b" ")) for s in range(0, len(own), SOME)])
        follow = np.array([follows[i] for i in rows[lang]])
        left = np.repeat(np.cumsum(n, dtype=np.int32), n)  # words from here to the end of the chunk
        left -= np.arange(len(left), dtype=np.int32)
        weight = np.repeat(np.array([freq[i] for i in rows[lang]], np.int64), n)
        weight[left <= np.repeat(np.where(follow, np.int32(WINDOW), np.int32(0)), n)] = 0  # phrases that begin here are counted in the next chunk
        out += [np.frombuffer(lang.encode(), np.uint8), *words_packed(list(number)), Hashes(lang).of(number), codes, left, weight]
    return out


def chunk_blocks(chunks: DataFrame, block_bytes: int) -> DataFrame:
    """(block, part = -1, payload): chunks, numbered once for all rounds, in the shared folder."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n, size = TaskContext.get().partitionId() << 32, 0, 0
        held: list[list] = [[], [], [], []]
        for b in it:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for h, x in zip(held, row, strict=True):
                    h.append(x)
                size += len(row[1])
                if size >= block_bytes:
                    yield message(first + n, -1, packed(*numbered(*held)))
                    held, size, n = [[], [], [], []], 0, n + 1
        if held[0]:
            yield message(first + n, -1, packed(*numbered(*held)))

    return saved(chunks.mapInArrow(run, BLOCKS), "phrase-blocks")


class Chunks:
    """The chunks of a block, by language, as arrays of word numbers."""

    def __init__(self, payload: bytes):
        arrays = unpacked(payload)
        self.langs = {arrays[i].tobytes().decode(): ((arrays[i + 1], arrays[i + 2]), *arrays[i + 3:i + 7]) for i in range(0, len(arrays), 7)}

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of words and word pairs of the block with weighted counts, sorted.  Pairs that begin
        where nothing is counted weigh nothing here, but a counted phrase may hold them: they are asked for too."""
        keys, weights = [], []
        for _, hashes, codes, left, weight in self.langs.values():
            at = np.flatnonzero(left[:-1] >= 2)
            keys += [hashes, then(hashes[codes[at]], hashes[codes[at + 1]])]
            weights += [weighted(codes, weight, len(hashes)), weight[at]]
        if not keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return added(np.concatenate(keys), np.concatenate(weights))


def ask(n: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for block, payload in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                key, weight = Chunks(payload).counts()
                for p, own in dealt(key, n, weight):
                    yield message(block, p, own)

    return run


def frequent(least: int):
    """The keys of each block that reach ``least`` in all blocks together."""
    def run(part, blocks, payloads):
        asks = [unpacked_keys(p) for p in payloads]
        key, total = summed(*(np.concatenate([a[i] for a in asks]) for i in (0, 1)))
        often = key[total >= least]
        for block, (own, _) in zip(blocks, asks, strict=True):
            at = np.minimum(np.searchsorted(often, own), max(0, len(often) - 1))
            yield message(block, part, packed_keys(own[often[at] == own] if len(often) else own[:0]))

    return run


def member(keys: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether sorted ``keys`` have each of ``k``."""
    if not len(keys):
        return np.zeros(len(k), bool)
    return keys[np.minimum(np.searchsorted(keys, k), len(keys) - 1)] == k


def gathered(got: dict, first: int, last: int) -> np.ndarray:
    """The keys of a block's answers of some parts, which are runs of the keys."""
    return np.concatenate([unpacked_keys(got[p])[0] for p in sorted(got) if first <= p < last] or [np.zeros(0, np.uint64)])


def grown(lang: tuple, key: np.ndarray, longest: int, use=None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(k, places, hashes, weights) of a language's phrases of k words that begin at counted places and of
    which all words and pairs are among ``key``; ``use(hashes)`` tells which of three and more words go on."""
    _, hashes, codes, left, weight = lang
    word = member(key, hashes)[codes]
    pairs = left >= 2  # whether the pair that begins here is frequent
    pairs &= word
    pairs[:-1] &= word[1:]
    at = np.flatnonzero(pairs)
    pairs[at] = member(key, then(hashes[codes[at]], hashes[codes[at + 1]]))
    at = np.flatnonzero(word & (weight > 0))
    h = hashes[codes[at]]
    for k in range(1, longest + 1):
        if k > 1:
            on = left[at] >= k
            on[on] = pairs[at[on] + k - 2]
            at = at[on]
            h = then(h[on], hashes[codes[at + k - 1]])
        if k > 2 and use is not None:
            on = use(h)
            at, h = at[on], h[on]
        if not len(at):
            return
        yield k, at, h, weight[at]


def ask_longer(n: int, longest: int):
    """The second question: phrases of three and more words whose pairs are frequent (parts n to 2n - 1)."""
    def run(block, payload, got):
        key, keys, weights = gathered(got, 0, n), [], []
        for lang in Chunks(payload).langs.values():
            for k, _, h, w in grown(lang, key, longest):
                if k > 2:
                    keys.append(h)
                    weights.append(w)
        if keys:
            key, weight = added(np.concatenate(keys), np.concatenate(weights))
            for p, payload in dealt(key, n, weight):
                yield message(block, n + p, payload)

    return run


def phrases(n: int, longest: int):
    """The third message: the block's words and phrases whose hashes are frequent, as text with their counts, and as
    the empty phrase the number of words; a message a part, dealt by the hash."""
    def run(block, payload, got):
        key, longer = gathered(got, 0, n), gathered(got, n, 2 * n)
        langs, texts, lang_of, totals, dealt_by = [], [], [], [], []
        for lang, own in Chunks(payload).langs.items():
            packed_name, _, codes, _, weight = own
            name = words_unpacked(*packed_name)

            def add(text: list[bytes], total: np.ndarray, h: np.ndarray, lang: str = lang) -> None:
                texts.extend(text)
                lang_of.append(np.full(len(text), len(langs) - 1, np.int32))
                totals.append(total)
                dealt_by.append(part_of(h, n).astype(np.int64))

            langs.append(lang.encode())
            add([b""], np.array([weight.sum()]), np.zeros(1, np.uint64))
            place, ids, text = np.zeros(0, np.int64), np.zeros(0, np.int64), name
            for k, at, h, w in grown(own, key, longest, lambda h: member(longer, h)):
                if k == 1:
                    both = codes[at].astype(np.int64)
                else:  # the phrase before, and the next word: told apart by number, not by hash
                    both = ids[np.searchsorted(place, at)] * len(name) + codes[at + k - 1]
                distinct, first, ids = np.unique(both, return_index=True, return_inverse=True)
                text = [text[c // len(name)] + b" " + name[c % len(name)] for c in distinct.tolist()] if k > 1 else [name[c] for c in distinct.tolist()]
                place, total = at, weighted(ids, w, len(distinct))
                add(text, total, h[first])
        if not langs:
            return
        lang_of, totals, own = np.concatenate(lang_of), np.concatenate(totals), np.concatenate(dealt_by)
        by = np.argsort(own, kind="stable")
        edges = np.searchsorted(own[by], np.arange(n + 1))
        for p in np.unique(own).tolist():
            i = by[edges[p]:edges[p + 1]]
            yield message(block, p, packed(*words_packed(langs), lang_of[i], totals[i], *words_packed([texts[x] for x in i.tolist()])))

    return run


def counted(least: int):
    """(lang, phrase, n): the phrases of a part that occur ``least`` times in all blocks together, told apart as text."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def run(part, blocks, payloads):
        found: dict[bytes, dict[bytes, int]] = {}
        for payload in payloads:
            lang_sizes, lang_data, lang_of, total, sizes, data = unpacked(payload)
            own = [found.setdefault(lang, {}) for lang in words_unpacked(lang_sizes, lang_data)]
            for lang, text, n in zip(lang_of.tolist(), words_unpacked(sizes, data), total.tolist(), strict=True):
                counts = own[lang]
                counts[text] = counts.get(text, 0) + n
        for lang, counts in found.items():
            often = [(text, n) for text, n in counts.items() if n >= least or not text]
            for s in range(0, len(often), 1 << 17):
                text, n = zip(*often[s:s + (1 << 17)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang.decode()] * len(text), pa.string()), pa.array(text, pa.binary()).cast(pa.string()),
                                                  pa.array(n, pa.int64())], schema=schema)

    return run


def reported(blocks: DataFrame, answers: DataFrame, finish) -> DataFrame:
    """``finish(block, payload, {part: payload})`` yields messages for each block with its answers."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block,), t in sorted_groups(it, ["block"]):
            part, payload = t.column("part").to_pylist(), t.column("payload").to_pylist()
            yield from finish(int(block), payload[0], dict(zip(part[1:], payload[1:], strict=True)))

    both = blocks.unionByName(answers.select("block", "part", "payload"))
    return both.repartition(parts(blocks), "block").sortWithinPartitions("block", "part").mapInArrow(run, BLOCKS)


def added(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with sums of their weights."""
    by = np.argsort(key)
    key = key[by]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(weight[by], first)


def weighted(group: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by group."""
    out = np.zeros(n, np.int64)
    np.add.at(out, group, weight)
    return out


def phrase_counts(docs: DataFrame, least: int = MIN_COUNT, longest: int = LONGEST, period: int = PERIOD, gather: int = GATHER) -> DataFrame:
    """lang, phrase, n: all phrases of up to ``longest`` (at most 4) words that occur ``least`` times; the empty phrase counts all words."""
    if not 1 <= longest <= LONGEST:
        raise ValueError(f"phrases have 1 to {LONGEST} words")
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    chunks = rows.mapInArrow(parsed(period, gather), "lang string, text binary, follows boolean, freq long") \
        .groupBy("lang", "text", "follows").agg(F.sum("freq").alias("freq"))
    blocks = chunk_blocks(chunks, BLOCK_BYTES)
    n = max(parts(docs), blocks.count())
    pairs = saved(each_part(blocks.mapInArrow(ask(n), BLOCKS), frequent(least), BLOCKS, n), "phrase-pairs")
    longer = each_part(reported(blocks, pairs, ask_longer(n, longest)), frequent(least), BLOCKS, n)
    found = reported(blocks, pairs.unionByName(longer), phrases(n, longest))
    return saved(each_part(found, counted(least), "lang string, phrase string, n long", n), "phrase-counts")


def collocations(docs: DataFrame, least: int = MIN_COUNT, first: int = FIRST, inside: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases."""
    counts = phrase_counts(docs, least)
    known = counts.where("phrase <> ''")
    k = F.size(F.split("phrase", " "))
    candidates = known.withColumn("k", k).where("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"))
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = candidates.select("lang", "phrase", "a", cut).withColumn("head", F.expr("substring_index(phrase, ' ', cut)")) \
        .withColumn("tail", F.expr("substring(phrase, length(head) + 2)"))
    sides = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"]) \
        .join(known.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    wide = F.col("a").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(8,0)")
    score = F.expr("cast(wide div cast(l + r as decimal(20,0)) as long)")
    scored = sides.withColumn("wide", wide).withColumn("score", score).groupBy("lang", "phrase") \
        .agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("least"))
    # candidates that a longer one holds
    word = F.split("phrase", " ")
    held = candidates.where("k >= 3").withColumn("words", word) \
        .select("lang", "a", F.explode(F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(words, i, m), ' '))))")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("least.score"), F.desc("a"), "phrase")).cast("long")
    best = left.withColumn("rank", rank).where(F.col("rank") <= first)
    total = counts.where("phrase = ''").select("lang", "n")
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "least.l", "least.r", "n", "least.score")
