"""Operator 8, LM scoring: context-tree weighting over bytes.

A byte is eight binary decisions; each of the 255 decision nodes has a tree of
contexts (the bytes before it, the nearest first, up to ``DEPTH``).  A context
holds a Krichevsky-Trofimov estimate of its decision; the weighted probability
of a context is half its own block probability plus half the product of its
children's.  After training, a context's share of the weight is fixed by these
two, and the probability of a decision mixes the estimates of all depths along
its path.  A text's code length is the sum over its bytes and an end symbol.

Texts are read as blocks (see blocks.py).  A block asks for its distinct byte
windows, keyed by context (nearest byte first), and says how often training
texts of the block have them.  Parts hold whole subtrees of depth two and
below; the two upper levels (at most 256 contexts of 255 nodes) are summed up
from the parts.  Word counts of the base score travel the same way.

Texts are lower-cased (A-Z only) for both scores.  Defined cases: null text is
empty: no word, its end token only; equal rows are scored alike and counted
each; a text's length has no limit; no training text: every decision has
probability 1/2 (an untrained tree); empty table: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import (Lookup, answered, asked, blocks_of, chunks, dealt, each_part, packed_keys, summed, text_buffer,
                     unpacked_keys)
from .common import MULT, crc_of_id, mix, parts, record, saved, word_hash

DEPTH = 5
FOLDS = 10
#: Never a byte of UTF-8: stands before a text and after it.
EDGE = 0xFF
LN2 = math.log(2.0)


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x > 0: Stirling's series, after moving small values up by eight."""
    x = np.asarray(x, np.float64)
    small = x < 8
    y = np.where(small, x + 8, x)
    r = 1 / y
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + r * (1 / 12 - r * r * (1 / 360 - r * r * (1 / 1260 - r * r / 1680)))
    if small.any():
        z, move = x[small], np.ones(int(small.sum()))
        for i in range(8):
            move *= z + i
        out[small] -= np.log(move)
    return out


def kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the KT block probability of a zeros and b ones."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - math.log(math.pi) - lgamma(a + b + 1.0)


def lowered(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out


def all_windows(data: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """Keys of every byte and of the end of each text, in order: the context, nearest byte
    first, then the byte."""
    lengths = np.diff(offsets)
    doc = np.arange(len(lengths))
    padded = np.full(len(data) + len(lengths) * (depth + 1) + depth, EDGE, np.uint8)
    padded[np.arange(len(data)) + np.repeat(doc * (depth + 1) + depth, lengths)] = data
    n = len(padded) - depth
    key = np.zeros(n, np.uint64)
    for i in range(1, depth + 1):
        key <<= np.uint64(8)
        key |= padded[depth - i:depth - i + n]
    key <<= np.uint64(8)
    key |= padded[depth:]
    return key[np.arange(len(data) + len(lengths)) + np.repeat(doc * depth, lengths + 1)]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and the text of each."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[offsets < len(data)]] = True
    word = ~blank
    starts = np.flatnonzero(word & (edge[:-1] | np.r_[True, blank[:-1]])) if len(data) else np.zeros(0, np.int64)
    stop = np.flatnonzero(word & np.r_[edge[1:-1] | blank[1:], True]) + 1 if len(data) else np.zeros(0, np.int64)
    return word_hash(data, starts, stop) & ~np.uint64(1), np.searchsorted(offsets, starts, "right") - 1


#: The key of the end token (word keys are even: the last bit of a counted key says "training").
END = mix(np.array([MULT], np.uint64))[0] & ~np.uint64(1)


def counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often training texts have them; keys are even."""
    both = np.sort(keys | train)
    at = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
    times = np.diff(np.r_[at, len(both)])
    return summed(both[at] & ~np.uint64(1), np.where(both[at] & np.uint64(1), times, 0))


def distinct(table: pa.Table, depth: int):
    """A block's distinct windows and words with their counts in training texts."""
    data, offsets = text_buffer(table.column("text"))
    data = lowered(data)
    train = (~table.column("held_out").to_numpy()).astype(np.uint64)
    found: list[list] = [[], []]
    for a, z in chunks(offsets):
        own, at = data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a]
        learn = train[a:z]
        found[0].append(counted(all_windows(own, at, depth) << np.uint64(1), np.repeat(learn, np.diff(at) + 1)))
        h, doc = words(own, at)
        found[1].append(counted(np.r_[h, np.full(z - a, END)], np.r_[learn[doc], learn]))
    (key, count), word = (summed(np.concatenate([k for k, _ in x]), np.concatenate([v for _, v in x])) for x in found)
    return (key >> np.uint64(1), count), word


def window_part(keys: np.ndarray, depth: int, n: int) -> np.ndarray:
    """Windows of one nearest pair of context bytes stay together."""
    with np.errstate(over="ignore"):
        return (mix((keys >> np.uint64(8 * (depth - 1))) + np.uint64(1)) % np.uint64(n)).astype(np.int64)


def ask(depth: int, n: int):
    """Messages of a block: parts 0..n-1 get windows, n..2n-1 words."""
    def run(table):
        (key, count), (word, times) = distinct(table, depth)
        own = window_part(key, depth, n)
        for p in range(n):
            mine = own == p
            if mine.any():
                yield p, packed_keys(key[mine], count[mine])
        for p, message in dealt(word, n, times):
            yield n + p, message

    return run


class Tree:
    """The context subtree of a part: for each depth and decision level, nodes (context, decision) with
    counts of zeros and ones and the ln of their weighted probability."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int = 2):
        self.depth, self.top, self.nodes = depth, top, {}
        keys, counts = keys[counts > 0], counts[counts > 0]
        x = keys & np.uint64(0xFF)
        below = None
        for d in range(depth, top - 1, -1):
            context = keys >> np.uint64(8 * (depth + 1 - d))
            symbol, n = summed((context << np.uint64(8)) | x, counts)
            level = [self._level(symbol, n, j) for j in range(8)]
            for j, (node, a, b) in enumerate(level):
                weighted = kt(a, b)
                if below is not None:
                    child, _, _, inner = below[j]
                    parent = ((child >> np.uint64(16)) << np.uint64(8)) | (child & np.uint64(0xFF))
                    product = np.bincount(np.searchsorted(node, parent), weights=inner, minlength=len(node))
                    weighted = np.logaddexp(weighted, product) - LN2
                level[j] = (node, a, b, weighted)
            below = self.nodes[d] = level

    @staticmethod
    def _level(symbol, n, j):
        """Nodes of the j-th decision from sorted (context, byte) counts."""
        byte = symbol & np.uint64(0xFF)
        node = ((symbol >> np.uint64(8)) << np.uint64(8)) | (np.uint64(1 << j) | (byte >> np.uint64(8 - j)))
        at = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
        one = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
        sums = [np.add.reduceat(np.where(m, n, 0), at).astype(np.float64) if len(at) else np.zeros(0) for m in (~one, one)]
        return node[at], sums[0], sums[1]

    def mixed(self, keys: np.ndarray) -> np.ndarray:
        """Probability of each of the eight decisions of the keys' bytes, as seen from depth ``top``."""
        x = keys & np.uint64(0xFF)
        out = np.full((8, len(keys)), 0.5)
        for d in range(self.depth, self.top - 1, -1):
            context = keys >> np.uint64(8 * (self.depth + 1 - d))
            for j in range(8):
                node, a, b, weighted = self.nodes[d][j]
                if not len(node):
                    continue
                want = (context << np.uint64(8)) | np.uint64(1 << j) | (x >> np.uint64(8 - j))
                at = np.minimum(np.searchsorted(node, want), len(node) - 1)
                hit = node[at] == want
                one = ((x >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
                own = (np.where(one, b[at], a[at]) + 0.5) / (a[at] + b[at] + 1.0)
                share = np.ones(len(at)) if d == self.depth else np.exp(kt_of(node, a, b, at) - LN2 - weighted[at])
                out[j] = np.where(hit, share * own + (1 - share) * out[j], 0.5)
        return out


def kt_of(node, a, b, at):
    return kt(a, b)[at] if len(node) < len(at) else kt(a[at], b[at])


def upper(rows: np.ndarray, depth: int) -> list[np.ndarray]:
    """The tables of depth 1 and 0 from those of depth 2: [zeros, ones, share] by (nearest byte, decision) and by decision.
    rows: nearest byte, decision, zeros, ones, ln weighted probability, already summed over the second byte."""
    first = np.zeros((3, 256, 256))
    c, q = rows[:, 0].astype(int), rows[:, 1].astype(int)
    first[0, c, q], first[1, c, q] = rows[:, 2], rows[:, 3]
    product = np.zeros((256, 256))
    product[c, q] = rows[:, 4]
    own = kt(first[0], first[1])
    weighted = np.logaddexp(own, product) - LN2
    first[2] = np.exp(own - LN2 - weighted)
    root = np.zeros((3, 256))
    root[0], root[1] = first[0].sum(0), first[1].sum(0)
    own = kt(root[0], root[1])
    seen = (first[0] + first[1]) > 0
    root[2] = np.exp(own - LN2 - (np.logaddexp(own, np.where(seen, weighted, 0).sum(0)) - LN2))
    return [first, root]


def merged(payloads: list[bytes]) -> tuple[list, np.ndarray, np.ndarray]:
    asks = [unpacked_keys(p) for p in payloads]
    return asks, *summed(np.concatenate([k for k, _ in asks]), np.concatenate([c for _, c in asks]))


def learn(depth: int, n: int):
    """What a part tells of its subtrees: rows (kind, byte, decision, zeros, ones, ln weighted)."""
    schema = pa.schema([("kind", pa.int32()), ("byte", pa.int32()), ("node", pa.int32()), ("zeros", pa.float64()),
                        ("ones", pa.float64()), ("weighted", pa.float64())])

    def run(part, blocks, payloads):
        _, keys, counts = merged(payloads)
        if part >= n:  # words: their number and how many are known
            yield record(schema, kind=[1], byte=[0], node=[0], zeros=[float(counts.sum())], ones=[float((counts > 0).sum())], weighted=[0.0])
            return
        for node, a, b, weighted in Tree(keys, counts, depth).nodes[2]:
            yield record(schema, kind=np.zeros(len(node), np.int32), byte=(node >> np.uint64(16)).astype(np.int32),
                         node=(node & np.uint64(0xFF)).astype(np.int32), zeros=a, ones=b, weighted=weighted)

    return run


def reply(depth: int, n: int, tables):
    """Answers of a part: ln probabilities of the windows asked for, or training counts of the words."""
    first, root = tables

    def run(part, blocks, payloads):
        asks, keys, counts = merged(payloads)
        if part < n:
            x, c = (keys & np.uint64(0xFF)).astype(int), (keys >> np.uint64(8 * depth)).astype(int)
            p = Tree(keys, counts, depth).mixed(keys)
            total = np.zeros(len(keys))
            for j in range(8):
                q, one = (1 << j) | (x >> (8 - j)), (x >> (7 - j)) & 1
                for table, where in ((first, (c, q)), (root, (q,))):
                    a, b = table[0][where], table[1][where]
                    own = (np.where(one == 1, b, a) + 0.5) / (a + b + 1.0)
                    seen = (a + b) > 0
                    p[j] = np.where(seen, table[2][where] * own + (1 - table[2][where]) * p[j], 0.5)
                total += np.log(p[j])
            values = total.astype(np.float32)
        else:
            values = counts
        for block, (own, _) in zip(blocks, asks, strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([packed_keys(own, values[np.searchsorted(keys, own)])], pa.binary())],
                names=["block", "part", "payload"])

    return run


def finish(depth: int, n: int, n_train: int, n_types: int):
    """Scores of a block's texts from its answers."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
                        ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(block, table, got):
        found = [[unpacked_keys(m) for p, m in got.items() if (p >= n) == of_words] for of_words in (False, True)]
        ln, times = (Lookup(*(np.concatenate([x[i] for x in side]) for i in (0, 1))) for side in found)
        data, offsets = text_buffer(table.column("text"))
        data, n_docs = lowered(data), len(offsets) - 1
        out = np.zeros((4, n_docs))
        for a, z in chunks(offsets):
            text, at = data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a]
            values = ln.of(all_windows(text, at, depth)).astype(np.float64)
            out[0, a:z] = np.add.reduceat(values, at[:-1] + np.arange(z - a))
            h, doc = words(text, at)
            h, doc = np.r_[h, np.full(z - a, END)], np.r_[doc, np.arange(z - a)]
            c = times.of(h)
            out[1, a:z] = np.bincount(doc, minlength=z - a)
            out[2, a:z] = np.bincount(doc, weights=c > 0, minlength=z - a)
            out[3, a:z] = np.bincount(doc, weights=np.log10((c + 0.1) / (n_train + 0.1 * (n_types + 1))), minlength=z - a)
        yield record(schema, doc_id=table.column("doc_id").combine_chunks(), held_out=table.column("held_out").combine_chunks(),
                     n_bytes=np.diff(offsets), n_tokens=out[1].astype(np.int64), n_known=out[2].astype(np.int64),
                     base_score=out[3], score=out[0] / math.log(10))

    return run


def ctw_score(docs: DataFrame, depth: int = DEPTH, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte;
    learns from rows whose crc32(id) mod ``folds`` is not 0.  ``depth``: 2 to 6."""
    n = parts(docs)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_of_id() % folds == 0).alias("held_out"), "text")
    blocks = blocks_of(kept, "ctw-blocks")
    messages = saved(asked(blocks, ask(depth, n)), "ctw-asks")
    told = saved(each_part(messages, learn(depth, n), "kind int, byte int, node int, zeros double, ones double, weighted double", 2 * n), "ctw-top")
    n_train, n_types = told.where("kind = 1").agg(F.coalesce(F.sum("zeros"), F.lit(0)), F.coalesce(F.sum("ones"), F.lit(0))).first()
    # at most 256 * 255 rows: the nearest byte and the decision
    rows = told.where("kind = 0").groupBy("byte", "node").agg(F.sum("zeros"), F.sum("ones"), F.sum("weighted")).orderBy("byte", "node").toPandas()
    tables = upper(rows.to_numpy(np.float64).reshape(-1, 5), depth)
    answers = each_part(messages, reply(depth, n, tables), "block long, part int, payload binary", 2 * n)
    scored = answered(blocks, answers, finish(depth, n, int(n_train), int(n_types)),
                      "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n_train)).cast("long").alias("train_tokens"),
                         "base_score", "score", "n_bytes",
                         (-F.col("score") / F.lit(math.log10(2)) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"))
