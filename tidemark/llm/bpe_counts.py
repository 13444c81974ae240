"""Operator 3, token counts: rank-synchronous array merging.

Texts are cut into pre-tokens (a run of blanks with the word after it; nothing
in the vocabulary crosses such a border), and each distinct pre-token of a
batch is tokenised once.  The pre-tokens are held as one ragged array of
symbols; in every round each of them applies its pair of lowest rank, the
leftmost of equals, all at the same time; a pre-token without a known pair is
ready and leaves.  The symbols that survive are counted: one a vocabulary
piece, one a byte of a character that the vocabulary lacks.

Only the vocabulary is taken from the model file.  Pre-tokens of more than
LONG symbols (texts without blanks) merge through a heap in the same order.

Defined cases: null and empty texts have 0 tokens; strings of special tokens
inside a text are ordinary text; equal rows are counted alike.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, bounded_batches, record

LIMIT = 4096
#: Symbols from which a pre-token merges through a heap.
LONG = 512
#: Distinct pre-tokens remembered by a task; a full memory is emptied.
REMEMBERED = 400_000
#: Characters of text that are cut into words at once.
CHUNK = 1 << 20
BLANK = "▁"
NONE = np.int64(1 << 40)


class Merger:
    """Vocabulary of a sentencepiece BPE model as sorted arrays of pairs."""

    def __init__(self, model_path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        usable = [i for i in range(model.get_piece_size())
                  if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        score = {model.id_to_piece(i): model.get_score(i) for i in usable}
        self.ids = {p: n for n, p in enumerate(score)}
        singles = {c for p in score for c in p} - self.ids.keys()
        self.cost = [1] * len(self.ids) + [len(c.encode()) for c in sorted(singles)]
        for c in sorted(singles):
            self.ids[c] = len(self.ids)
        rank = {s: n for n, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = []
        for piece, s in score.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    pairs.append((a << 32 | b, rank[s], self.ids[piece]))
        self.pair, self.rank, self.out = (np.array(x, np.int64) for x in zip(*sorted(pairs), strict=True))
        #: characters that never stand beside another one in a piece
        together = {c for p in score if len(p) > 1 for c in p}
        self.newline_apart = "\n" not in together
        self.newline = self.alone("\n")
        self.spaces = {}  # tokens of BLANK + word
        self.known: dict = {}
        self.bare = {}  # tokens of a word at the start of a line but the first

    def alone(self, c: str) -> int:
        return self.cost[self.ids[c]] if c in self.ids else len(c.encode())

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and outcome of pairs; unknown pairs and unknown characters (-1) have rank NONE."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        known = (self.pair[at] == key) & (a >= 0) & (b >= 0)
        return np.where(known, self.rank[at], NONE), self.out[at]

    def counts(self, tokens: list[str]) -> np.ndarray:
        """Surviving symbols of each pre-token."""
        total = np.zeros(len(tokens), np.int64)
        code = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        chars, which = np.unique(code, return_inverse=True)
        ids = np.array([self.ids.get(chr(c), -1) for c in chars], np.int64)
        cost = np.array([self.alone(chr(c)) for c in chars], np.int64)
        sym = ids[which]
        seq = np.repeat(np.arange(len(tokens)), lengths)
        unknown = sym < 0
        total += np.bincount(seq[unknown], weights=cost[which][unknown], minlength=len(total)).astype(np.int64)
        costs = np.array([*self.cost, 0], np.int64)  # the last is for -1, counted above
        long = lengths > LONG
        for t in np.flatnonzero(long):
            total[t] += costs[self.heap(sym[seq == t])].sum()
        use = ~long[seq]
        sym, seq = sym[use], seq[use]
        rank, out = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        if len(sym):
            rank[:-1], out[:-1] = self.lookup(sym[:-1], sym[1:])
            rank[:-1][seq[1:] != seq[:-1]] = NONE
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(seq)]))
            ready = least == NONE
            if ready.any():
                total += np.bincount(seq[ready], weights=costs[sym[ready]], minlength=len(total)).astype(np.int64)
                sym, seq, rank, out, least = (x[~ready] for x in (sym, seq, rank, out, least))
                if not len(sym):
                    break
            best = np.flatnonzero(rank == least)
            best = best[np.r_[True, seq[best][1:] != seq[best][:-1]]]  # the leftmost of each pre-token
            sym[best] = out[best]
            keep = np.ones(len(sym), bool)
            keep[best + 1] = False
            best = (np.cumsum(keep) - 1)[best]
            sym, seq, rank, out = sym[keep], seq[keep], rank[keep], out[keep]
            for left in (best, best[best > 0] - 1):  # the pairs that have changed
                right = np.minimum(left + 1, len(sym) - 1)
                r, o = self.lookup(sym[left], sym[right])
                rank[left] = np.where((seq[left] == seq[right]) & (right > left), r, NONE)
                out[left] = o
        return total

    def heap(self, sym: np.ndarray) -> list[int]:
        """The same merges of one long sequence, by a heap of (rank, place)."""
        sym, n = sym.tolist(), len(sym)
        if not self.known:
            self.known = {k: (r, o) for k, r, o in zip(self.pair.tolist(), self.rank.tolist(), self.out.tolist(), strict=True)}
        known = self.known
        left, right, live = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        queue: list[tuple] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and sym[i] >= 0 and sym[j] >= 0 and (found := known.get(sym[i] << 32 | sym[j])):
                heapq.heappush(queue, (found[0], i, sym[i], sym[j], found[1]))

        for i in range(n):
            offer(i)
        while queue:
            _, i, a, b, o = heapq.heappop(queue)
            j = right[i] if live[i] else n
            if j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], live[j], right[i] = o, False, right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [s for s, x in zip(sym, live, strict=True) if x]

    def learn(self, words: set[str], memory: dict, before: str) -> None:
        new = list(words.difference(memory))
        if new:
            memory.update(zip(new, self.counts([before + w for w in new]).tolist(), strict=True))

    def texts(self, texts: list[str]) -> list[int]:
        """Token counts of whole texts."""
        cut, spaced, bare = [], set(), set()
        for text in texts:
            lines = (text.split("\n") if self.newline_apart else [text]) if text else []
            extra, own = max(0, len(lines) - 1) * self.newline, []
            for n, line in enumerate(lines):
                if BLANK in line or "  " in line or line[:1] == " " or line[-1:] == " ":
                    line = line.replace(" ", BLANK)
                    found = re.findall(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", BLANK + line if n == 0 else line)
                    heads, own_bare = [t[1:] for t in found if t[0] == BLANK], [t for t in found if t[0] != BLANK]
                else:
                    heads = line.split(" ")
                    own_bare = [heads.pop(0)] if n else []
                spaced.update(heads)
                bare.update(own_bare)
                own.append((heads, own_bare))
            cut.append((extra, own))
        for memory in (self.spaces, self.bare):
            if len(memory) > REMEMBERED:
                memory.clear()
        self.learn(spaced, self.spaces, BLANK)
        self.learn(bare, self.bare, "")
        spaces, plain = self.spaces.__getitem__, self.bare.__getitem__
        return [extra + sum(sum(map(spaces, a)) + sum(map(plain, b)) for a, b in own) for extra, own in cut]


def bpe_counts(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row.  ``model_path`` is a sentencepiece
    BPE model, at the same place on every worker."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = None
        for b in batches(it):
            merger = merger or Merger(model_path)
            texts = [t or "" for t in b["text"].to_pylist()]
            tokens, a = [], 0
            while a < len(texts):
                z, size = a + 1, len(texts[a])
                while z < len(texts) and size + len(texts[z]) <= CHUNK:
                    size, z = size + len(texts[z]), z + 1
                tokens += merger.texts(texts[a:z])
                a = z
            yield record(schema, doc_id=b["doc_id"], n_bytes=[len(t.encode()) for t in texts], n_tokens=tokens,
                         over_limit=[n > limit for n in tokens])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
