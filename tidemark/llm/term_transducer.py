"""Operator 11, source divergence audit with a vocabulary in minimal acyclic transducers.

Kept terms of a language (in enough of its documents) are sorted over the
cluster; each run of at most ``SHARD`` of them becomes a minimal acyclic
automaton, built from the sorted terms, whose arcs add up to a term's ordinal.
Ordinals of all terms of a language follow from the sizes of its shards.

The text is then streamed through the shards: a task counts the terms of its
texts for each language and source, sends each shard the sorted distinct terms
of its range, and the shard walks them through its automaton, which drops
what is not kept and sums up the rest by ordinal.  A common term is one entry
of each task's message.  Smoothed shares are compared shard by shard: pairs of
sources by the sum of differences, terms of a source by their surplus over the
language, ties by ordinal; the shard turns ordinals back into terms.  Small neighbouring shards are compared
together, so that pairs are summed up before they leave a task.

The driver holds one line a shard (first term, size).  A shard's task holds the
counts of its terms for all sources of the language.

All arithmetic is exact: floor(10^9 x / d) by long division in 64 bits, for d
below 9 * 10^15.

Defined cases: null text, language and source are empty strings; equal rows
count each; a (language, source) without terms has its rows of part ``pair``;
a language without kept terms has value 0 there; a single source has none;
empty table: no rows; columns besides text, lang and source are not read.
"""

from __future__ import annotations

import bisect
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCKS, packed, unpacked
from .byte_bpe import message, words_packed, words_unpacked
from .common import bounded_batches, parts, saved, sorted_groups

#: A term as bytes of UTF-8: ASCII letters and all that is not ASCII.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
MIN_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
#: Terms of one transducer.
SHARD = 1 << 14
#: Entries of a task's counter between two messages.
ENTRIES = 1 << 19
#: Cells (sources x terms) that are compared at once.
CELLS = 1 << 20


def terms_of(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())  # of bytes: A-Z only


class Transducer:
    """Minimal acyclic automaton of sorted distinct terms; ``ordinal`` and ``term`` are each other's inverse."""

    def __init__(self, states: list[tuple[bool, tuple]]):
        self.states = states
        count: list[int] = []
        self.arcs: list[dict[int, tuple[int, int]]] = []
        for final, arcs in states:  # targets come before their sources
            at, own = int(final), {}
            for label, target in arcs:
                own[label] = (target, at)
                at += count[target]
            count.append(at)
            self.arcs.append(own)
        self.root, self.size = len(states) - 1, count[-1]

    @classmethod
    def build(cls, terms) -> Transducer:
        known: dict[tuple, int] = {}
        states: list[tuple] = []
        path: list[list] = [[False, []]]
        before = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                path[-1][1].append((before[len(path) - 1], number((final, tuple(arcs)))))

        def number(state: tuple) -> int:
            if state not in known:
                known[state] = len(states)
                states.append(state)
            return known[state]

        for term in terms:
            same = 0
            while same < len(before) and same < len(term) and before[same] == term[same]:
                same += 1
            close(same)
            path.extend([False, []] for _ in range(len(term) - same))
            path[-1][0] = True
            before = term
        close(0)
        states.append((path[0][0], tuple(path[0][1])))
        return cls(states)

    def ordinal(self, term: bytes) -> int:
        """Number of smaller terms; -1 for what is no term."""
        arcs, state, at = self.arcs, self.root, 0
        for b in term:
            step = arcs[state].get(b)
            if step is None:
                return -1
            state, more = step
            at += more
        return at if self.states[state][0] else -1

    def term(self, ordinal: int) -> bytes:
        state, out = self.root, bytearray()
        while True:
            final, arcs = self.states[state]
            if final and ordinal == 0:
                return bytes(out)
            label, (target, more) = max((x for x in self.arcs[state].items() if x[1][1] <= ordinal), key=lambda x: x[1][1])
            out.append(label)
            state, ordinal = target, ordinal - more

    def dump(self) -> bytes:
        arcs = [a for _, own in self.states for a in own]
        return packed(np.array([f for f, _ in self.states], np.uint8), np.array([len(a) for _, a in self.states], np.int32),
                      np.array([a for a, _ in arcs], np.uint8), np.array([t for _, t in arcs], np.int32))

    @classmethod
    def load(cls, data: bytes) -> Transducer:
        final, count, label, target = (a.tolist() for a in unpacked(data))
        states, at = [], 0
        for f, n in zip(final, count, strict=True):
            states.append((bool(f), tuple(zip(label[at:at + n], target[at:at + n], strict=True))))
            at += n
        return cls(states)


def share(count: np.ndarray, total, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), exact."""
    whole = np.asarray(total, np.int64) + SMOOTH * terms
    out, rest = np.divmod(count.astype(np.int64) + SMOOTH, whole)
    for _ in range(3):  # SCALE is 1000 ** 3
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def text_rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, bytes]]:
    for b in it:
        cols = [b.column(i).to_pylist() for i in range(3)]
        for lang, source, text in zip(*cols, strict=True):
            yield lang, source, text


def document_counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, documents) of a task's texts."""
    seen: dict[str, Counter] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for lang, own in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()),
                                              pa.array(list(own.values()), pa.int64())], names=["lang", "term", "n"])

    size = 0
    for lang, _, text in text_rows(it):
        own = seen.setdefault(lang, Counter())
        size -= len(own)
        own.update(set(terms_of(text)))
        size += len(own)
        if size >= ENTRIES:
            yield from flushed()
            seen, size = {}, 0
    yield from flushed()


def transducers(most: int):
    """Runs of sorted (lang, term) rows as automata, with the first and last term."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def flushed():
            row = (now, held[0], held[-1], len(held), Transducer.build(held).dump())
            kinds = (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)],
                                              names=["lang", "first", "last", "size", "automaton"])

        for b in it:
            for lang, term in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and (lang != now or len(held) >= most):
                    yield flushed()
                    held = []
                now = lang
                held.append(term)
        if held:
            yield flushed()

    return run


def term_messages(firsts: dict[str, list[bytes]], numbers: dict[str, list[int]]):
    """A task's term counts, sorted, as messages (block, part = shard, payload)."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict[str, Counter]] = {}
        block = TaskContext.get().partitionId() << 24

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, sources in seen.items():
                names = list(sources)
                terms = sorted(set().union(*sources.values()))
                place = {t: i for i, t in enumerate(terms)}
                at = np.array([place[t] for own in sources.values() for t in own], np.int64)
                of = np.repeat(np.arange(len(names)), [len(own) for own in sources.values()])
                n = np.array([x for own in sources.values() for x in own.values()], np.int64)
                by = np.argsort(at, kind="stable")
                at, of, n = at[by], of[by], n[by]
                edges = [bisect.bisect_left(terms, f) for f in firsts[lang]] + [len(terms)]
                cuts = np.searchsorted(at, edges)
                head = np.frombuffer(json.dumps(names).encode(), np.uint8)
                for s, part in enumerate(numbers[lang]):
                    a, z, mine = edges[s], edges[s + 1], slice(cuts[s], cuts[s + 1])
                    if z > a:
                        yield message(block, part, packed(head, *words_packed(terms[a:z]), (at[mine] - a).astype(np.int32), of[mine].astype(np.int32), n[mine]))

        size = 0
        for lang, source, text in text_rows(it):
            if lang not in firsts:
                continue
            own = seen.setdefault(lang, {}).setdefault(source, Counter())
            size -= len(own)
            own.update(terms_of(text))
            size += len(own)
            if size >= ENTRIES:
                yield from flushed()
                seen, size, block = {}, 0, block + 1
        yield from flushed()

    return run


def recounted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's automaton (block -1) and its messages: counts by ordinal for each source, and their total."""
    for (part,), t in sorted_groups(it, ["part"]):
        words = Transducer.load(t.column("payload")[0].as_py())
        held: dict[str, list] = {}

        def folded(name: str) -> tuple[np.ndarray, np.ndarray]:
            at, n = (np.concatenate(x) for x in zip(*held[name], strict=True))
            key, inverse = np.unique(at, return_inverse=True)
            out = np.zeros(len(key), np.int64)
            np.add.at(out, inverse, n)
            return key, out

        for row in range(1, t.num_rows):
            sources, sizes, data, term, source, count = unpacked(t.column("payload")[row].as_py())
            ordinal = np.array([words.ordinal(w) for w in words_unpacked(sizes, data)], np.int32)[term]
            for i, name in enumerate(json.loads(sources.tobytes())):
                mine = (source == i) & (ordinal >= 0)
                if mine.any():
                    held.setdefault(name, []).append((ordinal[mine], count[mine]))
                    if len(held[name]) > 64:
                        held[name] = [folded(name)]
        for name in sorted(held):
            at, n = folded(name)
            yield pa.RecordBatch.from_arrays([pa.array([int(part)], pa.int32()), pa.array([name], pa.string()), pa.array([int(n.sum())], pa.int64()),
                                              pa.array([packed(at.astype(np.int32), n)], pa.binary())], names=["part", "source", "total", "counts"])


def compared(shards: dict[int, tuple[str, int, int]], top: int):
    """Sums of differences of pairs of sources, and the leading terms of each source, of a unit of shards.
    shards: language, first ordinal and number of terms of the language."""
    names = ["lang", "source", "part", "item", "value", "ordinal"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def leading(rows: list[tuple]) -> list[tuple]:
        return sorted(rows, key=lambda x: (-x[0], x[1]))[:top]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lang, source, apart, best = None, "", [], None, []

        def result() -> Iterator[pa.RecordBatch]:
            for i, name in enumerate(source):
                out = [(lang, name, "pair", other, int(apart[i, j]), None) for j, other in enumerate(source) if j != i]
                out += [(lang, name, "term", term, f, ordinal) for f, ordinal, term in best[i]]
                if out:
                    yield batch(out)

        for (unit, part), t in sorted_groups(it, ["unit", "part"]):
            rows = t.slice(1)  # the first row is the automaton
            if unit != now:
                if now is not None:
                    yield from result()
                now, lang, source = unit, shards[int(part)][0], rows.column("source").to_pylist()
                apart, best = np.zeros((len(source), len(source)), np.int64), [[] for _ in source]
            _, base, terms = shards[int(part)]
            words = Transducer.load(t.column("counts")[0].as_py())
            total = rows.column("total").to_numpy()
            counts = [unpacked(c) if c else (np.zeros(0, np.int32), np.zeros(0, np.int64)) for c in rows.column("counts").to_pylist()]
            step = max(1, CELLS // len(source))
            for a in range(0, words.size, step):
                z = min(words.size, a + step)
                c = np.zeros((len(source), z - a), np.int64)
                for i, (at, n) in enumerate(counts):
                    mine = slice(*np.searchsorted(at, [a, z]))
                    c[i, at[mine] - a] = n[mine]
                p = share(c, total[:, None], terms)
                q = share(c.sum(axis=0), total.sum(), terms)
                for i in range(len(source)):
                    apart[i] += np.abs(p - p[i]).sum(axis=1)
                    more = np.flatnonzero((c[i] > 0) & (p[i] > q))
                    first = more[np.argsort(-(p[i] - q)[more], kind="stable")[:top]]
                    best[i] = leading(best[i] + [(int(p[i][o] - q[o]), base + a + o, words.term(a + o).decode()) for o in first.tolist()])
        if now is not None:
            yield from result()

    return run


def divergence_audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank, ordinal (of a term, in its language's sorted vocabulary)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
                       F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    groups = rows.select("lang", "source").distinct()
    n = parts(docs)
    kept = rows.mapInArrow(document_counts, "lang string, term binary, n long").groupBy("lang", "term").agg(F.sum("n").alias("n")) \
        .where(F.col("n") >= min_docs).select("lang", "term")
    words = saved(saved(kept, "audit-kept").repartitionByRange(n, "lang", "term").sortWithinPartitions("lang", "term")
                  .mapInArrow(transducers(shard), "lang string, first binary, last binary, size long, automaton binary"), "audit-transducers")
    lines = sorted((r.lang, bytes(r.first), r.size) for r in words.select("lang", "first", "size").toLocalIterator())  # one a shard
    terms: Counter = Counter()
    firsts, numbers, at, units = {}, {}, [], []
    held = shard
    for number, (lang, first, size) in enumerate(lines):
        if held >= shard or lang not in firsts:  # small neighbouring shards are compared together
            held = 0
        units.append(number if held == 0 else units[-1])
        held += size
        firsts.setdefault(lang, []).append(first)
        numbers.setdefault(lang, []).append(number)
        at.append((lang, terms[lang]))
        terms[lang] += size
    shards = {i: (lang, base, terms[lang]) for i, (lang, base) in enumerate(at)}
    numbered = spark.createDataFrame([(i, u, lang, first) for i, (u, (lang, first, _)) in enumerate(zip(units, lines, strict=True))],
                                     "part int, unit int, lang string, first binary")
    automata = words.join(numbered, ["lang", "first"]).select("part", "unit", "automaton")
    n = max(n, len(lines))

    sent = rows.mapInArrow(term_messages(firsts, numbers), BLOCKS)
    both = sent.unionByName(automata.select(F.lit(-1).cast("long").alias("block"), "part", F.col("automaton").alias("payload")))
    counts = saved(both.repartition(n, "part").sortWithinPartitions("part", "block")
                   .mapInArrow(recounted, "part int, source string, total long, counts binary"), "audit-counts")

    totals = groups.join(counts.join(numbered.select("part", "lang"), "part").groupBy("lang", "source").agg(F.sum("total").alias("total")),
                         ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    totals = saved(totals, "audit-totals")
    cells = totals.join(numbered.select("part", "unit", "lang"), "lang").join(counts.select("part", "source", "counts"), ["part", "source"], "left")
    first = automata.select("unit", "part", F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("total"), F.col("automaton").alias("counts"))
    found = cells.select("unit", "part", "source", "total", "counts").unionByName(first).repartition(n, "unit").sortWithinPartitions("unit", "part", F.col("source").asc_nulls_first()) \
        .mapInArrow(compared(shards, top), "lang string, source string, part string, item string, value long, ordinal long")
    found = saved(found, "audit-found")

    bare = totals.where(~F.col("lang").isin(list(terms))) if terms else totals  # languages without kept terms
    zero = bare.select("lang", "source").join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) \
        .unionByName(zero.select("lang", "source", "item", F.lit(0).cast("long").alias("value")))
    by = Window.partitionBy("lang", "source")
    pairs = pairs.withColumn("rank", F.row_number().over(by.orderBy(F.desc("value"), "item"))).withColumn("ordinal", F.lit(None).cast("long"))
    leading = found.where("part = 'term'").withColumn("rank", F.row_number().over(by.orderBy(F.desc("value"), "ordinal"))).where(F.col("rank") <= top)
    names = ["lang", "source", "part", "item", "value", "rank", "ordinal"]
    return pairs.withColumn("part", F.lit("pair")).select(*names).unionByName(leading.select(*names))
