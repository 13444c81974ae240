"""Operator 7, suffix-array dedup: a logarithmic family of indexes.

Removes every byte that a 50-byte string covers which also starts in a text
with a smaller id.

The suffixes of all texts, cut at 50 bytes, are dealt to parts by the smallest
hash of their 16-byte pieces.  Equal strings have equal pieces, so they meet in
one part, and neighbouring suffixes mostly share the piece, so a run of
suffixes travels as its bytes.  Within a part, suffixes come in batches of
ascending id: a batch gets its suffix array, is scanned against the arrays of
all levels for equal strings of a smaller id, and becomes a level itself;
levels of about equal size merge, so there are only logarithmically many.

Two rounds keep the messages small: the first only asks which pieces stand in
more than one text (and which texts are copies of whole texts), the second
sends suffixes with such pieces, each string at most once a block of texts; a
passage that stands in a third of all texts is thus one entry a block.

Suffixes are ordered by a 64-bit hash of their 50 bytes (any order that brings
equal strings together serves the scan); every match is then compared byte by
byte; copies of whole texts are told by 128 bits of their SHA-256.

Defined cases: null and empty texts have no bytes; texts below 50 bytes lose
nothing; equal ids are not smaller than each other, and null ids are not
smaller than any; empty table: no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import answered, asked, blocks_of, chunks, dealt, each_part, packed, part_of, text_buffer, unpacked, unpacked_keys
from .common import INVERSE, free_name, mix, parts, powers, record, saved

LENGTH = 50
PIECE = 16
#: Bytes of text in one block.
BLOCK_BYTES = 6 << 20
#: Suffixes of one batch.
BATCH = 1 << 18
NO_ID = np.int64(2**63 - 1)
#: Matches that are compared byte by byte at once.
COMPARED = 1 << 16


def rolled(data: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of all runs of ``length`` bytes."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=run[1:])
        return mix((run[length:] - run[:n]) * powers(n, INVERSE))


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    done, m = 1, h
    while done * 2 <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    return np.minimum(m[:len(m) - (width - done)], m[width - done:]) if width > done else m


def suffixes(data: np.ndarray, offsets: np.ndarray, length: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where a string of ``length`` bytes starts within one text, their texts, and their smallest piece."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = least_of(rolled(data, piece), length - piece + 1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(least)]
    fits = np.arange(len(least)) + length <= offsets[1:][doc]
    place = np.flatnonzero(fits)
    return place, doc[place], mix(least[place])  # minima are small numbers: mixed, they spread over the parts


def text_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The first 128 bits of the SHA-256 of each text, as two numbers."""
    raw = data.tobytes()
    digests = b"".join(hashlib.sha256(raw[a:z]).digest()[:16] for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
    return np.frombuffer(digests, np.uint64).reshape(-1, 2)


def distinct_texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct text keys of a block, sorted, with their least id, and which of them each row has."""
    found = [(text_keys(data, offsets), order) for _, data, offsets, order in block_texts(table)]
    if not found:
        return np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, order = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.lexsort((order, keys[:, 1], keys[:, 0]))
    head = np.r_[True, (keys[by][1:] != keys[by][:-1]).any(axis=1)]
    which = np.empty(len(by), np.int64)
    which[by] = np.cumsum(head) - 1
    return keys[by][head], order[by][head], which


def block_texts(table: pa.Table):
    """(first text, bytes, offsets, order ids) of runs of a block's texts."""
    data, offsets = text_buffer(table.column("text"))
    order = table.column("__order").to_numpy()
    for a, z in chunks(offsets):
        yield a, data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a], order[a:z]


def first_round(table: pa.Table, length: int, piece: int):
    """Distinct pieces of a block with whether two texts of it have them."""
    found = []
    for a, data, offsets, _ in block_texts(table):
        _, doc, least = suffixes(data, offsets, length, piece)
        new = np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])] if len(least) else np.zeros(0, bool)
        least, doc = least[new], doc[new]
        at = np.lexsort((doc, least))
        least, doc = least[at], doc[at] + a
        new = np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])] if len(least) else np.zeros(0, bool)
        found.append((least[new], doc[new]))
    key = np.concatenate([k for k, _ in found]) if found else np.zeros(0, np.uint64)
    key = np.sort(key)  # once a text and run of texts
    first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return key[at], np.diff(np.r_[at, len(key)]) > 1


def ask(n: int, length: int, piece: int):
    """Messages: parts 0..n-1 get pieces, n..2n-1 texts."""
    def run(table):
        key, several = first_round(table, length, piece)
        yield from dealt(key, n, several.astype(np.uint8))
        text, order, _ = distinct_texts(table)
        for p, message in dealt(text[:, 0], n, text[:, 1], order):
            yield n + p, message

    return run


def reply(n: int):
    """Answers: which of the pieces stand in several texts; the least id of each text."""
    def run(part, blocks, payloads):
        asks = [unpacked_keys(p) for p in payloads]
        *key, value = (np.concatenate(x) for x in zip(*asks, strict=True))  # a piece is one number, a text two
        by = np.lexsort((value, *key[::-1]))
        head = np.zeros(len(by), bool)
        head[:1] = True
        for k in key:
            head[1:] |= k[by][1:] != k[by][:-1]
        at = np.flatnonzero(head)
        if part < n:
            known = (np.diff(np.r_[at, len(by)]) > 1) | (np.maximum.reduceat(value[by], at) > 0)
        else:
            known = value[by][at]
        answer = np.empty(len(by), known.dtype)
        answer[by] = known[np.cumsum(head) - 1]
        ends = np.cumsum([len(a[0]) for a in asks])
        for block, a, z in zip(blocks, np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
            yield message_of(block, part, packed(np.packbits(answer[a:z]) if part < n else answer[a:z]))

    return run


def message_of(block: int, part: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([payload], pa.binary())],
                                      names=["block", "part", "payload"])


def copies_of(table: pa.Table, got: dict, n: int) -> np.ndarray:
    """Which rows of a block are copies of a text with a smaller id."""
    text, _, which = distinct_texts(table)
    least = np.full(len(text), NO_ID)
    cuts = np.searchsorted(part_of(text[:, 0], n), np.arange(n + 1))
    for p, payload in got.items():
        if n <= p < 2 * n:
            least[cuts[p - n]:cuts[p - n + 1]] = unpacked(payload)[0]
    order = table.column("__order").to_numpy()
    return least[which] < order


def runs_of(place: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of runs of neighbouring places with equal values."""
    if not len(place):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1] + 1
    for s in same:
        new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    return first, np.r_[first[1:], len(place)] - 1


def second_round(n: int, length: int, piece: int):
    """A block's answers make its suffixes: what neighbouring texts settle goes back as spans, the rest to parts."""
    def run(block, table, got):
        key, _ = first_round(table, length, piece)
        several = np.zeros(len(key), bool)
        cuts = np.searchsorted(part_of(key, n), np.arange(n + 1))
        for p, payload in got.items():
            if p < n:
                several[cuts[p]:cuts[p + 1]] = np.unpackbits(unpacked(payload)[0], count=int(cuts[p + 1] - cuts[p])).astype(bool)
        key, copy = key[several], copies_of(table, got, n)
        spans, sent = [], []
        for a, data, offsets, order in block_texts(table):
            place, doc, least = suffixes(data, offsets, length, piece)
            at = np.minimum(np.searchsorted(key, least), max(0, len(key) - 1))
            use = (key[at] == least) & ~copy[a + doc] if len(key) else np.zeros(len(least), bool)
            place, doc, least = place[use], doc[use], least[use]
            if not len(place):
                continue
            # of equal strings, the smallest id speaks for all
            mark, own = rolled(data, length)[place], order[doc]
            by = np.lexsort((own, mark))
            group = np.r_[True, mark[by][1:] != mark[by][:-1]]
            head = np.zeros(len(place), np.int64)
            head[by] = by[group][np.cumsum(group) - 1]
            settled = own[head] < own
            settled &= same_bytes(data, place, place[head], length, settled)
            at, d = place[settled], doc[settled]
            first, last = runs_of(at, d)
            d = d[first]
            spans.append((d + a, at[first] - offsets[d], at[last] + length - offsets[d]))
            place, doc, least = place[~settled], doc[~settled], least[~settled]
            first, last = runs_of(place, doc, least)
            start, d = place[first], doc[first]
            size = place[last] + length - start
            at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
            sent.append((part_of(least[first], n).astype(np.int64), (d + a).astype(np.int32), start - offsets[d], size.astype(np.int32), order[d], data[at]))
        if spans:
            yield message_of(block, block % n, packed(np.array([1]), *[np.concatenate(x) for x in zip(*spans, strict=True)]))
        if sent:
            part, doc, start, size, order, data = (np.concatenate(x) for x in zip(*sent, strict=True))
            begin = np.cumsum(size, dtype=np.int64) - size
            for p in np.unique(part).tolist():
                mine = np.flatnonzero(part == p)
                n_bytes = size[mine].astype(np.int64)
                at = np.repeat(begin[mine] - (np.cumsum(n_bytes) - n_bytes), n_bytes) + np.arange(n_bytes.sum())
                yield message_of(block, p, packed(np.array([0]), doc[mine], start[mine], size[mine], order[mine], data[at]))

    return run


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int, use: np.ndarray) -> np.ndarray:
    """Whether the strings at a and b are equal, where ``use``; elsewhere True."""
    out = np.ones(len(a), bool)
    view = np.lib.stride_tricks.sliding_window_view(data, length) if len(data) >= length else None
    at = np.flatnonzero(use)
    for s in range(0, len(at), COMPARED):
        some = at[s:s + COMPARED]
        out[some] = (view[a[some]] == view[b[some]]).all(axis=1)
    return out


class Levels:
    """Sorted arrays (mark, id, place), the largest first; each string is in one of them."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def find(self, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least id and place of each string (NO_ID: not there), by a scan of every level; ``mark`` is sorted."""
        ids, places = np.full(len(mark), NO_ID), np.zeros(len(mark), np.int64)
        for key, order, place in self.levels:
            at = np.minimum(np.searchsorted(key, mark), len(key) - 1)
            hit = key[at] == mark
            ids[hit], places[hit] = order[at[hit]], place[at[hit]]
        return ids, places

    def add(self, mark: np.ndarray, order: np.ndarray, place: np.ndarray) -> None:
        if len(mark):
            self.levels.append((mark, order, place))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            b, a = self.levels.pop(), self.levels.pop()
            at = np.searchsorted(a[0], b[0]) + np.arange(len(b[0]))  # the two arrays merge
            old = np.ones(len(a[0]) + len(b[0]), bool)
            old[at] = False
            both = []
            for x, y in zip(a, b, strict=True):
                z = np.empty(len(old), x.dtype)
                z[at], z[old] = y, x
                both.append(z)
            self.levels.append(tuple(both))


def scan(n: int, length: int, batch: int = BATCH):
    """A part's suffixes, in batches of ascending id, against the levels so far; answers are spans."""
    def run(part, blocks, payloads):
        got = []
        for block, payload in zip(blocks, payloads, strict=True):
            head, *rest = unpacked(payload)
            if head[0] == 1:
                yield message_of(block, 2 * n + part, packed(*rest))  # settled in the block already
            else:
                got.append((block, *rest))
        if not got:
            return
        source = np.repeat(np.arange(len(got)), [len(g[1]) for g in got])
        doc, start, size, order = (np.concatenate([g[i] for g in got]) for i in (1, 2, 3, 4))
        data = np.concatenate([g[5] for g in got])
        begin = np.r_[0, np.cumsum(size, dtype=np.int64)[:-1]]
        count = size.astype(np.int64) - length + 1
        by = np.argsort(order, kind="stable")
        ends = np.cumsum(count[by])
        levels, spans, a = Levels(), [], 0
        while a < len(by):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + batch, "right")))
            runs = by[a:z]
            a = z
            c = count[runs]
            run_of = np.repeat(np.arange(len(runs)), c)
            inside = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            place = begin[runs][run_of] + inside
            mark, ids = marks(data, begin[runs], size[runs], c, length), order[runs][run_of]
            array = np.lexsort((ids, mark))  # the batch's suffix array
            mark, ids, place, run_of, inside = (x[array] for x in (mark, ids, place, run_of, inside))
            first = np.r_[True, mark[1:] != mark[:-1]]
            group = np.cumsum(first) - 1
            old, old_place = levels.find(mark[first])
            fresh = old == NO_ID
            least, at = np.where(fresh, ids[first], old), np.where(fresh, place[first], old_place)
            hit = least[group] < ids
            hit &= same_bytes(data, place, at[group], length, hit)
            levels.add(mark[first][fresh], ids[first][fresh], place[first][fresh])
            key = np.sort(place[hit])  # runs do not overlap in ``data``, so neighbouring places are one span
            f, last = runs_of(key, np.searchsorted(begin, key, "right"))
            if len(f):
                r = np.searchsorted(begin, key[f], "right") - 1
                spans.append((source[r], doc[r], start[r] + key[f] - begin[r], start[r] + key[last] - begin[r] + length))
        if spans:
            source_of, d, s, e = (np.concatenate([x[i] for x in spans]) for i in range(4))
            for i, g in enumerate(got):
                mine = source_of == i
                if mine.any():
                    yield message_of(g[0], part, packed(d[mine], s[mine], e[mine]))

    return run


def marks(data: np.ndarray, begin: np.ndarray, size: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all strings of some runs, run by run."""
    size = size.astype(np.int64)
    before = np.cumsum(size) - size
    own = data[np.repeat(begin - before, size) + np.arange(size.sum())]
    return rolled(own, length)[np.repeat(before - (np.cumsum(count) - count), count) + np.arange(count.sum())]


def covered(table: pa.Table, got: dict, n: int, length: int):
    """(first text, bytes, offsets, covered bytes) of runs of a block's texts."""
    copy = copies_of(table, got, n)
    spans = [unpacked(p) for k, p in got.items() if k < n or k >= 2 * n]
    doc, start, stop = (np.concatenate([s[i] for s in spans]).astype(np.int64) if spans else np.zeros(0, np.int64) for i in range(3))
    by = np.argsort(doc, kind="stable")
    doc, start, stop = doc[by], start[by], stop[by]
    for a, data, offsets, _ in block_texts(table):
        mine = slice(*np.searchsorted(doc, [a, a + len(offsets) - 1]))
        base = offsets[doc[mine] - a]
        step = np.bincount(base + start[mine], minlength=len(data) + 1) - np.bincount(base + stop[mine], minlength=len(data) + 1)
        size = np.diff(offsets)
        yield a, data, offsets, (np.cumsum(step[:-1]) > 0) | np.repeat(copy[a:a + len(size)] & (size >= length), size)


def finish(n: int, length: int, whole_rows: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(block, table, got):
        for a, data, offsets, cover in covered(table, got, n, length):
            before, z = np.r_[0, np.cumsum(cover)], a + len(offsets) - 1
            starts = cover.copy()
            inner = np.ones(len(data) + 1, bool)
            inner[offsets] = False
            starts[1:] &= ~(cover[:-1] & inner[1:-1])
            spans = np.r_[0, np.cumsum(starts)]
            removed = before[offsets[1:]] - before[offsets[:-1]]
            kept, at = data[~cover], offsets - before[offsets]
            texts = [kept[x:y].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            rows = table.slice(a, z - a)
            if whole_rows:
                rows = rows.drop_columns(["__order"]).append_column("removed", pa.array(removed, pa.int64()))
                where = rows.schema.get_field_index("text")
                old = rows.column("text").to_pylist()
                new = [o if not r else t.decode("utf-8", "ignore") for o, r, t in zip(old, removed.tolist(), texts, strict=True)]
                yield from rows.set_column(where, "text", pa.array(new, pa.string())).combine_chunks().to_batches()
            else:
                yield record(schema, doc_id=rows.column("doc_id").combine_chunks(), n_bytes=np.diff(offsets), n_removed=removed,
                             n_spans=spans[offsets[1:]] - spans[offsets[:-1]], kept_sha256=[hashlib.sha256(t).hexdigest() for t in texts])

    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH, piece: int = PIECE, whole_rows: bool = False, removed: str = "__removed_bytes") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; with ``whole_rows`` instead
    the columns of ``docs`` with the kept text, and ``removed``, the removed bytes (a character cut in
    two goes).  ``docs`` may have columns of any names but that one."""
    if whole_rows and free_name(docs, removed) != removed:
        raise ValueError(f"docs has a column {removed}")
    message = "block long, part int, payload binary"
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("__order")
    others = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("row")
    kept = docs.select("text", order, others) if whole_rows else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", order)
    blocks = blocks_of(kept, "suffix-blocks", BLOCK_BYTES)
    n = max(2 * parts(docs), blocks.count())  # parts grow with the text
    known = saved(each_part(asked(blocks, ask(n, length, piece)), reply(n), message, 2 * n), "suffix-known")
    found = each_part(answered(blocks, known, second_round(n, length, piece), message), scan(n, length), message, n)
    answers = known.where(F.col("part") >= n).unionByName(found)
    if not whole_rows:
        return answered(blocks, answers, finish(n, length, False), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    out = T.StructType([f for f in kept.schema if f.name != "__order"] + [T.StructField("removed", T.LongType())])
    cut = answered(blocks, answers, finish(n, length, True), out)
    return cut.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns], F.col("removed").alias(removed))
