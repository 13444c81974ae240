"""Blocks of whole texts, and questions that blocks put to keyed parts.

Operators that need corpus-wide facts about every position of a text cannot
shuffle a row a position.  They read documents as compressed blocks, reduce a
block to its distinct keys, send these as one packed message for each part of
the key space, and get one packed answer a part back.  A key that stands in a
third of all texts is one entry of each block's message.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame


from .common import MULT, bounded_batches, parts, saved, sorted_groups

#: Bytes of text in one block (a longer text is a block of its own).
BLOCK_BYTES = 12 << 20
BLOCKS = "block long, part int, payload binary"
BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("payload", pa.binary())])


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed message, bytes of equal weight side by side."""
    out = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
        out.append(a.dtype.str.encode().ljust(8) + np.array([len(a)], np.int64).tobytes() + planes)
    return squeeze(b"".join(out))


def unpacked(data: bytes) -> list[np.ndarray]:
    raw, out, at = unsqueeze(data), [], 8
    for _ in range(int(np.frombuffer(raw, np.int64, 1)[0])):
        kind, n = np.dtype(raw[at:at + 8].decode().strip()), int(np.frombuffer(raw, np.int64, 1, at + 8)[0])
        at += 16
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind) if n else np.zeros(0, kind))
        at += n * kind.itemsize
    return out


def packed_keys(keys: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted keys by their differences, and columns beside them."""
    return packed(np.diff(keys, prepend=np.uint64(0)) if len(keys) else keys, *more)


def unpacked_keys(data: bytes) -> list[np.ndarray]:
    first, *rest = unpacked(data)
    return [np.cumsum(first, dtype=np.uint64), *rest]


def blocks_of(docs: DataFrame, name: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, part = -1, payload): the rows of ``docs`` (which has a ``text``) as compressed
    blocks in the shared folder; block ids are fixed by being written."""
    bounded_batches(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, size, n = TaskContext.get().partitionId() << 32, [], 0, 0

        def flushed():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as w:
                for b in held:
                    w.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([first + n], pa.int64()), pa.array([-1], pa.int32()),
                                               pa.array([squeeze(sink.getvalue().to_pybytes())], pa.binary())], schema=BLOCK_SCHEMA)

        for b in it:
            lengths = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False)
            at = 0
            ends = np.cumsum(lengths)
            while at < b.num_rows:
                room = block_bytes - size + (ends[at - 1] if at else 0)
                to = max(int(np.searchsorted(ends, room, "right")), at + (not held))
                if to > at:
                    held.append(b.slice(at, to - at))
                    size += int(ends[to - 1] - (ends[at - 1] if at else 0))
                if to < b.num_rows:
                    yield flushed()
                    held, size, n = [], 0, n + 1
                at = to
        if held:
            yield flushed()

    return saved(docs.mapInArrow(run, BLOCKS), name)


def rows_of(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(unsqueeze(payload)).read_all()


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and the place where each starts (and the last ends)."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    if col.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(col.buffers()[2], np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def asked(blocks: DataFrame, ask) -> DataFrame:
    """Messages (block, part, payload): ``ask(table)`` gives (part, payload) pairs for a block's rows."""
    def run(it):
        for b in it:
            for block, payload in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                for part, message in ask(rows_of(payload)):
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()),
                                                      pa.array([message], pa.binary())], schema=BLOCK_SCHEMA)

    return blocks.mapInArrow(run, BLOCKS)


def each_part(messages: DataFrame, reduce, schema: str, n: int) -> DataFrame:
    """``reduce(part, blocks, payloads)`` yields record batches for all messages of a part."""
    def run(it):
        for (part,), t in sorted_groups(it, ["part"]):
            yield from reduce(int(part), t.column("block").to_pylist(), t.column("payload").to_pylist())

    return messages.repartition(n, "part").sortWithinPartitions("part", "block").mapInArrow(run, schema)


def answered(blocks: DataFrame, answers: DataFrame, finish, schema: str) -> DataFrame:
    """``finish(block, table, {part: payload})`` yields record batches for each block with its answers."""
    def run(it):
        for (block,), t in sorted_groups(it, ["block"]):
            part, payload = t.column("part").to_pylist(), t.column("payload").to_pylist()
            got = dict(zip(part[1:], payload[1:], strict=True))
            yield from finish(int(block), rows_of(payload[0]), got)

    both = blocks.unionByName(answers.select("block", "part", "payload"))
    return both.repartition(parts(blocks), "block").sortWithinPartitions("block", "part").mapInArrow(run, schema)


def part_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Parts are equal runs of the 64-bit key space, so sorted keys are cut, not dealt."""
    return (keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)


def dealt(keys: np.ndarray, n: int, *more: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(part, message) of sorted 64-bit keys with their columns."""
    own = part_of(keys, n)
    cuts = np.searchsorted(own, np.arange(n + 1))
    for p in range(n):
        a, z = cuts[p], cuts[p + 1]
        if z > a:
            yield p, packed_keys(keys[a:z], *[m[a:z] for m in more])


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, with sums of the values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return (keys[at], *[np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values])


#: Bytes of text that are turned into arrays of a value a byte at once.
CHUNK = 1 << 19


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes."""
    a, n = 0, len(offsets) - 1
    while a < n:
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, z
        a = z


class Lookup:
    """Values of 64-bit keys by open addressing: a probe a round for all keys that have not met theirs."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(3 * max(1, len(keys))).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, values.dtype)
        taken = np.zeros(1 << self.bits, bool)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[~taken[slot[left]]]
            first = free[np.unique(slot[free], return_index=True)[1]]  # one key a slot
            at = slot[first]
            taken[at], self.keys[at], self.values[at] = True, keys[first], values[first]
            placed = np.zeros(len(keys), bool)
            placed[first] = True
            left = left[~placed[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys that are all there."""
        slot = self._slot(keys)
        wrong = np.flatnonzero(self.keys[slot] != keys)
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            wrong = wrong[self.keys[slot[wrong]] != keys[wrong]]
        return self.values[slot]
