"""Operator 4, packing: first-fit decreasing with a tournament tree of bin capacities.

Texts become token ids, an end id is appended, and whole sequences are cut off
the front of long documents; the rest of a document is one piece.  Pieces are
dealt to randomised groups, and each group packs its pieces on its own, largest
first, into the first bin with room: the leaves of a tournament tree are bins,
an inner node holds the larger room of its two children, and the way down to
the first leaf with room takes as many steps as the tree has levels.

Defined cases: null and empty texts are their end id alone; equal rows are
packed each; a text's length has no limit; empty table: no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, bounded_batches, parts, record, saved, sorted_groups

LENGTH = 2048
END_ID = 1
#: Pieces of a group, about.
GROUP = 8192


class Encoder:
    """Ids of a byte-level BPE vocabulary, as the tokenizers library gives them.

    tiktoken runs the same vocabulary several times faster; the library itself
    takes what tiktoken's pattern matcher gives up on (very long runs of blanks).
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.json_path, self.slow = json_path, None
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            if self.slow is None:
                from tokenizers import Tokenizer
                self.slow = Tokenizer.from_file(self.json_path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, length: int = LENGTH, end_id: int = END_ID,
           with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) of the pieces of each row."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches(it):
            encoder = encoder or Encoder(json_path, ranks_path, pattern)
            out: list[list] = [[] for _ in schema]
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                ids = np.append(encoder.ids(text or ""), np.uint32(end_id)).astype("<u4")
                for a in range(0, len(ids), length):
                    own = ids[a:a + length]
                    row = (doc, a, len(own), zlib.crc32(own.tobytes()), len(ids), own.astype(np.int32))
                    for c, x in zip(out, row, strict=False):
                        c.append(x)
            yield record(schema, **dict(zip(schema.names, out, strict=True)))

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size."""
    order = np.argsort(-sizes, kind="stable")
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    tree = [room] * (2 * leaves)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        bins[i], offsets[i] = at - leaves, room - tree[at]
        tree[at] -= size
        at >>= 1
        while at:
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
            at >>= 1
    return bins, offsets


def ffd_packing(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, length: int = LENGTH, end_id: int = END_ID,
                group: int = GROUP, seed: int = 5, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` with sequence_id (the number of the sequence's first piece) and offset."""
    cut = saved(pieces(docs, json_path, ranks_path, pattern, length, end_id, with_ids)
                .withColumn("piece", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-cut.where(F.col("length") < length).count() // group))
    schema = pa.schema([("piece", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in sorted_groups(it, ["grp"]):
            piece = t.column("piece").to_numpy()
            bins, offsets = first_fit_decreasing(t.column("length").to_numpy(), length)
            head = np.zeros(len(bins), np.int64)
            head[bins[offsets == 0]] = piece[offsets == 0]
            yield record(schema, piece=piece, sequence_id=head[bins], offset=offsets)

    short = cut.where(F.col("length") < length).select("piece", "length", F.pmod(F.xxhash64("piece", F.lit(seed)), F.lit(groups)).alias("grp"))
    placed = short.repartition(min(groups, 4 * parts(docs)), "grp").sortWithinPartitions("grp", "piece") \
        .mapInArrow(run, "piece long, sequence_id long, offset long")
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    whole = cut.where(F.col("length") == length).withColumn("sequence_id", F.col("piece")).withColumn("offset", F.lit(0).cast("long"))
    return cut.where(F.col("length") < length).join(placed, "piece").select(*out).unionByName(whole.select(*out))
