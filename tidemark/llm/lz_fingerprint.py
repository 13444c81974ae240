"""Operator 5, document fingerprints: Lempel-Ziv phrases.

A text is parsed into the phrases of an LZ78 dictionary: each phrase is the
shortest run of characters that is not yet in the text's own dictionary.  The
phrases are hashed, and a fingerprint is the ``KEEP`` smallest hashes of the
set; likeness of two fingerprints estimates the share of common phrases, as a
compressor that has read one text would see them in the other.

The edited text of the query shares its beginning with the original, so the
parse of the beginning is shared as well and both ends are parsed from there.

The next document is found without a shuffle of its own: rows are dealt to
blocks of consecutive ids, and the first row of every block also goes to the
block before it.

Defined cases: order is by descending id, null ids last, equal ids by a hash of
their text; a null text is empty; empty texts have the empty fingerprint, which
is like itself (1.0) and unlike others (0.0); a single row follows itself;
empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, parts, record, span_hash

KEEP = 96


def parse(text: str, known: set, open_phrase: str = "") -> tuple[list[str], str]:
    """The phrases of a text and the one still open at its end; adds to ``known``."""
    found: list[str] = []
    w, add, keep = open_phrase, known.add, found.append
    for c in text:
        w += c
        if w in known:
            continue
        add(w)
        keep(w)
        w = ""
    return found, w


def smallest(codes: np.ndarray, phrases: list[str]) -> np.ndarray:
    """The ``KEEP`` smallest 32-bit hashes of phrases that follow each other in a text."""
    if not len(codes):
        return np.zeros(0, np.uint32)
    ends = np.cumsum(np.fromiter(map(len, phrases), np.int64, len(phrases)))
    if not len(ends) or ends[-1] < len(codes):  # the open phrase at the end
        ends = np.append(ends, len(codes))
    h = (span_hash(codes, np.append(0, ends[:-1]), ends) >> np.uint64(32)).astype(np.uint32)
    if len(h) > 2 * KEEP:  # phrases differ, so few of the smallest can be equal
        few = np.unique(np.partition(h, 2 * KEEP - 1)[:2 * KEEP])[:KEEP]
        if len(few) == KEEP:
            return few
    return np.unique(h)[:KEEP]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common phrases, from the smallest hashes of the union."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:KEEP]
    return float(np.isin(both, a, assume_unique=True) @ np.isin(both, b, assume_unique=True).astype(np.int64)) / len(both)


class Parsed:
    """A text with its fingerprint, ready to be parsed again with another end."""

    def __init__(self, text: str):
        self.text, self.cut = text, len(text) - len(text) // 3
        self.known: set = set()
        self.head, self.open = parse(text[:self.cut], self.known)
        self.tail, _ = parse(text[self.cut:], self.known, self.open)
        self.codes = code_points(text)
        self.print = smallest(self.codes, self.head + self.tail)

    def edited(self, follower: str) -> tuple[str, np.ndarray]:
        """The edited text and its fingerprint.  Call once: it uses the dictionary up."""
        end = follower[:len(self.text) // 3]
        self.known.difference_update(self.tail)
        tail, _ = parse(end, self.known, self.open)
        return self.text[:self.cut] + end, smallest(np.concatenate([self.codes[:self.cut], code_points(end)]), self.head + tail)


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a ``fingerprint``: the operator on its own, one pass and no shuffle."""
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: Parsed(t or "").print.astype(">u4").tobytes().hex())

    return docs.withColumn("fingerprint", of(F.col(text_col)))


def lz_neighbours(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """The contract's table: each row's fingerprint, that of its edited text, and both likenesses."""
    spark = docs.sparkSession
    bounded_batches(spark)
    schema_out = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                  "near_edited double, near_next double")
    p = blocks or 4 * parts(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    asked = [round(i / p, 6) for i in range(1, p)]
    edges = np.array(sorted(set(docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), asked, 50 * p)).first()[0] or [])), np.int64)

    @F.pandas_udf("int")
    def block_of(ids: pd.Series) -> pd.Series:
        """Blocks count down with the ids; rows without an id come last."""
        known = ids.notna()
        out = np.full(len(ids), len(edges) + 1, np.int64)
        out[known] = len(edges) - np.searchsorted(edges, ids[known].astype(np.int64))
        return pd.Series(out)

    # one row a block: its first in descending order
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")
    firsts = rows.select("doc_id", "h").withColumn("block", block_of("doc_id")).groupBy("block").agg(F.max(order).alias("first")) \
        .select("block", "first.doc_id", "first.h").orderBy("block").collect()
    if not firsts:
        return spark.createDataFrame([], schema_out)
    before = [(firsts[i - 1].block, r.doc_id, r.h) for i, r in enumerate(firsts)]  # the first block's goes to the last
    ahead = F.broadcast(spark.createDataFrame(before, "to int, of_id long, of_h long"))  # one row a block
    rows = rows.withColumn("block", block_of("doc_id"))
    look = rows.join(ahead, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("h") == F.col("of_h")), "left")
    both = F.when(F.col("to").isNull(), F.array(F.struct(F.col("block").alias("block"), F.lit(0).alias("role")))) \
        .otherwise(F.array(F.struct(F.col("block").alias("block"), F.lit(0).alias("role")), F.struct(F.col("to").alias("block"), F.lit(1).alias("role"))))
    dealt = look.select("doc_id", "h", "text", F.inline(both))
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    hexed = lambda x: x.astype(">u4").tobytes().hex()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # (block, doc_id, Parsed) of the row that waits for its next
        for b in it:
            out: list[list] = [[] for _ in schema]
            for block, role, doc, text in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("block", "role", "doc_id", "text")), strict=True):
                if now is None and role:
                    continue  # more rows equal to the first of the next block
                new = now[2] if now and role and now[2].text == text else Parsed(text)
                if now:
                    edited, mark = now[2].edited(text)
                    row = (now[1], len(now[2].text), hashlib.sha256(edited.encode()).hexdigest(), hexed(now[2].print), hexed(mark),
                           likeness(now[2].print, mark), likeness(now[2].print, new.print))
                    for c, x in zip(out, row, strict=True):
                        c.append(x)
                now = None if role else (block, doc, new)
            if out[0]:
                yield record(schema, **dict(zip(schema.names, out, strict=True)))

    return dealt.repartition(p, "block") \
        .sortWithinPartitions("block", "role", F.col("doc_id").desc_nulls_last(), F.col("h").desc()).mapInArrow(run, schema_out)
