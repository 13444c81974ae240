"""Helpers shared by the operators: shared folder, batch size, words, hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract here has it: a run of non-blank characters (ASCII blanks only).
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of one Arrow batch between the JVM and Python.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set and the master is local (tests)."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tidemark-llm-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: later reads do
    not recompute it and survive the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes as well as by rows, so that batches of long texts stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_of_id(col: str = "doc_id") -> Column:
    """crc32 of the id written as text (null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` has it."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def parts(df: DataFrame) -> int:
    """Number of reduce tasks the session asks for."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def batches(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Record batches as dicts of Arrow columns."""
    for b in it:
        if b.num_rows:
            yield dict(zip(b.schema.names, b.columns, strict=True))


def text_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 of a string column (null: empty)."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def record(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)


def sorted_groups(it: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of a partition that is sorted by ``keys``, one at a time, across batches."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in it:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for a, z in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if now is not None and key != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(b.slice(a, z - a))
    if held:
        yield now, pa.Table.from_batches(held)


# ---------------------------------------------------------------- hashes over byte buffers

MULT = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(MULT), -1, 1 << 64))


_POWERS: dict = {}


def powers(n: int, base: np.uint64 = MULT) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest so far is kept (up to a text of 4 MB)."""
    out = _POWERS.get(base)
    if out is None or len(out) < n:
        out = np.full(max(n, 1 << 14), base, np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if n <= 4 << 20:
            _POWERS[base] = out
    return out[:n]


def span_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of codes[start:end], equal for equal content wherever it stands."""
    n = len(codes)
    with np.errstate(over="ignore"):
        run = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(n), out=run[1:])
        back = powers(n + 1, INVERSE)
        return mix((run[ends] - run[starts]) * back[starts] + (ends - starts).astype(np.uint64) * MULT)


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit SipHash of the bytes data[start:end]: unlike a polynomial's, its collisions cannot be written down."""
    buffer = data.tobytes()
    spans = np.empty(len(starts), object)
    spans[:] = [buffer[a:z] for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
    return pd.util.hash_array(spans, categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
