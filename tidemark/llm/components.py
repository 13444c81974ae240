"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the components of some edges, without the roots themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        nxt = root.copy()
        np.minimum.at(nxt, root[a], low)
        np.minimum.at(nxt, root[b], low)
        while True:
            jumped = nxt[nxt]
            if (jumped == nxt).all():
                break
            nxt = jumped
        if (nxt == root).all():
            break
        root = nxt
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def thinned(edges: DataFrame) -> DataFrame:
    """Each task's edges (u, v) as stars of its own components: no more edges than nodes."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for x in it:
            a, b = forest(np.concatenate([a, x.column(0).to_numpy()]), np.concatenate([b, x.column(1).to_numpy()]))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v); root: the smallest node of its component.

    Large star: a node's larger neighbours are tied to its smallest neighbour;
    small star: its smaller ones are.  Edges never grow in number, paths halve
    every few turns, and the end is reached when a turn changes nothing.
    """
    now = saved(thinned(edges.where("u <> v")).distinct(), "edges")
    turn, before = 0, None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(low.select("u", F.col("m").alias("v")))
        now = saved(small.distinct(), f"stars{turn}")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before, turn = mark, turn + 1
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
