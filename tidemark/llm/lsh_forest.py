"""Operator 6, n-gram Jaccard join: MinHash LSH forest.

1. Every text becomes its set of word 5-grams; rows with equal sets are one
   representative from here on.
2. A representative has a label of ``LABEL`` min-hash bytes in each of ``TREES``
   trees.  All labels of all trees are range-sorted, so a trie's nodes are runs
   of labels with a common prefix, and a run may be as long as it likes.
3. The matched prefix is the longest with which a pair at the threshold meets in
   some tree with the target recall.  It depends on threshold, target, trees and
   label alone, not on the data: 6 bytes for the production parameters, so bytes
   7 and 8 only order the rows of a run.
   Neighbours in the order that share the prefix are tied, and ties of all
   trees give candidate groups.  No pair is written for this.
4. Within a group every pair is verified on the exact sets, in blocks of
   ``BLOCK`` by ``BLOCK``; the pairs themselves stay in the task, which gives
   each representative's number of links and a spanning forest of the links.

Result: a row a document with its class (connected by links) and its number of
links to other rows.

Defined cases: words are runs of non-blank characters, as they are; a text of
one to four words is one n-gram of all its words; null, empty and blank texts
have the empty set, are like each other and unlike all others; equal rows are
rows of one class, linked to each other; a class is named by its smallest id
(null only if no row of it has one); empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import text_buffer
from .common import MULT, batches, bounded_batches, mix, parts, record, saved, sorted_groups, word_hash
from .components import components, forest, thinned

WORDS = 5
THRESHOLD = 0.8
TREES, LABEL = 32, 8
#: Of pairs exactly at the threshold; closer pairs are found more surely.
RECALL = 0.9999
BLOCK = 512

_RNG = np.random.default_rng(20240601)
_A = (_RNG.integers(0, 1 << 32, TREES * LABEL, np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, TREES * LABEL, np.uint64).astype(np.uint32)


def prefix_length(threshold: float, target: float, trees: int = TREES, label: int = LABEL) -> int:
    """The longest prefix with which a pair at the threshold meets in some tree surely enough."""
    for k in range(label, 0, -1):
        if 1 - (1 - threshold**k) ** trees >= target:
            return k
    return 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[offsets < len(data)]] = True
    size = len(data)
    starts = np.flatnonzero(~blank & (edge[:-1] | np.r_[True, blank[:-1]])) if size else np.zeros(0, np.int64)
    stops = np.flatnonzero(~blank & np.r_[edge[1:-1] | blank[1:], True]) + 1 if size else np.zeros(0, np.int64)
    word = word_hash(data, starts, stops)
    first = np.searchsorted(starts, offsets)  # each text's first word
    with np.errstate(over="ignore"):
        gram = np.zeros(max(0, len(word) - n + 1), np.uint64)
        for j in range(n):
            gram = gram * MULT + word[j:len(word) - n + 1 + j]
        gram = mix(gram)
        out = []
        for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if z - a >= n:
                out.append(np.unique(gram[a:z - n + 1]))
            elif z > a:
                short = np.uint64(0)
                for w in word[a:z]:
                    short = short * MULT + w
                out.append(mix(np.array([short + np.uint64(z - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def labels_of(grams: np.ndarray) -> list[int]:
    """A label a tree: the last bytes of LABEL minima, the first in the highest place."""
    if not len(grams):
        return [0] * TREES
    low = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(TREES * LABEL, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for a in range(0, len(low), 2048):
            np.minimum(least, (low[None, a:a + 2048] * _A[:, None] + _B[:, None]).min(axis=1), out=least)
    return np.ascontiguousarray((least & np.uint32(0xFF)).astype(np.uint8).reshape(TREES, LABEL)).view(">i8").ravel().tolist()


def set_key(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share (0, 0 for the empty set)."""
    with np.errstate(over="ignore"):
        a, b = mix(grams).sum(dtype=np.uint64), mix(grams ^ MULT).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def signed(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_hash, k1, k2 (the set), grams, labels of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
                        ("grams", pa.int32()), ("labels", pa.list_(pa.int64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            sets = shingle_sets(*text_buffer(b["text"]), n)
            keys = [set_key(s) for s in sets]
            known: dict = {}
            for k, s in zip(keys, sets, strict=True):
                if k not in known:
                    known[k] = labels_of(s)
            yield record(schema, doc_id=b["doc_id"], text_hash=b["text_hash"], k1=[k[0] for k in keys], k2=[k[1] for k in keys],
                         grams=[len(s) for s in sets], labels=[known[k] for k in keys])

    return docs.mapInArrow(run, "doc_id long, text_hash long, k1 long, k2 long, grams int, labels array<long>")


def tied(reps: DataFrame, k: int) -> DataFrame:
    """Edges between neighbours of the sorted forest that share k bytes of a label."""
    spark, shift = reps.sparkSession, np.uint64(64 - 8 * k)
    rows = reps.where("grams > 0").select(F.posexplode("labels").alias("tree", "label"), F.col("k1").alias("node"))
    rows = rows.repartitionByRange(parts(reps), "tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    schema = pa.schema([("kind", pa.int32()), ("u", pa.int64()), ("v", pa.int64()), ("tree", pa.int32()), ("label", pa.int64()), ("node", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ends = None, []
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for x in it:
            if not x.num_rows:
                continue
            tree, label, node = (x.column(i).to_numpy() for i in range(3))
            if last is None:
                ends.append((int(tree[0]), int(label[0]), int(node[0])))
            else:
                tree, label, node = (np.concatenate([[l], y]) for l, y in zip(last, (tree, label, node), strict=True))
            head = label.view(np.uint64) >> shift
            same = (tree[1:] == tree[:-1]) & (head[1:] == head[:-1]) & (node[1:] != node[:-1])
            a, b = forest(np.concatenate([a, node[1:][same]]), np.concatenate([b, node[:-1][same]]))
            last = tree[-1], label[-1], node[-1]
        if last is not None:
            ends.append(tuple(map(int, last)))
            yield record(schema, kind=[0] * len(a), u=a, v=b, tree=[None] * len(a), label=[None] * len(a), node=[None] * len(a))
            yield record(schema, kind=[1] * 2, u=[None] * 2, v=[None] * 2, tree=[e[0] for e in ends], label=[e[1] for e in ends], node=[e[2] for e in ends])

    found = saved(rows.mapInArrow(run, "kind int, u long, v long, tree int, label long, node long"), "ties")
    # two rows a partition: the runs that go on in the next one
    ends = found.where("kind = 1").select("tree", "label", "node").orderBy("tree", "label", "node").collect()
    across = [(x.node, y.node) for x, y in zip(ends[:-1], ends[1:], strict=True)
              if x.node != y.node and x.tree == y.tree and (x.label & (1 << 64) - 1) >> int(shift) == (y.label & (1 << 64) - 1) >> int(shift)]
    return found.where("kind = 0").select("u", "v").unionByName(spark.createDataFrame(across, "u long, v long"))


def similar(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of ``a`` the places in ``b`` of sets with at least that Jaccard similarity."""
    sets = a if b is a else a + b
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    size = np.array([len(s) for s in sets], np.int64)
    gram, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1  # n-grams of one set alone need no bit
    use, row = times[at] > 1, np.repeat(np.arange(len(sets)), size)
    width = int((times > 1).sum() + 63) // 64
    bits = np.zeros((len(sets), width), np.uint64)
    if width:
        place = shared[at[use]]
        np.bitwise_or.at(bits, (row[use], place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    other, other_size = (bits, size) if b is a else (bits[len(a):], size[len(a):])
    for i in range(len(a)):
        near = np.flatnonzero((np.minimum(size[i], other_size) >= threshold * np.maximum(size[i], other_size) - 1e-9))
        common = np.bitwise_count(bits[i] & other[near]).sum(axis=1, dtype=np.int64)
        # a set against itself has all its n-grams in common, with or without bits
        union = size[i] + other_size[near] - common
        yield i, near[common >= threshold * union - 1e-9]


def verified(groups: DataFrame, docs: DataFrame, n: int, threshold: float, block: int) -> DataFrame:
    """(kind 0, u, links) and (kind 1, u, v): the links of each representative, and forests of them.
    groups: root, members, k1, doc_id, text_hash, copies."""
    sets_schema = pa.schema([("root", pa.int64()), ("members", pa.int64()), ("k1", pa.int64()), ("copies", pa.int64()), ("grams", pa.binary())])

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            yield record(sets_schema, root=b["root"], members=b["members"], k1=b["k1"], copies=b["copies"],
                         grams=[s.tobytes() for s in shingle_sets(*text_buffer(b["text"]), n)])

    wanted = groups.withColumnsRenamed({"doc_id": "rep_id", "text_hash": "rep_hash"})
    own = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash"))) \
        .select("text", "root", "members", "k1", "copies")
    # equal rows meet again below as equal k1 of one task, where one of them is used
    blocks = F.ceil(F.col("members") / F.lit(block)).cast("long")
    mine = F.pmod(F.xxhash64("k1"), F.col("blocks"))
    each = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
                       lambda o: F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j")))
    rows = own.mapInArrow(sets, "root long, members long, k1 long, copies long, grams binary") \
        .withColumn("blocks", blocks).withColumn("mine", mine).select("root", "k1", "copies", "grams", "mine", F.inline(each))
    schema = pa.schema([("kind", pa.int32()), ("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), t in sorted_groups(it, ["root", "i", "j"]):
            k1, mine, copies = (t.column(c).to_numpy() for c in ("k1", "mine", "copies"))
            one = np.flatnonzero(np.r_[True, k1[1:] != k1[:-1]])  # sorted by mine, k1
            k1, mine, copies = k1[one], mine[one], copies[one]
            grams = t.column("grams").take(pa.array(one)).to_pylist()
            grams = [np.frombuffer(g, np.uint64) for g in grams]
            left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
            a = [grams[x] for x in left]
            links, u, v = np.zeros(len(k1), np.int64), [], []
            for x, hits in similar(a, a if i == j else [grams[y] for y in right], threshold):
                to = right[hits]
                to = to[to != left[x]]
                if len(to):
                    links[left[x]] += copies[to].sum()
                    if i != j:
                        links[to] += copies[left[x]]
                    u.append(np.full(len(to), k1[left[x]]))
                    v.append(k1[to])
            some = links > 0
            yield record(schema, kind=np.zeros(some.sum(), np.int32), u=k1[some], v=[None] * int(some.sum()), links=links[some])
            if u:
                x, y = forest(np.concatenate(u), np.concatenate(v))
                yield record(schema, kind=np.ones(len(x), np.int32), u=x, v=y, links=[None] * len(x))

    return rows.repartition(parts(docs), "root", "i", "j").sortWithinPartitions("root", "i", "j", "mine", "k1") \
        .mapInArrow(run, "kind int, u long, v long, links long")


def jaccard_join(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, text_hash, class_key, class_id, n_links, copies of each row of ``docs``."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    rows = saved(signed(own.select("doc_id", "text_hash", "text"), n), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    reps = rows.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.first("grams").alias("grams"), F.first("labels").alias("labels"), first)
    reps = saved(reps.select("k1", "k2", "copies", "grams", "labels", "first.doc_id", "first.text_hash"), "representatives")
    groups = components(tied(reps, prefix_length(threshold, recall)))
    groups = saved(groups, "groups")
    sizes = groups.groupBy("root").agg(F.count("*").alias("members"))
    members = groups.join(sizes, "root").join(reps.withColumnRenamed("k1", "node").drop("labels", "grams", "k2"), "node") \
        .select("root", "members", F.col("node").alias("k1"), "doc_id", "text_hash", "copies")
    found = saved(verified(members, own, n, threshold, block), "verified")
    links = found.where("kind = 0").groupBy(F.col("u").alias("k1")).agg(F.sum("links").alias("links"))
    classes = components(found.where("kind = 1").select("u", "v"))
    of_rep = reps.select("k1", "k2", "copies", "doc_id").join(links, "k1", "left").join(classes.withColumnRenamed("node", "k1"), "k1", "left") \
        .select("k1", "k2", "copies", "doc_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "k1").alias("class_key"))
    of_rep = saved(of_rep, "classes")
    names = of_rep.groupBy("class_key").agg(F.min("doc_id").alias("class_id"))
    told = of_rep.join(names, "class_key").select("k1", "k2", "class_key", "class_id", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    return rows.select("doc_id", "text_hash", "k1", "k2").join(told, ["k1", "k2"]) \
        .select("doc_id", "text_hash", "class_key", "class_id", F.col("n_links").cast("long").alias("n_links"), "copies")
