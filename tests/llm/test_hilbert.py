import zlib

from pyspark.sql import functions as F

from tidemark.llm.hilbert_shards import cell_of, curve_table, edges_of, hilbert_shards, write_shards


def check(rows, docs, shards):
    assert len(rows) == len(docs)
    want = sorted((-1 if d is None else d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    n = len(rows)
    place = sorted(rows, key=lambda r: (r.shard, r.slot))
    counts = [sum(r.shard == s for r in rows) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == n
    for s in range(shards):
        assert [r.slot for r in place if r.shard == s] == list(range(counts[s]))
    assert [r.curve for r in place] == sorted(r.curve for r in rows)


def test_curve_visits_neighbours(spark):
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        at = [r.cell for r in curve_table(spark, dims, bits).orderBy("curve").collect()]
        assert sorted(at) == list(range(1 << (dims * bits)))
        axes = [[(c >> (bits * (dims - 1 - i))) & ((1 << bits) - 1) for i in range(dims)] for c in at]
        assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for a, b in zip(axes[:-1], axes[1:]))


def test_shards_of_documents(documents):
    rows = hilbert_shards(documents).collect()
    check(rows, [(r.doc_id, r.text) for r in documents.collect()], 24)


def test_odd_rows(odd, odd_rows, empty):
    check(hilbert_shards(odd, shards=5).collect(), [r[:2] for r in odd_rows], 5)
    assert hilbert_shards(empty).collect() == []


def test_hot_cell(spark):
    docs = spark.range(3000).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"),
                                    F.lit("s").alias("source"), F.lit(4).alias("n_chars"))
    check(hilbert_shards(docs).collect(), [(7, "same")] * 3000, 24)


def test_files_have_narrow_boxes(documents, tmp_path):
    boxes = write_shards(documents, str(tmp_path / "shards"), shards=8).collect()
    assert sum(b["rows"] for b in boxes) == documents.count()
    ids = documents.agg(F.max("doc_id")).first()[0]
    assert sum(b.max_doc_id - b.min_doc_id for b in boxes) / len(boxes) < 0.9 * ids


def test_strings_with_a_common_beginning_get_cells_of_their_own(spark):
    names = [f"common_crawl_{c}" for c in "abcdefghijklmnopqrstuvw"] + ["common_crawl_\U0001f642"]
    docs = spark.range(2400).select(F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 24 + 1).cast("int")).alias("source"), F.lit(None).cast("string").alias("lang"))
    edges = edges_of(docs, ("source", "lang"), 3)
    assert edges == {"source": names[2:-1:3], "lang": []}
    cells = docs.groupBy(cell_of(docs, {"source": edges["source"]}, 3).alias("cell")).count().collect()
    assert sorted((r.cell, r["count"]) for r in cells) == [(i, 300) for i in range(8)]
    hot = docs.select(F.when(F.rand(1) < 0.6, "common_crawl_m").otherwise(F.col("source")).alias("source"))
    values = sorted((r.source for r in hot.collect()), key=str.encode)
    assert edges_of(hot, ("source",), 3)["source"] == sorted({values[300 * i - 1] for i in range(1, 8)})
