"""Five operators as a corpus pipeline: raw documents in, packed training sequences out.

Every stage takes all rows that the one before it kept, and its decisions take
effect in its output: toxic rows go, one row of each near-duplicate group
stays, repeated passages are cut out of the texts, rows are taken as often as
the mix of sources wants them, and what is left is packed.  Between stages,
rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, saved, table
from tidemark.llm.lsh_forest import jaccard_join
from tidemark.llm.mix_sources import mix_sources
from tidemark.llm.queries import packing
from tidemark.llm.suffix_levels import suffix_dedup
from tidemark.llm.weak_toxicity import CUT, ToxicityModel

#: No SQL of the stages exists; tests/llm/test_pipeline.py holds them against plain Python.
ORACLE_SQL = None


def with_keys(docs: DataFrame, *keys: str) -> tuple[DataFrame, list[str]]:
    """The rows of ``docs`` as one struct ``row``, so that no column of theirs clashes, beside key
    columns that are never null (of columns ``keys`` and of the text); and the names of these."""
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key")
    named = [F.xxhash64(F.col(k), F.col(k).isNull()).alias(f"{k}_key") for k in keys]
    return docs.select(F.struct("*").alias("row"), *named, text), [*(f"{k}_key" for k in keys), "text_key"]


def keyed(rows: DataFrame, *keys: str) -> DataFrame:
    """The same key columns for an operator's result, which has text_hash instead of the text."""
    named = {f"{k}_key": F.xxhash64(F.col(k), F.col(k).isNull()) for k in keys}
    return rows.withColumns(named | {"text_key": F.col("text_hash")})


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the cut.  Null and empty texts have a score like any other; equal texts
    have equal scores, so repeated rows go or stay together; no rows: none."""
    model = ToxicityModel(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "__score")
    return model.scored(docs, score).where(F.col(score) < CUT).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: the smallest id (null last), of equal ids the smallest text hash, of
    rows with equal id and text any.  Null, empty and blank texts are one class; no rows: none."""
    joined = jaccard_join(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    kept = keyed(joined.groupBy("class_key").agg(first).select("first.doc_id", "first.text_hash"), "doc_id")
    rows, keys = with_keys(docs, "doc_id")
    return rows.join(kept, keys, "left_semi").dropDuplicates(keys).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier text (smaller id, null last) has; rows of which
    nothing is left go.  Null and empty texts stay as they are; no rows: none."""
    removed = free_name(docs, "__removed_bytes")
    cut = suffix_dedup(docs, whole_rows=True, removed=removed)
    touched = F.col(removed) > 0
    return cut.where(~touched | (F.col("text") != "")) \
        .withColumn("n_chars", F.when(touched, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, at most three times.  Null is a source of its own, the
    last; rows without words are taken as the mix says, at no cost; rows with equal id, source and
    text are told apart by a number, any of them by any; no rows: none."""
    taken = keyed(mix_sources(docs).where("times > 0"), "doc_id", "source") \
        .select("doc_id_key", "source_key", "text_key", F.col("copy").cast("int").alias("copy"), "times")
    rows, keys = with_keys(docs, "doc_id", "source")
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)) - 1)
    return rows.join(taken, [*keys, "copy"]).select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences.  Null and empty texts are their
    end token alone; repeated rows are packed each; no rows: none."""
    return packing(docs)


STAGES = [("toxicity", toxicity), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages),
          ("source mixture", mixture), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
