"""Registered queries of the operators: thin adapters to the contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_counts import bpe_counts
from .byte_bpe import byte_bpe
from .common import crc_of_id, table
from .ctw_score import ctw_score
from .ffd_packing import ffd_packing
from .hilbert_shards import hilbert_shards
from .lsh_forest import jaccard_join
from .lz_fingerprint import lz_neighbours
from .mix_sources import mix_sources
from .phrase_parsing import collocations
from .suffix_levels import suffix_dedup
from .term_transducer import divergence_audit
from .tput_topk import top_k
from .weak_toxicity import CUT, FOLDS, HELD_OUT, weak_toxicity

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return keep


@query("op1_hilbert_shards")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "curve")


@query("op2_weak_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = weak_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (crc_of_id() % FOLDS == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= CUT).cast("int").alias("predicted"))


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op3_bpe_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def packing(docs: DataFrame) -> DataFrame:
    import public_tokenizers
    return ffd_packing(docs, tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op4_ffd_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing(table(spark, sf_dir, "documents"))


@query("op5_lz_fingerprint")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_neighbours(table(spark, sf_dir, "documents"))


@query("op6_lsh_forest")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copies")


@query("op7_suffix_levels")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


@query("op8_ctw_score")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw_score(table(spark, sf_dir, "documents"))


@query("op9_tput_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op10_mix_sources")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "times")


@query("op11_term_transducer", r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), g AS (SELECT DISTINCT lang, source FROM d
), o AS (SELECT id, lang, source, unnest(terms) AS term FROM d
), kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 30
), v AS (SELECT g.lang, count(kept.term) AS v FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN kept ON kept.lang = g.lang GROUP BY g.lang
), c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY lang, source, term
), cells AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n
  FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), p AS (
  SELECT lang, source, term, n,
         1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p
  FROM cells JOIN v USING (lang)
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM cells GROUP BY lang, term) JOIN v USING (lang)
), pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(s.value, 0) AS value
  FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
             FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL) s
    ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
), terms AS (
  SELECT p.lang, p.source, p.term AS item, p.p - q.q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(table(spark, sf_dir, "documents")).select("lang", "source", "part", "item", "value", "rank")


@query("op12_byte_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    rows = byte_bpe(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op13_phrase_parsing", r"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS words
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase
  FROM places JOIN (VALUES (1), (2), (3), (4)) t(k) ON i + k - 1 <= len(words)
), f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30
), total AS (SELECT lang, sum(len(words)) AS n FROM pieces GROUP BY lang
), cand AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS words FROM f WHERE k >= 2
), cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM cand
), sides AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.n AS l, r.n AS r, CAST((2000000::HUGEINT * c.a) // (l.n + r.n) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1:c.cut], ' ')
              JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[c.cut + 1:], ' ')
), least AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), held AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(words[i:i + m - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, k)) AS i FROM cand WHERE k >= 3) JOIN (VALUES (2), (3)) t(m) ON m < k AND i + m - 1 <= k)
  GROUP BY lang, phrase
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, s.l, s.r, total.n, s.score
  FROM least s JOIN total ON total.lang = s.lang LEFT JOIN held h ON h.lang = s.lang AND h.phrase = s.phrase
  WHERE h.longer IS NULL OR 100 * h.longer < 80 * s.a)
WHERE rank <= 2000
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
