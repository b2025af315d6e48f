"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, embedding_dedup, fingerprints, importance, line_dedup, lm_scoring, mixing, ngram_join, packing, sharding, suffix_dedup, token_counts, toxicity
from .sql import IMPORTANCE_SQL, SHARDING_SQL, centroids_sql


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_pairs(_read(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_spans(_read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", "severity", F.element_at("p_grades", 1).alias("p_toxic"), "rejected")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_read(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_read(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_read(spark, sf_dir, "embeddings"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_plan(_read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_fingerprints, op2_suffix_dedup, op3_toxicity, op4_line_dedup, op5_mixing,
        op6_embedding_dedup, op7_token_counts, op8_packing, op9_lm_scoring, op10_ngram_join,
        op11_centroids, op12_sharding, op13_importance,
    )
    return {q.__name__: q for q in every}


LINE_DEDUP_SQL = """
WITH l AS (SELECT doc_id, coalesce(text, '') AS x, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
n AS (SELECT doc_id, x, unnest(range(1, len(ls) + 1)) AS p, unnest(ls) AS line FROM l),
w AS (SELECT doc_id, i AS p, md5(ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2]) AS h
      FROM l, unnest(range(1, greatest(len(ls) - 1, 1))) AS t(i)),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM w),
g AS (SELECT DISTINCT doc_id, p + d AS p FROM r, (SELECT unnest([0, 1, 2]) AS d) WHERE k > 1),
k AS (SELECT n.doc_id, count(*) AS n_lines, count(g.p) AS n_removed,
             coalesce(string_agg(n.line, chr(10) ORDER BY n.p) FILTER (WHERE g.p IS NULL), '') AS kept
      FROM n LEFT JOIN g ON n.doc_id = g.doc_id AND n.p = g.p GROUP BY n.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM k
"""

MIXING_SQL = """
WITH d AS (SELECT doc_id, source, md5('mix|' || CAST(doc_id AS VARCHAR)) AS k,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
o AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w, source_size * 3 AS cap FROM s),
c AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER z, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER z, 0) AS wrest,
             row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS n
      FROM o WINDOW z AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT n, rest, wrest FROM c WHERE rest * w <= cap * wrest ORDER BY n LIMIT 1),
t AS (SELECT c.source, c.source_size,
             CASE WHEN f.n IS NULL OR c.n < f.n THEN CAST(c.cap AS DOUBLE) ELSE least(CAST(f.rest AS DOUBLE) / CAST(f.wrest AS DOUBLE) * c.w, CAST(c.cap AS DOUBLE)) END AS target
      FROM c LEFT JOIN f ON true),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre FROM d)
SELECT p.doc_id, p.size, t.source_size, t.target,
       CAST(floor(floor(t.target) / greatest(t.source_size, 1)) * p.size
            + greatest(0, least(p.size, floor(t.target) - floor(floor(t.target) / greatest(t.source_size, 1)) * t.source_size - p.pre)) AS BIGINT) AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_line_dedup": LINE_DEDUP_SQL,
        "op5_mixing": MIXING_SQL,
        "op11_centroids": centroids_sql(),
        "op12_sharding": SHARDING_SQL,
        "op13_importance": IMPORTANCE_SQL,
    }
