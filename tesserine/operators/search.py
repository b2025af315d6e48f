"""Retrieval: exact kNN, BM25, MaxSim, rank fusion, agreement between lenses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import blocks
from .lineage import cut

# Fixed values of ranking.
RRF_K, BM25_K1, BM25_B = 60, 1.2, 0.75
#: Lanes of queries where all rows are queries.
ALL_LANES = 16


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _is(term: str):
    return lambda x: x == term


def top_k(scores: DataFrame, k: int, by: list[str], id_col: str = "cx_id", score: str = "score") -> DataFrame:
    """Ranks 1..k per group: score descending, id ascending."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(id_col).asc())
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Exact top k by cosine; one scan, then one bounded heap per task (TakeOrderedAndProject)."""
    s = vectors.select(F.col(id_col).alias("cx_id"), V.cosine(F.col(vec_col), V.literal(query)).alias("score"))
    return s.where(F.col("score").isNotNull()).orderBy(F.col("score").desc(), "cx_id").limit(k)


def knn_many(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", query_lanes: int = 8) -> DataFrame:
    """(query_id, cx_id, score): exact top k by cosine for every row of ``queries``; zero and null vectors have no score.

    One pass: blocks of queries meet blocks of rows, and each meeting keeps its best k per query. Where all rows are
    queries, ``query_lanes`` of ``ALL_LANES`` copy either side as often.
    """
    lanes = min(2 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, 8 * blocks.MOST_LANES // query_lanes))
    found = blocks.top(blocks.unit_rows(vectors, id_col, vec_col), blocks.unit_rows(queries, id_col, vec_col), k, blocks.dots, lanes, query_lanes, blocks.settled_dots)
    return top_k(found, k, ["query_id"]).drop("rank")


def bm25(docs: DataFrame, terms: list[str], mode: str = "or", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(cx_id, score) for the query's terms; ``and`` requires all of them.

    Only the query's postings leave the scan; corpus statistics are one row.
    """
    terms = list(dict.fromkeys(terms))
    d = docs.select(F.col(id_col).alias("cx_id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    d = d.select("cx_id", F.size("w").alias("len"), *[F.size(F.filter("w", _is(t))).alias(f"tf{i}") for i, t in enumerate(terms)])
    d = cut(d)  # texts are tokenised once; a row holds its length and the counts of the query's terms
    st = d.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))]).first()
    j = d.where(" OR ".join(f"tf{i} > 0" for i in range(len(terms))))
    score = F.lit(0.0)
    for i in range(len(terms)):
        df = st[f"df{i}"] or 0
        idf = F.ln(F.lit((st["n"] - df + 0.5) / (df + 0.5) + 1))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / F.lit(st["avg"])))
    if mode == "and":
        j = j.where(" AND ".join(f"tf{i} > 0" for i in range(len(terms))))
    return j.select("cx_id", score.alias("score"))


def rrf(ranked: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(slot, cx_id, rank) -> (cx_id, score): sum of w / (60 + rank); a slot without a weight is skipped."""
    r = ranked if weights is None else ranked.join(F.broadcast(weights), "slot").where("w > 0")
    w = F.lit(1.0) if weights is None else F.col("w")
    return r.groupBy("cx_id").agg(F.sum(w / (F.lit(RRF_K) + F.col("rank"))).alias("score"))


def integer_rrf(ranked: DataFrame, weight_millis: int = 1000) -> DataFrame:
    return ranked.groupBy("cx_id").agg(F.sum(F.expr(f"({weight_millis} * 1000000L) div ({RRF_K} + rank)")).alias("score"))


def pipeline_fuse(ranked: DataFrame, stage1: DataFrame) -> DataFrame:
    """Fusion over the candidates of the first stage only."""
    return rrf(ranked.join(stage1.select("cx_id").distinct(), "cx_id", "left_semi"))


def maxsim(query: list[list[float]], tokens_: DataFrame) -> DataFrame:
    """tokens (cx_id, tv): the sum over query vectors of the best cosine per cx_id; one aggregate."""
    best = [F.max(V.cosine(V.literal(q), F.col("tv"))) for q in query]
    return tokens_.groupBy("cx_id").agg(sum(best[1:], best[0]).alias("score"))


def agreement(scores: DataFrame) -> DataFrame:
    """(slot, cx_id, score) -> agree = min, disagree = max - min over at least two lenses."""
    g = scores.groupBy("cx_id").agg(F.min("score").alias("agree"), (F.max("score") - F.min("score")).alias("disagree"), F.count(F.lit(1)).alias("lenses"))
    return g.where("lenses >= 2")
