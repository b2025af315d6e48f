"""Retrieval over prepared structures: a postings table, slots with profiles, guarded and re-ranked hits, directed sides."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .lineage import cut
from .search import BM25_B, BM25_K1, RRF_K, knn_many, rrf, tokens, top_k

# The slots of each named profile, heaviest first; a slot's weight is 1 / place.
PROFILES = {
    "causal": (4, 8, 18), "code": (8, 9, 10, 11, 16), "entity": (3, 8, 18), "temporal": (8,), "speaker": (5, 8), "style": (6, 8), "civic": (1, 2, 3, 8),
    "media": (8, 9, 10), "bridge": (8, 14, 18), "kernel": (7, 8, 15), "semantic": (8,), "lexical": (1,), "multimodal": (8, 9, 10, 11), "general": (1, 8, 18),
}
#: Buckets of terms of a postings table; a query reads those of its terms only.
BUCKETS = 64


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass
class Postings:
    """An inverted table (term, cx_id, tf, len), partitioned by a hash of the term, and the corpus statistics; written once, read per term."""

    table: DataFrame
    documents: int
    mean: float

    @staticmethod
    def build(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> Postings:
        spark = docs.sparkSession
        cut(spark.range(1))  # names the shared folder
        path = path or f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/postings-{uuid.uuid4().hex}"
        d = docs.select(F.col(id_col).alias("cx_id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("w")).withColumn("len", F.size("w"))
        # Whole texts are dealt by id once, so that terms are counted where they are and only the table's own rows move.
        dealt = docs.repartition(id_col).select(F.col(id_col).alias("cx_id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("w")).withColumn("len", F.size("w"))
        terms = dealt.select("cx_id", "len", F.explode("w").alias("term")).groupBy("cx_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
        terms.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64("cx_id"), F.lit(8))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
        d.select("len").write.parquet(f"{path}/lengths")
        got = spark.read.parquet(f"{path}/lengths").agg(F.count(F.lit(1)), F.avg("len")).first()
        return Postings(spark.read.parquet(f"{path}/postings"), got[0], got[1] or 0.0)

    def search(self, terms: list[str], mode: str = "or", limit: int = 0) -> DataFrame:
        """(cx_id, score) by BM25, heaviest first and ids ascending; ``limit`` 0 returns all."""
        terms = list(dict.fromkeys(terms))
        buckets = [r[0] for r in self.table.sparkSession.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"))).collect()]
        hits = self.table.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row for each term of the query
        idf = F.ln((F.lit(self.documents) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / F.lit(self.mean))
        part = hits.join(F.broadcast(df), "term").select("cx_id", (idf * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + norm)).alias("part"))
        out = part.groupBy("cx_id").agg(F.sum("part").alias("score"), F.count(F.lit(1)).alias("found"))
        out = (out if mode == "or" else out.where(F.col("found") == len(terms))).select("cx_id", "score").orderBy(F.col("score").desc(), "cx_id")
        return out.limit(limit) if limit else out


def unicode_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def name_parts(name: Column) -> Column:
    """Lower-case parts of snake_case and camelCase names."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), F.lit(0)), F.lower)


def fused_top(scores: DataFrame, k: int) -> DataFrame:
    """The k best hits by score, ids ascending, numbered again from 1."""
    best = scores.orderBy(F.col("score").desc(), "cx_id").limit(k)
    return best.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "cx_id"))).alias("z")).select(F.posexplode("z").alias("i", "h")).select("h.cx_id", (-F.col("h.s")).alias("score"), (F.col("i") + 1).alias("rank"))


def profile_fuse(ranked: DataFrame, profile: str) -> DataFrame:
    """Rank fusion with a named profile; slots that are not in it are left out."""
    weights = [(slot, 1.0 / (i + 1)) for i, slot in enumerate(PROFILES[profile])]
    return rrf(ranked, ranked.sparkSession.createDataFrame(weights, "slot int, w double"))


def planned_integer_rrf(ranked: DataFrame, weight_millis: dict[int, int]) -> DataFrame:
    """Integer fusion; an id twice in a slot, or a slot without a weight, is an error."""
    w = ranked.sparkSession.createDataFrame(sorted(weight_millis.items()), "slot int, w long")
    once = ranked.groupBy("slot", "cx_id").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("c")).join(F.broadcast(w), "slot", "left")
    part = F.when(F.col("c") > 1, F.raise_error(F.lit("an id twice in one slot")).cast("long")).when(F.col("w").isNull(), F.raise_error(F.lit("a slot without a weight")).cast("long"))
    return once.groupBy("cx_id").agg(F.sum(part.otherwise(F.expr(f"(w * 1000000L) div ({RRF_K} + rank)"))).alias("score"))


def staged_fuse(ranked: DataFrame, stage1: int) -> DataFrame:
    """Fusion of the other slots over the candidates of one slot; over all slots if that one has none."""
    first = ranked.where(F.col("slot") == stage1)
    if first.isEmpty():
        return rrf(ranked)
    return rrf(ranked.where(F.col("slot") != stage1).join(first.select("cx_id").distinct(), "cx_id", "left_semi"))


def single_lens(ranked: DataFrame, slot: int) -> DataFrame:
    """One slot's own order."""
    return ranked.where(F.col("slot") == slot).select("cx_id", "score", "rank")


def lens_neighbours(vectors: DataFrame, anchor_id: int, width: int, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(slot, cx_id, score, rank): around an anchor, its k nearest in each slot, itself left out."""
    row = vectors.where(F.col(id_col) == anchor_id).select(vec_col).first()
    if row is None:
        raise ValueError(f"no vector {anchor_id}")
    slots = len(row[0]) // width
    cos = [F.struct(F.lit(i).alias("slot"), V.cosine(V.slot(F.col(vec_col), i, width), V.literal(row[0][i * width : (i + 1) * width])).alias("score")) for i in range(slots)]
    s = vectors.where(F.col(id_col) != anchor_id).select(F.col(id_col).alias("cx_id"), F.explode(F.array(*cos)).alias("p")).select("p.slot", "cx_id", "p.score")
    return top_k(s.where("score IS NOT NULL"), k, ["slot"])


def compare_lenses(neighbours: DataFrame) -> DataFrame:
    """(a, b, shared): how many neighbours two slots have in common."""
    n = neighbours.select("slot", "cx_id")
    return n.select(F.col("slot").alias("a"), "cx_id").join(n.select(F.col("slot").alias("b"), "cx_id"), "cx_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def guarded(hits: DataFrame, tau: float) -> DataFrame:
    """Hits at the guard's threshold or above."""
    return hits.where(F.col("score") >= tau)


def rerank(hits: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], columns: list[str]) -> DataFrame:
    """Hits with ``rerank_score`` from a scorer over batches of the given columns; it runs in Arrow batches where the hits are."""

    def run(batches):
        for pdf in batches:
            yield pdf[["cx_id", "score"]].assign(rerank_score=scorer(pdf[columns]).astype(float))

    kinds = hits.schema["cx_id"].dataType.simpleString()
    return hits.mapInPandas(run, f"cx_id {kinds}, score double, rerank_score double")


def directed(scores: DataFrame, side: str, boosts: dict[str, float]) -> DataFrame:
    """(cx_id, side, score) of a two-sided index: rows of one side or ``both``, times the side's boost; an id keeps its best."""
    s = scores if side == "both" else scores.where(F.col("side") == side)
    boost = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(boosts.items()) for x in kv]), F.col("side"))
    return s.groupBy("cx_id").agg(F.max(F.col("score") * boost).alias("score"))


def knn_graph(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Edges (src, dst, weight) from each query row to its k nearest other rows by cosine."""
    near = knn_many(vectors, queries, k + 1, id_col, vec_col).where("query_id <> cx_id")
    return top_k(near, k, ["query_id"]).select(F.col("query_id").alias("src"), F.col("cx_id").alias("dst"), F.col("score").alias("weight"))
