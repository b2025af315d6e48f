"""Queries of operators/retrieval.py and of the vector, path and token functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as H
from ..functions import temporal as T
from ..functions import vectors as V
from ..operators import ann as A
from ..operators import retrieval as X
from ..operators import search as S
from ..operators.lineage import shared_path
from ..registry import _DAY, _HOUR, _RANKED, _bm25_sql, _cos_sql, _ranked, QUERY, _QL, query, r6, read

_TERMS = ["idiot", "thing", "estion"]


@query("bm25_postings", _bm25_sql(_TERMS, "or") + " ORDER BY score DESC, cx_id LIMIT 25")
def _(s, d):
    return X.Postings.build(read(s, d, "documents")).search(_TERMS, "or", 25).select("cx_id", r6("score").alias("score"))


@query("bm25_postings_and", _bm25_sql(["the", "thing"], "and"))
def _(s, d):
    return X.Postings.build(read(s, d, "documents")).search(["the", "thing"], "and").select("cx_id", r6("score").alias("score"))


@query("unicode_tokens", r"SELECT doc_id, len(w) AS n, len(list_distinct(w)) AS kinds FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents)")
def _(s, d):
    w = X.unicode_tokens(F.coalesce("text", F.lit("")))
    return read(s, d, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("kinds"))


@query("name_parts", "SELECT p_partkey, array_to_string([lower(x) FOR x IN regexp_extract_all(replace(p_name, ' ', '_') || 'Brand' || replace(p_brand, '#', 'Nr'), '[A-Z]?[a-z]+|[0-9]+|[A-Z]+')], ' ') AS parts FROM part")
def _(s, d):
    name = F.concat(F.translate("p_name", " ", "_"), F.lit("Brand"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("Nr")))
    return read(s, d, "part").select("p_partkey", F.array_join(X.name_parts(name), " ").alias("parts"))


@query("fused_order", f"SELECT cx_id, score, CAST(row_number() OVER (ORDER BY score DESC, cx_id) AS INTEGER) AS rank FROM (SELECT cx_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM {_RANKED} GROUP BY cx_id) ORDER BY score DESC, cx_id LIMIT 10")
def _(s, d):
    return X.fused_top(S.rrf(_ranked(s, d)).withColumn("score", F.round("score", 9)), 10)


@query("profile_rrf", f"SELECT cx_id, round(sum(w / (60 + rank)), 9) AS score FROM {_RANKED} r JOIN (VALUES (1, 1.0::DOUBLE), (2, 0.5::DOUBLE), (3, 1.0::DOUBLE / 3)) t(slot, w) ON r.slot = t.slot GROUP BY cx_id")
def _(s, d):
    """The civic profile; its fourth slot is not in this panel."""
    return X.profile_fuse(_ranked(s, d), "civic").select("cx_id", F.round("score", 9).alias("score"))


@query("planned_integer_rrf", f"SELECT cx_id, CAST(sum((CASE slot WHEN 0 THEN 1000 WHEN 1 THEN 700 WHEN 2 THEN 500 ELSE 250 END) * 1000000 // (60 + rank)) AS BIGINT) AS score FROM {_RANKED} GROUP BY cx_id")
def _(s, d):
    return X.planned_integer_rrf(_ranked(s, d), {0: 1000, 1: 700, 2: 500, 3: 250})


@query("staged_fuse_fallback", f"SELECT cx_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM {_RANKED} GROUP BY cx_id")
def _(s, d):
    """No slot 9 in the panel: all slots are fused."""
    return X.staged_fuse(_ranked(s, d), 9).select("cx_id", F.round("score", 9).alias("score"))


@query("single_lens", f"SELECT cx_id, score, CAST(rank AS INTEGER) AS rank FROM {_RANKED} WHERE slot = 2")
def _(s, d):
    return X.single_lens(_ranked(s, d), 2)


_AROUND = "(" + " UNION ALL ".join(
    f"SELECT {k} AS slot, e.vec_id AS cx_id, {_cos_sql(f'e.embedding[{16 * k + 1}:{16 * k + 16}]::DOUBLE[]', f'a.embedding[{16 * k + 1}:{16 * k + 16}]::DOUBLE[]')} AS score FROM embeddings e, embeddings a WHERE a.vec_id = 7 AND e.vec_id <> 7" for k in range(4)
) + ")"
_AROUND_TOP = f"(SELECT * FROM (SELECT slot, cx_id, score, row_number() OVER (PARTITION BY slot ORDER BY score DESC, cx_id) AS rank FROM {_AROUND}) WHERE rank <= 60)"


@query("lens_neighbours", f"SELECT slot, cx_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM {_AROUND_TOP}")
def _(s, d):
    return X.lens_neighbours(read(s, d, "embeddings"), 7, 16, 60).select("slot", "cx_id", r6("score").alias("score"), "rank")


@query("compare_lenses", f"SELECT x.slot AS a, y.slot AS b, count(*) AS shared FROM {_AROUND_TOP} x JOIN {_AROUND_TOP} y ON x.cx_id = y.cx_id AND x.slot < y.slot GROUP BY 1, 2")
def _(s, d):
    return X.compare_lenses(X.lens_neighbours(read(s, d, "embeddings"), 7, 16, 60))


@query("guarded_search", f"SELECT * FROM (SELECT vec_id AS cx_id, round({_cos_sql('embedding::DOUBLE[]', _QL)}, 6) AS score FROM embeddings ORDER BY {_cos_sql('embedding::DOUBLE[]', _QL)} DESC, vec_id LIMIT 200) WHERE score >= 0.15")
def _(s, d):
    return X.guarded(S.knn(read(s, d, "embeddings"), QUERY, 200).withColumn("score", r6("score")), 0.15)


@query("rerank_hook", f"SELECT cx_id, score, round(score * 0.5::DOUBLE + len(text) / 1000.0::DOUBLE, 6) AS rerank_score FROM ({_bm25_sql(_TERMS, 'or')}) JOIN documents ON doc_id = cx_id")
def _(s, d):
    docs = read(s, d, "documents")
    hits = S.bm25(docs, _TERMS).withColumn("score", r6("score")).join(docs.select(F.col("doc_id").alias("cx_id"), "text"), "cx_id")
    out = X.rerank(hits, lambda pdf: pdf["score"] * 0.5 + pdf["text"].str.len() / 1000, ["score", "text"])
    return out.withColumn("rerank_score", r6("rerank_score"))


@query("dual_index", f"SELECT cx_id, round(max(score * CASE WHEN slot % 2 = 0 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END), 6) AS score FROM {_RANKED} GROUP BY cx_id")
def _(s, d):
    sided = _ranked(s, d).withColumn("side", F.when(F.col("slot") % 2 == 0, "cause").otherwise("effect"))
    return X.directed(sided, "both", {"cause": 1.0, "effect": 0.8}).withColumn("score", r6("score"))


_C = _cos_sql("q.embedding::DOUBLE[]", "e.embedding::DOUBLE[]")


@query("knn_graph", f"SELECT src, dst, round(w, 6) AS weight FROM (SELECT q.vec_id AS src, e.vec_id AS dst, {_C} AS w, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_C} DESC, e.vec_id) AS k FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0) WHERE k <= 10")
def _(s, d):
    e = read(s, d, "embeddings")
    return X.knn_graph(e, e.where("vec_id % 20 = 0"), 10).withColumn("weight", r6("weight"))


@query("vector_maths", "WITH v AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings) SELECT vec_id, round(sqrt(list_inner_product(a, a)), 6) AS norm, round(list_inner_product(a, b), 6) AS dot, round(list_sum([(a[i] - b[i]) * (a[i] - b[i]) FOR i IN range(1, 33)]), 6) AS l2, round(list_sum([a[i] * b[i] * i FOR i IN range(1, 33)]), 6) AS inter, round(a[5] / sqrt(list_inner_product(a, a)), 6) AS unit5 FROM v")
def _(s, d):
    v = read(s, d, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    a, b = F.col("a"), F.col("b")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda x, y: x + y)
    weighted = F.transform(V.interaction(a, b), lambda x, i: x * (i + 1))
    return v.select("vec_id", r6(V.norm(a)).alias("norm"), r6(V.dot(a, b)).alias("dot"), r6(total(F.transform(V.delta(a, b), lambda x: x * x))).alias("l2"), r6(total(weighted)).alias("inter"), r6(V.normalised(a)[4]).alias("unit5"))


@query("int8_codes", "SELECT vec_id, CAST(list_sum([abs(c) FOR c IN codes]) AS BIGINT) AS mass, CAST(list_max([abs(c) FOR c IN codes]) AS INTEGER) AS top FROM (SELECT vec_id, [CAST(round(x * 127 / m) AS BIGINT) FOR x IN v] AS codes FROM (SELECT vec_id, embedding::DOUBLE[] AS v, list_max([abs(x) FOR x IN embedding::DOUBLE[]]) AS m FROM embeddings))")
def _(s, d):
    c = F.transform(V.int8_max_abs(F.col("embedding")), F.abs)
    return read(s, d, "embeddings").select("vec_id", F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y).alias("mass"), F.array_max(c).alias("top"))


@query("hamming_distance", "SELECT e.vec_id, CAST(list_sum([CASE WHEN (e.embedding[i] > 0) <> (a.embedding[i] > 0) THEN 1 ELSE 0 END FOR i IN range(1, 65)]) AS BIGINT) AS bits FROM embeddings e, embeddings a WHERE a.vec_id = 7")
def _(s, d):
    """Sign codes of all 64 components against one row's."""
    e = read(s, d, "embeddings").select("vec_id", V.sign_bits(F.col("embedding")).alias("code"))
    at = e.where("vec_id = 7").select(F.col("code").alias("other"))
    return e.crossJoin(F.broadcast(at)).select("vec_id", V.hamming(F.col("code"), F.col("other")).alias("bits"))


@query("circular_score", f"SELECT event_id, round(1 - least(abs(h - 22), 24 - abs(h - 22)) / 12.0::DOUBLE, 6) AS hour_score, round(1 - least(abs(w - 1), 7 - abs(w - 1)) / 3.5::DOUBLE, 6) AS day_score FROM (SELECT event_id, {_HOUR} AS h, {_DAY} AS w FROM events)")
def _(s, d):
    t = T.epoch("ts")
    return read(s, d, "events").select("event_id", r6(T.circular_score(T.hour(t), 22, 24)).alias("hour_score"), r6(T.circular_score(T.weekday(t), 1, 7)).alias("day_score"))


@query("url_path", "SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p FROM pages)")
def _(s, d):
    return read(s, d, "pages").select("page_id", H.url_path(F.col("url")).alias("path"))


@query("path_proximity", "WITH p AS (SELECT p_partkey, string_split(replace(p_type, ' ', '/'), '/') AS a, string_split('STANDARD/ANODIZED/TIN', '/') AS b FROM part) SELECT p_partkey, round((CASE WHEN a[1] IS DISTINCT FROM b[1] THEN 0 WHEN a[2] IS DISTINCT FROM b[2] THEN 1 WHEN a[3] IS DISTINCT FROM b[3] THEN 2 ELSE 3 END) / CAST(greatest(len(a), 3) AS DOUBLE), 6) AS near FROM p")
def _(s, d):
    return read(s, d, "part").select("p_partkey", r6(H.proximity(F.translate("p_type", " ", "/"), F.lit("STANDARD/ANODIZED/TIN"))).alias("near"))


@query("cell_search")
def _(s, d):
    """4 of at most 64 cells of 30 rows or more by product codes; 200 rows of a query are decided by their vectors."""
    e = read(s, d, "embeddings")
    table = A.CellTable(e, shared_path(s, "cells"), cells=max(4, min(64, e.count() // 30)), ratio=1.2, copies=16)
    return table.search_many(e.where("vec_id % 20 = 0"), 20, rerank=200).withColumn("score", r6("score"))


@query("graph_search")
def _(s, d):
    """Beam search over a neighbour graph by product codes; the beam is decided by its vectors."""
    e = read(s, d, "embeddings")
    return A.NeighbourGraph(e).search_many(e.where("vec_id % 20 = 0"), 20).withColumn("score", r6("score"))


@query("neighbour_graph")
def _(s, d):
    """The neighbours that the rounds found, before thinning: 24 of every row."""
    return A.NeighbourGraph(read(s, d, "embeddings")).near.select("node", "nbr", r6("score").alias("score"))
