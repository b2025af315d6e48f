"""Findings of round 4."""

import numpy as np

from pyspark.sql import functions as F

from tesserine import registry
from tesserine.llm import lm_scoring
from tesserine.operators import ann, indexing, search

SF = "/root/testdata/sf0.001"


def test_knn_cosine_all_asks_every_row(spark):
    ids = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()}
    near = registry.queries()["knn_cosine_all"](spark, SF).collect()
    assert {r.query_id for r in near} == ids and len(near) == 20 * len(ids)
    assert "% 20" not in registry.oracle_sql()["knn_cosine_all"]


def test_copies_of_a_vector_rank_by_id_wherever_they_lie(spark):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(301, 61)), 7, axis=0)
    at = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), x[i].tolist()) for i in at], "vec_id long, embedding array<double>").coalesce(1)
    got = {}
    for r in search.knn_many(df, df, 10).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.cx_id))
    for i, near in got.items():
        near = sorted(near)
        assert [c for _, c in near[:7]] == list(range(i // 7 * 7, i // 7 * 7 + 7)) and len({s for s, _ in near[:7]}) == 1
        assert [c for _, c in near[7:]] == list(range(near[7][1] // 7 * 7, near[7][1] // 7 * 7 + 3))


def test_blind_spots_calibrated_asks_every_row(spark):
    """Percentiles are shares of all rows' differences, not of every twentieth row's."""
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    alerts = registry.queries()["blind_spots_calibrated"](spark, SF).collect()
    assert len(alerts) >= 0.4 * n - 1 and any(r.cx_id % 20 for r in alerts)
    assert "% 20" not in registry.oracle_sql()["blind_spots_calibrated"]


def test_walk_goes_on_until_every_beam_is_open(spark):
    """One node opened in a hop: at least as many hops as the beam has nodes, more than the former 20."""
    v = np.random.default_rng(4).normal(size=(120, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    g = ann.NeighbourGraph(df, degree=6, sample=4, rounds=1, codes=ann.ProductCodes(np.random.default_rng(5).normal(size=(4, 16, 4))))
    got = {(r.query_id, r.node) for r in g.walk(df.where("vec_id < 2"), beam=22, width=1).collect()}
    assert len(got) == 44


def test_several_passes_score_as_one_pass_does(spark):
    """Documents of several segments are added up in chunks like those of one; copies and null ids keep their rows."""
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    d = d.unionByName(d.where("doc_id < 5")).unionByName(d.where("doc_id < 3").select(F.lit(None).cast("long").alias("doc_id"), "text")).repartition(3)
    one, many = (sorted(map(str, lm_scoring.score(d, segment_bytes=n).collect())) for n in (384 << 20, 300_000))
    assert one == many


def test_embeddings_are_a_row_for_each_document_by_both_ways(spark, monkeypatch):
    """Repeated ids are one document; terms that are broadcast and terms that are joined give the same vectors."""
    texts = [(0, "red green blue red"), (1, "green blue"), (1, "red"), (2, ""), (None, "blue grey")]
    docs = spark.createDataFrame(texts, "id long, text string")
    out = []
    for most in (indexing.MOST_SHARED, 0):
        monkeypatch.setattr(indexing, "MOST_SHARED", most)
        rows = indexing.embedded(docs, "id", search.tokens(F.col("text")))
        assert rows.columns == ["id", "v"] and rows.count() == 2
        out.append({r.id: np.array(r.v) for r in rows.collect()})
    assert all(np.abs(out[0][i] - out[1][i]).max() < 1e-12 for i in (0, 1))
