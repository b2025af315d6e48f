"""Approximate search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.operators import ann, blocks, search

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").cache()


@pytest.fixture(scope="module")
def queries(table):
    return table.where("vec_id % 20 = 0")


@pytest.fixture(scope="module")
def truth(table):
    rows = sorted(table.collect(), key=lambda r: r.vec_id)
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    own = np.flatnonzero(ids % 20 == 0)
    return {int(ids[i]): [int(ids[j]) for j in np.lexsort((ids, -(v @ v[i])))[:10]] for i in own}


@pytest.fixture(scope="module")
def codes(table):
    return ann.ProductCodes.fit(blocks.unit_rows(table, "vec_id", "embedding"))


def recall(found, truth):
    hits = [(r.query_id, r.cx_id) for r in found.collect()]
    return sum(x in truth[q] for q, x in hits) / sum(map(len, truth.values()))


def test_blocks_find_the_exact_top(spark, table, queries, truth, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS_PER_BLOCK", 50)
    monkeypatch.setattr(blocks, "QUERIES_PER_BLOCK", 7)
    assert recall(search.knn_many(table, queries, 10), truth) == 1
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = search.knn_many(odd, odd, 5).collect()
    assert sorted((r.query_id, r.cx_id) for r in got) == [(1, 1), (1, 5), (5, 1), (5, 5)]
    assert search.knn_many(odd.limit(0), odd, 5).count() == 0


def test_codes_are_a_byte_for_each_part_and_score_as_tables_say(spark, table, codes):
    rows = codes.encode(blocks.unit_rows(table, "vec_id", "embedding"))
    q = np.array(table.where("vec_id = 0").first().embedding, float)
    q /= np.linalg.norm(q)
    got = rows.select("id", "v", codes.score(F.col("v"), q.tolist()).alias("s")).collect()
    assert {len(r.v) for r in got} == {16} and len(got) == table.count()
    for r in got[:50]:
        x = np.concatenate([codes.books[p, c] for p, c in enumerate(r.v)])
        assert r.s == pytest.approx(float(q @ x))


def test_codes_with_reranking_recall(table, queries, truth, codes):
    rows = codes.encode(blocks.unit_rows(table, "vec_id", "embedding"))
    hits = blocks.top(rows, blocks.unit_rows(queries, "vec_id", "embedding"), 50, codes.scores, 4)
    hits = search.top_k(hits, 50, ["query_id"])
    assert recall(ann.exact(hits, table, queries, 10, "vec_id", "embedding"), truth) >= 0.97


def test_cells_probe_folders_only(table, queries, truth, codes, tmp_path):
    cells = ann.CellTable(table, str(tmp_path / "cells"), codes=codes)
    assert len(cells.centers) <= 64
    assert cells.table.select("id").distinct().count() == table.count()
    assert cells.table.where("home").count() == table.count()
    assert recall(cells.search_many(queries, 10, probes=4), truth) >= 0.9
    q = list(map(float, table.where("vec_id = 40").first().embedding))
    plan = cells.candidates(q, 4, 100)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "ReadSchema: struct<id:bigint,v:binary>" in plan
    one = [r.cx_id for r in cells.search(q, 10).collect()]
    many = [r.cx_id for r in cells.search_many(table.where("vec_id = 40"), 10).orderBy(F.col("score").desc(), "cx_id").collect()]
    assert one == many and len(set(one) & set(truth[40])) >= 8


def test_graph_recall_and_rounds(table, queries, truth, codes):
    g = ann.NeighbourGraph(table, codes=codes)
    assert g.rounds < 8  # ended by itself
    own = g.near.join(queries.select(F.col("vec_id").alias("node")), "node").where("score < 0.999999").select(F.col("node").alias("query_id"), F.col("nbr").alias("cx_id"))
    without_self = {q: [x for x in t if x != q] for q, t in truth.items()}
    assert recall(own, without_self) >= 0.85
    found = g.search_many(queries, 10, beam=40, width=10)
    assert recall(found, truth) >= 0.9  # 40 of 2,000 vectors are fetched for a query
    degree = g.edges.groupBy("node").count().agg(F.max("count"), F.count("*")).first()
    assert degree[1] == table.count()


def test_a_walk_that_cannot_end_fails(spark, codes, table):
    g = ann.NeighbourGraph(table.limit(200), degree=4, sample=4, codes=codes)
    with pytest.raises(ValueError):
        g.walk(table.where("vec_id = 0"), beam=100, width=1, max_hops=2)
