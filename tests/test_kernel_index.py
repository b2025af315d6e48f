"""The kernel index: bounded regions, copies of rows, recall."""

import numpy as np
from pyspark.sql import functions as F

from tesserine.operators import ann, graph
from tesserine.operators.kernel_index import KernelIndex, sampled_kernel
from tesserine.registered import maps

RNG = np.random.default_rng(11)


def _vectors(spark, v):
    return spark.createDataFrame([(i, None if x is None else x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")


def test_regions_do_not_grow_with_the_rows(spark, tmp_path):
    v = [*RNG.standard_normal((1200, 32)), None, np.zeros(32)]
    _vectors(spark, v).write.parquet(str(tmp_path / "embeddings.parquet"))
    e, index = maps._index(spark, str(tmp_path))[0], maps._index(spark, str(tmp_path))[-1]
    assert index.kernel.count() == 128
    placed = index.table.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("homes"))
    assert sorted(map(tuple, placed.collect())) == [(i, 4, 1) for i in range(1200)]
    assert index.recall(e, e.where("vec_id % 20 = 0"), 10, regions=24).agg(F.avg("ratio")).first()[0] >= 0.9


def test_copies_are_found_once_and_leave_all_their_regions(spark, tmp_path):
    v = RNG.standard_normal((200, 8))
    rows = _vectors(spark, v)
    kernel = spark.createDataFrame([(str(i), i + 1) for i in range(12)], "node string, rank int")
    index = KernelIndex(rows, kernel, str(tmp_path / "k"), copies=3)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = np.argsort(-(unit @ unit[7]), kind="stable")[:5].tolist()
    assert [r.cx_id for r in index.search(v[7].tolist(), 5, regions=12).orderBy(F.col("score").desc()).collect()] == want
    assert index.recall(rows, rows, 5, regions=12).agg(F.min("ratio")).first()[0] == 1.0
    found = index.answer(rows, spark.createDataFrame([("0", 0)], "node string, hop int"), 5, regions=12)
    assert found.count() == 1000 and found.select("query_id", "cx_id").distinct().count() == 1000
    home = {r.id: r.region for r in index.table.where("home").collect()}
    assert home == dict(enumerate(((unit @ unit[:12].T).argmax(axis=1) + 1).tolist()))
    index.refresh(_vectors(spark, v[:1]).select(F.lit(150).cast("long").alias("vec_id"), "embedding"), spark.createDataFrame([(20,)], "vec_id long"))
    n = {r.id: r["count"] for r in index.table.groupBy("id").count().collect()}
    assert set(n) == set(range(200)) - {20} and set(n.values()) == {3}
    assert {r.cx_id for r in index.search(v[0].tolist(), 2, regions=2).collect()} == {0, 150}


def test_a_sampled_kernel_of_copies_and_of_one_row(spark):
    same = RNG.standard_normal(8)
    few = RNG.standard_normal((30, 8))
    got = sampled_kernel(_vectors(spark, [*few, *[same] * 300]), ["0"], 0.25, most=64)
    assert got.count() == 8 and sum(int(r.node) >= 30 for r in got.collect()) <= 1
    assert [r.node for r in sampled_kernel(_vectors(spark, few[:1]), ["0"], 0.25).collect()] == ["0"]


def test_a_graph_without_a_walk_fits_no_codes(spark, monkeypatch):
    monkeypatch.setattr(ann.ProductCodes, "fit", None)
    g = ann.NeighbourGraph(_vectors(spark, RNG.standard_normal((120, 16))), degree=4, sample=4)
    assert g.near.groupBy("node").count().where("count = 4").count() == 120


def test_hops_are_not_planned_again(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("a", "c")], "src string, dst string")
    got = graph.groundedness(edges, ["a"], 3)
    assert {r.node: r.hop for r in got.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert "Join" not in got._jdf.queryExecution().toString()
