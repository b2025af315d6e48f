"""Larger inputs, on which the operators' exact and distributed forms must give the whole result."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine import registry
from tesserine.operators import blocks, dedup, graph, recurrence, spectral

from test_queries import SF, rows

EDGE = "src string, dst string, weight double"


@pytest.fixture(scope="module")
def more_suppliers(spark, tmp_path_factory):
    """sf0.001 with 2,400 suppliers."""
    d = tmp_path_factory.mktemp("suppliers")
    for t in ("nation", "region"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    s = spark.read.parquet(f"{SF}/supplier.parquet").crossJoin(spark.range(240).withColumnRenamed("id", "i"))
    s.withColumn("s_suppkey", F.col("s_suppkey") + F.col("i") * 10).withColumn("s_nationkey", ((F.col("s_nationkey") + F.col("i")) % 25).cast("int")).drop("i").write.parquet(f"{d}/supplier.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["graph_betweenness", "graph_kernel", "spectral_communities"])
def test_large_graphs_match_sql(spark, more_suppliers, name):
    con = duckdb.connect()
    for t in ("nation", "region", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{more_suppliers}/{t}.parquet/*.parquet')")
    df = registry.queries()[name](spark, more_suppliers)
    r = con.execute(registry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in r.description], r.fetchall())


def test_feedback_vertices_only_count_nodes_on_cycles(spark, more_suppliers):
    assert sorted(r.node for r in registry.queries()["graph_feedback_vertices"](spark, more_suppliers).collect()) == [f"r{i}" for i in range(5)]


def test_a_kernel_report_of_more_than_2000_kernel_nodes(spark, more_suppliers):
    from tesserine.operators import structure

    got = structure.kernel_report(registry._edges(spark, more_suppliers), ["r0", "r3"], fraction=0.9).collect()
    assert len(got) > 2000 and {r.node for r in got if r.feedback} == {f"r{i}" for i in range(5)}


@pytest.mark.parametrize("small", [True, False])
def test_propagation_ends_where_rounds_end(spark, more_suppliers, small, monkeypatch):
    """Every nation but those of regions without a label takes its region's label; rounds alone creep towards it."""
    if not small:
        monkeypatch.setattr(graph, "SMALL_GRAPH", 10)
    e = registry._edges(spark, more_suppliers)
    region = {f"n{r.n_nationkey}": f"r{r.n_regionkey}" for r in spark.read.parquet(f"{more_suppliers}/nation.parquet").collect()}
    seeds = spark.createDataFrame([("r0", 1.0), ("r1", -1.0)], "node string, label double")
    got = {r.node: r.v for r in graph.propagate(e, seeds, 2000, 1e-4).collect()}
    assert all(abs(got[n] - {"r0": 1.0, "r1": -1.0}.get(r, 0.0)) < 1e-6 for n, r in region.items())
    assert len(got) == 2400 + 30


def test_universal_query_is_not_refused_for_its_rows(spark, tmp_path):
    """700,000 events cost more than 30 s in the model."""
    for t in ("nation", "region", "supplier", "embeddings"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.read.parquet(f"{SF}/events.parquet").crossJoin(spark.range(700).withColumnRenamed("id", "i")).drop("i").write.parquet(f"{tmp_path}/events.parquet")
    want = registry.queries()["universal_query_all"](spark, SF).first()["value"]
    assert registry.queries()["universal_query_all"](spark, str(tmp_path)).first()["value"] == want


def test_block_pairs_are_whole_and_once(spark, monkeypatch):
    """Many small blocks in two cells, against brute force."""
    monkeypatch.setattr(blocks, "ROWS_PER_BLOCK", 16)
    x = np.random.default_rng(5).normal(size=(900, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(7)
    u = x.reshape(900, 4, 16) / np.linalg.norm(x.reshape(900, 4, 16), axis=2, keepdims=True)
    s = np.min([u[:, k] @ u[:, k].T for k in range(4)], axis=0) >= 0.1
    want = sorted((int(i), int(j)) for i, j in zip(*np.nonzero(s)) if i < j)
    for _ in range(3):
        assert sorted((r.a, r.b) for r in dedup.slot_pairs(df, dict.fromkeys(range(4), 0.1), 16).collect()) == want


def test_eigenmaps_of_fewer_components_than_vectors(spark):
    """Two parts that nearly fall into two each: eigenvalues as of a dense solver."""
    e = [(f"a{i}", f"a{j}", 1.0) for i in range(8) for j in range(i) if i // 4 == j // 4] + [("a0", "a4", 0.001)]
    e += [(f"b{i}", f"b{j}", 1.0) for i in range(6) for j in range(i)]
    names = sorted({x for r in e for x in r[:2]})
    a = np.zeros((len(names), len(names)))
    for p, q, w in e:
        a[names.index(p), names.index(q)] = a[names.index(q), names.index(p)] = w
    d = a.sum(axis=1)
    want = np.sort(np.linalg.eigvalsh(np.eye(len(names)) - a / np.sqrt(np.outer(d, d))))[:3]
    maps, values = spectral.eigenmaps(spark.createDataFrame(e, EDGE), 3, tol=1e-6)
    assert np.allclose(values, want, atol=1e-6)
    x = np.array([r.x for r in maps.collect()])
    assert np.allclose(x.T @ x, np.eye(3), atol=1e-6)


@pytest.mark.parametrize("known", [500_000, 10])
def test_term_directions_do_not_move(spark, known, monkeypatch):
    """Eight directions of a term are added up where the term is: no exchange by (id, dim); both ways to meet the vocabulary agree."""
    from tesserine.operators import indexing, search

    monkeypatch.setattr(indexing, "SMALL_VOCABULARY", known)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    w = indexing.term_weights(docs, "doc_id", search.tokens(F.coalesce("text", F.lit(""))))
    summed = w.select("id", "w", F.explode(indexing.directions(F.col("term"))).alias("e")).groupBy("id", F.col("e.dim")).agg(F.sum("w"))
    keys = re.findall(r"hashpartitioning\((.*?), \d+[,)]", summed._jdf.queryExecution().executedPlan().toString())
    assert keys and not any("," in k for k in keys)
    got = {(r.id, r.dim): r.x for r in indexing.embedded(docs, "doc_id", search.tokens(F.coalesce("text", F.lit("")))).collect()}
    sizes = {}
    for (i, _), x in got.items():
        sizes[i] = sizes.get(i, 0) + x * x
    assert sizes and all(abs(s - 1) < 1e-9 for s in sizes.values())


def test_a_full_band_is_met_by_many_tasks(spark):
    """All rows within seconds: blocks of purchases bound what a row makes at once, and more than one task makes the pairs."""
    a = spark.range(20).select("id", (7200 + F.col("id") % 3).alias("t"))
    b = spark.range(5 * recurrence.BLOCK).select("id", (7210 + F.col("id") % 7).alias("t"))
    for k, v in (off := {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}).items():
        spark.conf.set(k, v)
    try:
        got = recurrence.co_occurrence(a, b, 3600).groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("ida", "idb").alias("n")).collect()
    finally:
        for k in off:
            spark.conf.unset(k)
    assert sum(r.n for r in got) == 100 * recurrence.BLOCK and len(got) > 1


def test_pairs_keep_copies_and_leave_out_rows_without_a_time(spark):
    a = spark.createDataFrame([(1, 100), (1, 100), (None, 103), (2, None)], "id long, t long")
    b = spark.createDataFrame([(7, 91), (7, 91), (None, 109), (8, 90), (9, None), (6, -5)], "id long, t long")
    got = sorted(map(str, recurrence.co_occurrence(a, b, 10).collect()))
    want = [(i, t, j, u) for i, t in [(1, 100), (1, 100), (None, 103)] for j, u in [(7, 91), (7, 91), (None, 109)] if abs(u - t) < 10]
    assert got == sorted(f"Row(ta={t}, ida={i}, tb={u}, idb={j})" for i, t, j, u in want)


def test_copies_of_events_add_no_pairs_of_times(spark, tmp_path):
    """Lag and cross K of 5 copies: 25 times the pairs, from as many rows as one copy has."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.crossJoin(spark.range(5).withColumnRenamed("id", "i")).withColumn("event_id", F.col("event_id") + 100000 * F.col("i")).drop("i").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("co_occurrence_all", "lead_lag_all", "cross_k_all"):
        df, r = registry.queries()[name](spark, str(tmp_path)), con.execute(registry.oracle_sql()[name])
        assert rows(df.columns, df.collect()) == rows([c[0] for c in r.description], r.fetchall())
    one, five = (recurrence.co_occurrence_counts(*registry._views_and_purchases(spark, d), 3600) for d in (SF, str(tmp_path)))
    assert five.count() == one.count() and five.agg(F.sum("n")).first()[0] == 25 * one.agg(F.sum("n")).first()[0]
