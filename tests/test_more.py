"""Operators without an SQL form, errors, plans and edges of the newer modules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine import registry
from tesserine.functions import paths, predicates
from tesserine.operators import dedup, events, filters, graph, guard, inference, lineage, retrieval, structure
from tesserine.plans.cypher import Cypher

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,column", [("rel_point_get", "c_custkey"), ("rel_predicates", "l_quantity"), ("rel_index_count", "o_totalprice"), ("rel_contains", "p_type"), ("flagship", "o_totalprice"), ("agg_global", "l_tax"), ("ts_range", "ts")])
def test_filters_reach_the_scan(spark, name, column):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    pushed = [x for x in plan.split("PushedFilters: [")[1:]]
    assert any(f"({column}," in p.split("ReadSchema")[0] for p in pushed)


def test_predicates_in_the_column_type(spark):
    d = spark.createDataFrame([(1, 2.0, None), (2**60, math.nan, "x"), (None, None, "y")], "a long, b double, c string")
    keep = lambda *p: [r.a for r in predicates.where_all(d, [p]).collect()]
    assert keep("a", "eq", 1.0) == [1] and keep("a", "gt", 1.5) == [2**60] and keep("a", "ne", 1) == [2**60, None]
    assert keep("c", "ne", "x") == [1, None] and keep("c", "eq", 1) == [] and keep("missing", "eq", 1) == []
    assert d.where(~predicates.field_predicate(d, "a", "eq", 1)).count() == 2


def test_running_sums_over_many_values(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(0, 700, 3000)
    n = spark.createDataFrame([(int(x),) for x in v], "v long").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    got = {r.v: r.n_before for r in lineage.running(n, "v", ["n"], parts=7).collect()}
    assert got == {int(x): int((v < x).sum()) for x in set(v.tolist())}
    assert lineage.running(n.where("false"), "v", ["n"]).count() == 0


def test_conformal_bound(spark):
    """60 bad scores and a target of 0.05: not even one false accept keeps the tail at 0.05."""
    bad = [(i / 100, True) for i in range(60)] + [(0.9, False), (0.3, False)]
    r = guard.conformal_tau(spark.createDataFrame(bad, "score double, bad boolean"), 0.05).first()
    assert r.tau == math.nextafter(0.59, 1) and (r.false_accepts, r.false_rejects) == (0, 1)
    assert guard.most_accepts(1000, 0.05, 0.05) == max(k for k in range(100) if sum(math.comb(1000, i) * 0.05**i * 0.95 ** (1000 - i) for i in range(k + 1)) <= 0.05)
    with pytest.raises(ValueError, match="of at least 50"):
        guard.conformal_tau(spark.createDataFrame(bad[:49], "score double, bad boolean"), 0.05)


def test_missing_required_slot_is_an_error(spark):
    s = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.9), (2, 0, 0.9)], "cx_id long, slot int, score double")
    with pytest.raises(Exception, match="missing slot of 2"):
        guard.verdict(s, 0.5, required=[0, 1]).collect()
    zero = spark.createDataFrame([(1, 0, 0.9), (1, 1, None)], "cx_id long, slot int, score double")
    assert guard.verdict(zero, 0.5, required=[0, 1]).first()["pass"] is False


@pytest.fixture(scope="module")
def cy(spark):
    nodes = spark.createDataFrame([(f"m{i}", "M" if i % 2 else "N", f"it's {i}" if i == 3 else f"n{i}", i) for i in range(6)], "id string, label string, name string, size int")
    edges = spark.createDataFrame([("m0", "m1", "T"), ("m1", "m2", "T"), ("m3", "m4", "U"), ("m5", "m0", "U")], "src string, dst string, type string")
    return Cypher(nodes, edges)


@pytest.mark.parametrize("text,want", [
    ("MATCH (a {name: 'n0'}) RETURN a.id AS id", [("m0",)]),
    ("MATCH (a {size: 4}) RETURN a.id AS id", [("m4",)]),
    ('MATCH (a) WHERE a.name = "it\'s 3" RETURN a.id AS id', [("m3",)]),
    ("MATCH (a) WHERE a.name = 'x AND y' OR a.size = 5 RETURN a.id AS id", [("m5",)]),
    ("MATCH (a) WHERE a.size = 2 OR EXISTS { (a)-[:U]->() } RETURN a.id AS id", [("m2",), ("m3",), ("m5",)]),
    ("MATCH (a) WHERE NOT EXISTS { (a)-[:T]->() } AND (a.size < 3 OR a.size > 4) RETURN a.id AS id", [("m2",), ("m5",)]),
    ("UNWIND ['y', 'z'] AS x RETURN x", [("y",), ("z",)]),
    ("MATCH (a:M) UNWIND [10, 20] AS k RETURN a.id AS id, k", [("m1", 10), ("m1", 20), ("m3", 10), ("m3", 20), ("m5", 10), ("m5", 20)]),
    ("MATCH (a) RETURN CASE WHEN a.size < 2 THEN 'low' WHEN a.size < 4 THEN 'mid' ELSE 'high' END AS c, count(*) AS n", [("high", 2), ("low", 2), ("mid", 2)]),
    ("MATCH (a) RETURN DISTINCT a.label AS l", [("M",), ("N",)]),
])
def test_cypher(cy, text, want):
    assert sorted(map(tuple, cy.run(text).collect())) == want


@pytest.mark.parametrize("text", ["MATCH (a) WITH a RETURN a.id", "CREATE (a) RETURN a", "FOO (a) RETURN a.id", "MATCH (a {b}) RETURN a.id", "MATCH (a) WHERE a.size RETURN a.id"])
def test_cypher_refuses(cy, text):
    with pytest.raises(ValueError):
        cy.run(text)


def test_hazard_against_integration(spark):
    times = [0, 10, 25, 31, 50, 58, 75]
    occ = spark.createDataFrame([("a", t) for t in times] + [("b", 5 * t) for t in range(6)] + [("c", 1), ("c", 2)], "key string, t long")
    got = {r.key: r for r in events.hazard(occ, 95).collect()}
    gaps = np.diff(times)
    k, s = gaps.mean() ** 2 / gaps.var(), gaps.var() / gaps.mean()
    x = np.linspace(0, 400, 400_001)
    density = x ** (k - 1) * np.exp(-x / s) / (math.gamma(k) * s**k)
    tail = np.trapezoid(density[x >= 20], x[x >= 20])
    assert set(got) == {"a", "b"}  # two occurrences are too few
    assert got["a"].survival == pytest.approx(tail, abs=1e-6) and got["a"].hazard == pytest.approx(density[20_000] / tail, rel=1e-4)
    assert got["b"].survival == 0 and got["b"].overdue and got["a"].overdue == (tail <= 0.05)


def test_cusum_finds_a_slow_down(spark):
    times = np.cumsum([10, 11, 10, 9, 10, 11, 9, 10, *[40] * 8]).tolist()
    r = events.cusum(spark.createDataFrame([("k", int(t)) for t in [0, *times]], "key string, t long")).first()
    assert r["shift"] == "slow_down" and 9 <= r.change_gap <= 11 and r.n_gaps == 16


def test_student_and_pearson(spark):
    # Known values of t on 10 degrees.
    assert inference.student_p(2.228138851986, 10) == pytest.approx(0.05, abs=1e-9)
    assert inference.student_p(0.0, 5) == pytest.approx(1)
    rng = np.random.default_rng(2)
    x = rng.standard_normal(40)
    y = 0.4 * x + rng.standard_normal(40)
    r = inference.pearson_test(spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double"), "x", "y").first()
    assert r.r == pytest.approx(np.corrcoef(x, y)[0, 1]) and r.low < r.r < r.high and 0 < r.p < 1


def test_networks(spark):
    """x -> y -> z and a bystander: the skeleton keeps the chain alone."""
    rng = np.random.default_rng(4)
    x, w = rng.standard_normal((2, 4000))
    y = x + rng.standard_normal(4000)
    z = y + rng.standard_normal(4000)
    d = spark.createDataFrame(np.stack([x, y, z, w], axis=1).tolist(), "x double, y double, z double, w double")
    assert sorted(map(tuple, inference.skeleton(d, ["x", "y", "z", "w"]).collect())) == [("x", "y"), ("y", "z")]
    got = {(r.a, r.b): r.r for r in inference.partial_network(d, ["x", "y", "z", "w"]).collect()}
    m = np.linalg.inv(np.corrcoef(np.stack([x, y, z, w])))
    assert got["x", "z"] == pytest.approx(-m[0, 2] / math.sqrt(m[0, 0] * m[2, 2])) and abs(got["x", "z"]) < 0.05 < got["x", "y"]


def test_strong_components_and_kernel_report(spark):
    cycle = [(f"c{i}", f"c{(i + 1) % 7}") for i in range(7)]
    e = spark.createDataFrame([(a, b, 1.0) for a, b in [*cycle, ("c0", "d0"), ("d0", "d1"), ("d1", "d0"), ("d1", "e")]], "src string, dst string, weight double")
    assert {r.node: r.scc for r in graph.components_strong(e).collect()} == {f"c{i}": "c0" for i in range(7)} | {"d0": "d0", "d1": "d0", "e": "e"}
    assert {(r.src, r.dst): r.n for r in graph.condensation(e, graph.components_strong(e)).collect()} == {("c0", "d0"): 1, ("d0", "e"): 1}
    assert {r.node: r.depth for r in structure.depths(e).collect()} == {f"c{i}": 2 for i in range(7)} | {"d0": 1, "d1": 1, "e": 0}
    rows = {r.node: r for r in structure.kernel_report(e, ["e"], 0.3).collect()}
    assert len(rows) == 3 and rows["d0"].component_size == 2 and not rows["d0"].gap
    assert sum(r.feedback for r in rows.values()) <= 2


def test_sampled_betweenness_scales(spark):
    e = spark.createDataFrame([(f"a{i}", f"a{i + 1}") for i in range(30)], "src string, dst string")
    exact = {r.node: r.betweenness for r in graph.betweenness(e).collect()}
    assert exact["a15"] == 15 * 15
    some = {r.node: r.betweenness for r in graph.betweenness(e, exact_nodes=5, pivots=31).collect()}
    assert some == pytest.approx(exact)
    assert 0.2 < {r.node: r.betweenness for r in graph.betweenness(e, exact_nodes=5, pivots=15).collect()}["a15"] / exact["a15"] < 3


def test_dedup_actions(spark):
    rows = spark.createDataFrame([(i,) for i in range(6)], "id long")
    pairs = spark.createDataFrame([(0, 1, False), (1, 2, False), (3, 4, True)], "a long, b long, conflict boolean")
    assert sorted(r.id for r in dedup.merged(rows, pairs, "collapse", "id").collect()) == [0, 3, 4, 5]
    assert {r.id: r.linked_to for r in dedup.merged(rows, pairs, "link", "id").collect()} == {0: None, 1: 0, 2: 0, 3: None, 4: None, 5: None}
    assert {r.id: r.occurrences for r in dedup.merged(rows, pairs, "recurrence", "id").collect()} == {0: 3, 3: 1, 4: 1, 5: 1}
    with pytest.raises(ValueError):
        dedup.merged(rows, pairs, "drop", "id")


def test_errors_of_fusion_and_filters(spark):
    twice = spark.createDataFrame([(0, 1, 1), (0, 1, 2)], "slot int, cx_id long, rank int")
    with pytest.raises(Exception, match="twice"):
        retrieval.planned_integer_rrf(twice, {0: 1000}).collect()
    with pytest.raises(Exception, match="without a weight"):
        retrieval.planned_integer_rrf(twice.limit(1), {1: 1000}).collect()
    with pytest.raises(ValueError):
        filters.scalar("m", "x", "eq", math.nan)
    with pytest.raises(ValueError):
        filters.page(twice, "rank", None, 0)


def test_paths_and_diffs(spark):
    d = spark.createDataFrame([("R100\told/a.py\tnew/a.py", "@@ -3 +4,2 @@ def f"), ("M\tx.py", "no")], "s string, h string")
    a, b = d.select(paths.name_status(F.col("s")).alias("n"), paths.hunk(F.col("h")).alias("h"), paths.proximity(F.lit("a/b/c.py"), F.lit("a/b/d.py")).alias("p")).collect()
    assert tuple(a.n) == ("R", "old/a.py", "new/a.py") and tuple(a.h) == (3, 1, 4, 2) and a.p == pytest.approx(2 / 3)
    assert tuple(b.n) == ("M", None, "x.py") and b.h is None


def test_scopes(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "b")], "src string, dst string")
    near = filters.Scope.domain(e, ["a"], radius=1)
    assert sorted(r.node for r in near.nodes.collect()) == ["a", "b"]
    assert sorted(r.node for r in near.reachable(e, 1).nodes.collect()) == ["a", "b", "c"]
    other = filters.Scope.domain(e, ["x"])
    assert sorted(map(tuple, near.union(other).edges.collect())) == [("a", "b"), ("b", "c"), ("c", "d"), ("x", "b")]
    assert near.intersect(other, e).edges.count() == 0 and len(filters.Scope.whole(e).hash()) == 64


def test_non_finite_events_are_rejected(spark):
    from tesserine.streaming import ingest

    d = spark.createDataFrame([(1, 1.5), (2, math.nan), (3, -math.inf), (4, None)], "id long, v double")
    good, bad = ingest.finite(d, ["v"])
    assert [r.id for r in good.collect()] == [1, 4] and [r.id for r in bad.collect()] == [2, 3]
