import itertools

import numpy as np
import pytest

from tesserine.operators import cluster, graph, series
from tesserine import registry
from tesserine.plans import intent

RNG = np.random.default_rng(5)


def frame(spark, **cols):
    return spark.createDataFrame(list(zip(*[map(float, c) for c in cols.values()])), list(cols))


def test_transfer_entropy_and_cross_mapping_see_the_direction(spark):
    x, e = RNG.normal(size=400), RNG.normal(size=400)
    y = np.append(0, x[:-1]) + 0.2 * e
    row = series.transfer_entropy(frame(spark, t=range(400), x=x, y=y), "t", "x", "y").first()
    assert row.x_to_y > 0.5 > row.y_to_x + 0.3
    a, b = [0.4], [0.2]
    for _ in range(399):
        a.append(a[-1] * (3.8 - 3.8 * a[-1]))
        b.append(b[-1] * (3.5 - 3.5 * b[-1] - 0.1 * a[-2]))
    ccm = series.cross_mapping(frame(spark, t=range(400), x=a, y=b), "t", "x", "y").first()
    assert ccm.y_to_x > 0.8 and ccm.y_to_x > ccm.x_to_y


def test_mic_of_a_parabola_and_of_noise(spark):
    x = np.linspace(-1, 1, 200)
    assert series.mic(frame(spark, x=x, y=x * x), "x", "y").first().mic > 0.99
    assert series.mic(frame(spark, x=x, y=RNG.normal(size=200)), "x", "y").first().mic < 0.4


def test_kendall_with_ties(spark):
    assert abs(series.kendall_tau_b(frame(spark, x=[1, 1, 2, 3], y=[1, 2, 3, 3]), "x", "y").first().tau - 4 / 5) < 1e-12


def test_hawkes_finds_who_excites_whom(spark):
    a = np.sort(RNG.uniform(0, 2000, 400))
    caused = a[RNG.uniform(size=400) < 0.8]
    b = caused + RNG.exponential(0.5, len(caused))
    df = spark.createDataFrame([(float(t), "a") for t in a] + [(float(t), "b") for t in b], "t double, p string")
    got = {(r.target, r.source): r.branching for r in series.hawkes(df, "t", "p", 1.0).collect()}
    assert got["b", "a"] > 0.5 and got["a", "b"] < 0.2 and got["a", "a"] < 0.2


def test_density_clusters_and_noise():
    p = np.concatenate([RNG.normal(0, 0.1, (30, 2)), RNG.normal(5, 0.1, (30, 2)), [[20.0, -20.0]]])
    labels = cluster.density_labels(np.linalg.norm(p[:, None] - p[None], axis=2), 5, 5)
    assert labels[60] == -1 and len(set(labels[:30])) == len(set(labels[30:60])) == 1 and labels[0] != labels[30]


def test_feedback_vertices_match_brute_force(spark):
    for _ in range(5):
        pairs = {(str(a), str(b)) for a, b in RNG.integers(0, 7, (14, 2))}
        df = spark.createDataFrame(sorted(pairs), "src string, dst string")

        def acyclic(gone):
            left = {p for p in pairs if not set(p) & set(gone)}
            while left and (n := {p for p in left if p[1] in {a for a, _ in left}}) != left:
                left = n
            return not left

        least = next(k for k in range(8) if any(acyclic(c) for c in itertools.combinations("0123456", k)))
        for exact in (20, 0):
            got = graph.feedback_vertices(df, exact=exact)
            assert acyclic(got) and (exact == 0 or len(got) == least)


def test_plan_refuses_instead_of_clamping():
    assert intent.plan("Why did it fail", (1, 2), 10, 1000) == intent.SearchPlan("causal", "weighted_rrf:causal", (1, 2), 12800)
    assert intent.plan("rust trait", (), 10, 10).strategy == "single:8" and intent.plan("x", (), 1, 1).strategy == "rrf"
    for bad in ({"k": 101}, {"ef": 513}, {"slots": tuple(range(17))}, {"index_size": 10**9}):
        with pytest.raises(ValueError):
            intent.plan(**{"text": "x", "slots": (1,), "k": 100, "index_size": 10, **bad})


def test_pairs_of_all_users(spark):
    """Every view meets every purchase, and every user has a fit."""
    e = [(r.user_id, r.event_type, r.event_id, int(r.ts.timestamp())) for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").collect()]
    pairs = {(i, k): u - t for _, x, i, t in e if x == "view" for _, y, k, u in e if y == "purchase" and abs(u - t) < 3600}
    q = registry.queries()
    assert {(r.ida, r.idb): r.delta for r in q["co_occurrence_all"](spark, "/root/testdata/sf0.001").collect()} == pairs
    lag = q["lead_lag_all"](spark, "/root/testdata/sf0.001").first()
    assert (lag.n, lag.lag) == (len(pairs), np.median(list(pairs.values())))
    times = [u for _, y, _, u in e if y == "purchase"]
    k = len(pairs) / (sum(x == "view" for _, x, _, _ in e) * len(times) / (max(times) - min(times)))
    assert abs(q["cross_k_all"](spark, "/root/testdata/sf0.001").first().k - k) < 1e-3
    fits = q["hawkes"](spark, "/root/testdata/sf0.001").select("user_id", "target", "source").collect()
    kinds = {}
    for user, x, _, _ in e:
        kinds.setdefault(user, set()).add(x)
    assert {tuple(r) for r in fits} == {(u, a, b) for u, v in kinds.items() for a in v for b in v}


def test_registered_searches_answer_every_query_row(spark):
    sf, q = "/root/testdata/sf0.001", registry.queries()
    wanted = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0").collect()}
    near, cells = ({}, {})
    for name, into in (("knn_cosine_all", near), ("cell_search", cells)):
        for r in q[name](spark, sf).collect():
            into.setdefault(r.query_id, set()).add(r.cx_id)
        assert set(into) == wanted and all(len(v) == 20 for v in into.values())
    assert sum(len(near[i] & cells[i]) for i in wanted) >= 0.9 * 20 * len(wanted)


def test_rounds_go_on_to_convergence(spark):
    """A path of 5 edges, longer than 4 rounds reach; and brute force for the registered queries."""
    path = spark.createDataFrame([(f"p{i}", f"p{i + 1}", 1.0) for i in range(5)], "src string, dst string, weight double")
    ends = spark.createDataFrame([("p0", 1.0), ("p5", 0.0)], "node string, label double")
    with pytest.raises(RuntimeError, match="not converged"):
        graph.propagate(path, ends, 4, 1e-3)
    with pytest.raises(RuntimeError, match="not converged"):
        graph.centrality(path, 2, 1e-3)
    got = {r.node: r.v for r in graph.propagate(path, ends, 100, 1e-3).collect()}
    assert all(abs(got[f"p{i}"] - (1 - i / 5)) < 0.02 for i in range(6))
    sf = "/root/testdata/sf0.001"
    e = registry._edges(spark, sf).collect()
    names = sorted({r.src for r in e} | {r.dst for r in e})
    a = np.zeros((len(names), len(names)))
    for r in e:
        a[names.index(r.src), names.index(r.dst)] += r.weight
        a[names.index(r.dst), names.index(r.src)] += r.weight
    v = np.zeros(len(names))
    for _ in range(3000):
        v = a @ v / a.sum(axis=1)
        v[names.index("r0")], v[names.index("r1")] = 1, -1
    got = {r.node: r.v for r in registry.queries()["graph_label_propagation_converged"](spark, sf).collect()}
    assert all(abs(got[n] - x) < 1e-2 for n, x in zip(names, v))
