"""Discovery, blind spots, windowed recall, kernel index, eigenmaps, probes and indexing beyond what SQL shows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.operators import blindspots, discovery, events, indexing, probes, search, spectral
from tesserine.operators.kernel_index import KernelIndex

RNG = np.random.default_rng(4)


def test_discovery_ends_and_verdicts(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "a", 0.9), ("b", "c", 0.8), ("c", "d", 0.7), ("x", "y", 0.5), ("a", "u", 0.1)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([(n, 1.0) for n in "abcdxyuz"], "node string, frequency double")
    ground = spark.createDataFrame([("b", 0), ("c", 1), ("d", 2), ("y", 9), ("a", 0)], "node string, hop int")
    starts = spark.createDataFrame([("one", "a"), ("two", "x"), ("three", "z")], "chain string, node string")
    log, ended = discovery.discover(edges, nodes, starts, ground, discovery.reach_gate(3))
    got = {(r.chain, r.src, r.dst): r for r in log.collect()}
    assert got["one", "a", "u"].verdict == "ungrounded" and got["one", "b", "a"].verdict == "visited_loop" and got["two", "x", "y"].verdict == "ungrounded"
    assert got["one", "c", "d"].path == ["a", "b", "c", "d"] and got["one", "c", "d"].path_score == pytest.approx(0.9 * 0.8 * 0.7 * 0.9**3)
    assert got["one", "a", "b"].score == pytest.approx(0.9 * (0.65 + 0.35 / 2)) and got["one", "b", "c"].confidence == pytest.approx(0.75)
    assert {(r.chain, r.hops, r.ended) for r in ended.collect()} == {("one", 4, "frontier_exhausted"), ("two", 1, "no_gate_pass"), ("three", 1, "frontier_exhausted")}
    _, ended = discovery.discover(edges, nodes, starts.where("chain = 'one'"), ground, discovery.reach_gate(3), max_hops=2)
    assert ended.first().ended == "max_hops"
    with pytest.raises(ValueError):
        discovery.discover(edges, nodes, starts, ground, discovery.reach_gate(3), branch_width=0)


def test_hypotheses_and_bridges_refuse_bad_input(spark):
    bad = spark.createDataFrame([(1, 2.0, 0.5, 1, 0.5)], "id long, novelty double, confidence double, distance long, plausibility double")
    with pytest.raises(Exception, match="terms must lie"):
        discovery.ranked_hypotheses(bad).collect()
    edges = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([("a", 2.0)], "node string, frequency double")
    inputs = spark.createDataFrame([("p", "q", "zz", 0.1, 0.9, True)], "a string, b string, node string, centrality double, confidence double, passed boolean")
    with pytest.raises(Exception, match="without a node"):
        discovery.ranked_bridges(edges, nodes, inputs).collect()


def test_windowed_recall_deepens_or_fails(spark):
    hits = spark.range(1000).select(F.col("id").alias("cx_id"), (-F.col("id").cast("double")).alias("score"))
    late = F.col("cx_id") >= 100
    top, report = events.windowed_recall(hits, 5, 10, late, 1000)
    assert [r.cx_id for r in top.collect()] == [100, 101, 102, 103, 104] and report["rounds"] == 3 and report["budget"] == 160
    with pytest.raises(ValueError):
        events.windowed_recall(hits, 5, 10, late, 100)
    top, report = events.windowed_recall(hits, 5, 10, F.col("cx_id") >= 998, 4000)
    assert top.count() == 2 and report["exhausted"]
    top, report = events.windowed_recall(hits, 3, 10, late)
    assert report["rounds"] == 1 and report["fetched"] == 1000 and top.count() == 3


def test_blind_spot_calibration(spark):
    ref = spark.createDataFrame([(i, i / 100) for i in range(100)], "cx_id long, delta double")
    got = {r.cx_id: r for r in blindspots.calibrated(ref, ref, alpha=0.09).collect()}
    assert set(got) == set(range(91, 100))
    assert [got[i].severity for i in (91, 94, 95, 99)] == ["low", "medium", "medium", "high"]
    with pytest.raises(ValueError):
        blindspots.calibrated(ref, ref.limit(5))
    with pytest.raises(Exception, match="not finite"):
        blindspots.calibrated(spark.createDataFrame([(1, math.nan)], "cx_id long, delta double"), ref).collect()


def test_kernel_index_refreshes_only_what_changed(spark, tmp_path):
    v = RNG.standard_normal((60, 8))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    kernel = spark.createDataFrame([(str(i), i + 1) for i in range(12)], "node string, rank int")
    index = KernelIndex(rows, kernel, str(tmp_path / "k"))
    before = {r.region: r.n for r in index.regions().collect()}
    assert sum(before.values()) == 60 and len(before) == 12
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    region = (unit @ unit[:12].T).argmax(axis=1) + 1
    assert before == {r: int((region == r).sum()) for r in range(1, 13)}
    assert index.recall(rows, rows, 5, regions=12).agg(F.min("ratio")).first()[0] == 1.0
    # Row 40 moves next to kernel node 0, row 100 is new there, row 41 goes.
    changed = spark.createDataFrame([(40, v[0].tolist()), (100, (2 * v[0]).tolist())], "vec_id long, embedding array<double>")
    touched = index.refresh(changed, spark.createDataFrame([(41,)], "vec_id long"))
    assert set(touched) == {1, int(region[40]), int(region[41])}
    after = {r.region: r.n for r in index.regions().collect()}
    assert sum(after.values()) == 60
    assert {r.cx_id for r in index.search(v[0].tolist(), 3, regions=2).collect()} == {0, 40, 100}


def test_eigenmaps_against_a_dense_solver(spark):
    a = (RNG.random((30, 30)) < 0.15).astype(float) * RNG.random((30, 30))
    a[np.arange(29), np.arange(1, 30)] = 1.0
    edges = spark.createDataFrame([(f"n{i:02}", f"n{j:02}", float(a[i, j])) for i in range(30) for j in range(30) if a[i, j]], "src string, dst string, weight double")
    w = a + a.T
    s = w / np.sqrt(np.outer(w.sum(1), w.sum(1)))
    want = np.sort(1 - np.linalg.eigvalsh(s))[:3]
    maps, values = spectral.eigenmaps(edges, 3, tol=1e-4)
    assert values == pytest.approx(want.tolist(), abs=1e-6)
    x = np.array([r.x for r in maps.orderBy("node").collect()])
    assert np.abs(x.T @ x - np.eye(3)).max() < 1e-9
    assert np.linalg.norm((np.eye(30) - s) @ x - x * np.array(values), axis=0).max() < 1e-3
    with pytest.raises(ValueError):
        spectral.eigenmaps(edges, 31)
    with pytest.raises(RuntimeError):
        spectral.eigenmaps(edges, 3, rounds=1, steps=1, tol=1e-12)


def test_probe_bits_tell_signal_from_noise(spark):
    y = RNG.integers(0, 2, 600)
    rows = [(i // 2, int(y[i]), [float(y[i] + RNG.normal(0, 0.2)), float(RNG.normal())], [float(RNG.normal()) for _ in range(2)]) for i in range(600)]
    df = spark.createDataFrame(rows, "grp long, y int, good array<double>, noise array<double>")
    good = probes.reliability(probes.probe_bits(df, "good", "y", "grp"))
    noise = probes.reliability(probes.probe_bits(df, "noise", "y", "grp"))
    g, n = good.first(), noise.first()
    assert g.bits > 0.5 and g.seeds == 5 and not g.unresolved and g.low <= g.bits <= g.high
    assert n.bits < 0.05
    lens = lambda r, c, k=None: r.withColumns({"lens": F.lit("x"), "correlation": F.lit(c), **({"seeds": F.lit(k)} if k else {})})
    assert [probes.admitted(x).first().decision for x in (lens(good, 0.1), lens(good, 0.9), lens(good, 0.1, 3))] == ["admitted", "redundant", "too_few_seeds"]
    assert probes.admitted(lens(noise, 0.1)).first().decision in ("unresolved", "low_signal")
    with pytest.raises(ValueError):
        probes.probe_bits(df.where("y = 1"), "good", "y", "grp")


def test_index_embeddings_put_like_documents_together(spark):
    texts = ["red green blue red", "green blue red", "one two three four", "two three four five", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    v = indexing.as_vectors(indexing.embedded(docs, "id", search.tokens(F.col("text"))))
    got = {r.id: np.array(r.v) for r in v.collect()}
    assert set(got) == {0, 1, 2, 3} and all(np.linalg.norm(x) == pytest.approx(1) for x in got.values())
    assert got[0] @ got[1] > 0.8 and got[2] @ got[3] > 0.5 and abs(got[0] @ got[2]) < 0.4
    edges = spark.createDataFrame([(0, 2), (0, 4)], "src long, dst long")
    one = {r.id: np.array(r.v) for r in indexing.as_vectors(indexing.diffused(indexing.embedded(docs, "id", search.tokens(F.col("text"))), edges)).collect()}
    want = 0.7 * got[0] + 0.3 * got[2]
    assert one[0] == pytest.approx(want / np.linalg.norm(want)) and one[1] == pytest.approx(got[1])
