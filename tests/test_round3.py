"""Findings of round 3."""

import numpy as np

from tesserine.operators import ann, cluster, series


def test_density_clusters_of_more_than_3000_rows_match_the_dense_tree(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([c + rng.normal(0, 0.25, (40, 6)) for c in rng.normal(0, 1, (20, 6))] + [rng.normal(0, 1, (2220, 6)), rng.normal(0, 1, (1, 6)).repeat(20, axis=0)])
    ids = rng.permutation(len(x)) * 3
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {r.cx_id: r.cluster for r in cluster.density_clusters(df).collect()}
    order = np.argsort(ids)
    v = x[order] / np.linalg.norm(x[order], axis=1, keepdims=True)
    labels = cluster.density_labels(np.clip(1 - v @ v.T, 0, 2), 5, 5)
    assert len(got) == 3040 and len(set(labels)) > 5
    assert got == {int(i): int(ids[order][c]) if c >= 0 else -1 for i, c in zip(ids[order], labels)}


def test_walk_holds_the_beam_alone_and_meets_what_a_plain_search_meets(spark):
    v = np.random.default_rng(4).normal(size=(400, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    g = ann.NeighbourGraph(df, degree=6, sample=4, rounds=2, codes=ann.ProductCodes(np.random.default_rng(5).normal(size=(4, 16, 4))))
    edges, code = {}, {}
    for r in g.edges.collect():
        edges.setdefault(r.node, []).append(r.nbr)
        code[r.nbr] = r.code
    books, start = g.codes.books, [r.id for r in ann._sample(g.rows, 16).collect()]
    score = lambda q, i: float(sum(v[q, 4 * p : 4 * p + 4] @ books[p, c] for p, c in enumerate(code[i])))
    got = {}
    for r in g.walk(df.where("vec_id < 5"), beam=20, width=3).collect():
        got.setdefault(r.query_id, {})[r.node] = r.score
    for q in range(5):
        seen, done = set(start), set()
        while front := [i for i in sorted(seen, key=lambda i: (-score(q, i), i))[:20] if i not in done][:3]:
            done |= set(front)
            seen |= {j for i in front for j in edges[i]}
        assert set(got[q]) == set(sorted(seen, key=lambda i: (-score(q, i), i))[:20])
        assert all(abs(s - score(q, i)) < 1e-9 for i, s in got[q].items())


def test_hawkes_fits_whole_batches_of_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(g, "abc"[k], float(t)) for g in range(40) for k, t in zip(rng.integers(0, 3, 30 + g), rng.integers(0, 50, 30 + g))]
    rows += [(77, "c", 5.0), (77, "c", 5.0), (None, "a", 1.0), (None, "b", 3.0)]
    df = spark.createDataFrame(rows, "g long, p string, t double")
    fits = series.hawkes(df, "t", "p", 0.5, by="g")
    plan = fits._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan  # no call of Python for each group
    got = {(r.g, r.target, r.source): (r.branching, r.baseline) for r in fits.collect()}
    assert got[77, "c", "c"] == (None, None) and (None, "a", "b") in got and len(got) == 40 * 9 + 1 + 4
    for g in (0, 7, 39):
        # A plain loop over one group.
        mine = {x: np.sort([t for i, p, t in rows if i == g and p == x]) for x in "abc"}
        begin, end = (f(np.concatenate(list(mine.values()))) for f in (np.min, np.max))
        pull = {x: np.array([[sum(0.5 * np.exp(-0.5 * (t - u)) for u in mine[y] if u < t) for y in "abc"] for t in mine[x]]) for x in "abc"}
        seen = np.array([sum(1 - np.exp(-0.5 * (end - t)) for t in mine[y]) for y in "abc"])
        for x in "abc":
            base, branch = len(mine[x]) / (end - begin) / 2, np.full(3, 0.05)
            for _ in range(50):
                total = base + (pull[x] * branch).sum(axis=1)
                base, branch = (base / total).sum() / (end - begin), (pull[x] * branch / total[:, None]).sum(axis=0) / np.maximum(seen, 1e-12)
            assert all(np.allclose(got[g, x, y], (branch[i], base), atol=1e-9) for i, y in enumerate("abc"))


def test_rounds_move_half_vectors_and_end_with_exact_scores(spark):
    v = np.random.default_rng(8).normal(size=(150, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    g = ann.NeighbourGraph(df, degree=6, sample=4, rounds=2, codes=ann.ProductCodes(np.random.default_rng(5).normal(size=(4, 4, 2))))
    assert {len(r.v) for r in g.half.collect()} == {16}  # 2 bytes for each component
    got = g.near.collect()
    assert len(got) == 150 * 6 and all(abs(v[r.node] @ v[r.nbr] - r.score) < 1e-12 for r in got)
