"""Centroid clustering, sharding and importance resampling against plain loops and DuckDB."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.llm import centroids, importance, sharding
from tesserine.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, rng string, row string, digest string"
LONG = " ".join(f"w{i}" for i in range(12_000))
WORDY = " ".join(f"word{i % 7}" for i in range(30))
ROWS = [
    (1, WORDY, "a", "x", "y", "z"), (2, WORDY, "a", "x", "y", "z"), (2, WORDY, "a", "x", "y", "z"), (2, "other text " * 12, "b", None, None, None), (None, WORDY, None, "", "", ""),
    (None, WORDY, None, "", "", ""), (7, None, "b", "x", "y", "z"), (8, "", "b", "x", "y", "z"), (9, LONG, "c", "x", "y", "z"), (10, "Ünï ÜÑÏ 日本 A1 a1 " * 6, "a", "x", "y", "z"),
    *[(i, f"{WORDY} {i % 3}", "hot", "x", "y", "z") for i in range(20, 80)],
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.mark.parametrize("name", ["op11_centroids", "op12_sharding", "op13_importance"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries()[name](spark, SF)
    r = con.execute(oracle_sql()[name])
    at = [df.columns.index(c[0]) for c in r.description]
    assert len(at) == len(df.columns)
    assert sorted(map(repr, (tuple(x[i] for i in at) for x in df.collect()))) == sorted(map(repr, r.fetchall()))


# Sharding


def test_rows_law_and_mixture(docs):
    got = sharding.shard_plan(docs, shards=5).collect()
    assert len(got) == len(ROWS)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    counts = [len(by[s]) for s in range(5)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want


def plain_shards(rows, shards):
    groups = defaultdict(list)
    for i, t, s, *_ in rows:
        key = hashlib.md5("|".join(["shard", *([] if i is None else [str(i)]), str(zlib.crc32((t or "").encode()))]).encode()).hexdigest()
        groups[s].append((key, i))
    order = sorted(((2 * r + 1) / (2 * len(g)), s is None, s or "", key, i) for s, g in groups.items() for r, (key, i) in enumerate(sorted(g, key=lambda x: x[0])))
    out, slots = Counter(), Counter()
    for p, (*_, i) in enumerate(order):
        shard = p * shards // len(order)
        out[i, shard, slots[shard]] += 1
        slots[shard] += 1
    return out


def test_sharding_against_plain_loops(docs, monkeypatch):
    for cells in (4096, 3):
        monkeypatch.setattr(sharding, "CELLS", cells)
        for shards in (1, 7, 200):
            got = Counter((r.doc_id, r.shard, r.slot) for r in sharding.shard_plan(docs, shards=shards).collect())
            assert got == plain_shards(ROWS, shards)


def test_every_shard_matches_the_mixture(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    mix = sharding.interleave(d, shards=4).groupBy("source", "shard").count().collect()
    share = Counter(r.source for r in d.collect())
    assert all(abs(r["count"] - share[r.source] / 4) <= 1 for r in mix)


def test_written_shards(spark, docs, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, path, shards=3, rows_per_file=10)
    back = spark.read.parquet(path)
    assert Counter(map(repr, (tuple(r[c] for c in docs.columns) for r in back.collect()))) == Counter(map(repr, ROWS))
    plan = Counter((r.doc_id, r.shard, r.slot) for r in sharding.shard_plan(docs, shards=3).collect())
    assert Counter((r.doc_id, r.shard, r.slot) for r in back.collect()) == plan
    with pytest.raises(ValueError):
        sharding.interleave(docs.withColumn("shard", F.lit(1)))


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert sharding.shard_plan(none).count() == 0
    assert importance.resample(none, none).count() == 0
    assert centroids.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert {r.weight for r in importance.resample(docs, none).collect() if r.n_features == 0} == {0}


def test_sharding_has_no_python(docs):
    plan = sharding.shard_plan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# Importance


def plain_importance(rows, target, percent=25, buckets=10_000):
    def feats(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return len(w), [zlib.crc32(x.encode()) % buckets for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]

    s, t = Counter(x for r in rows for x in feats(r[1])[1]), Counter(x for r in target for x in feats(r)[1])
    ns, nt = sum(s.values()), sum(t.values())
    out = []
    for i, text, *_ in rows:
        n, f = feats(text)
        g = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in f]
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(g) // len(g) if g else 0
        out.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    ranks = {}
    for k, r in enumerate(able[: percent * len(able) // 100]):
        ranks.setdefault(r, []).append(k + 1)
    done = Counter()
    for r in out:
        mine = ranks.get(r, [])
        done[(*r[:4], mine.pop(0) if mine else None)] += 1
    return done


def test_importance_against_plain_loops(spark, docs):
    target = ["word1 word2 日本", None, "A1 a1", "other"]
    t = spark.createDataFrame([(x, 1) for x in target], "text string, copies int")
    for percent in (0, 25, 60, 100):
        got = importance.resample(docs, t, percent=percent)
        assert Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got.collect()) == plain_importance(ROWS, target, percent)


def test_equal_texts_weigh_alike_and_noise_is_their_own(spark):
    d = spark.createDataFrame([(i, WORDY) for i in range(400)], "doc_id long, text string")
    got = importance.resample(d, d).collect()
    assert len({r.weight for r in got}) == 1 and len({r.score for r in got}) > 300
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 101))


def test_drawn_documents_keep_their_columns(docs):
    got = importance.drawn_documents(docs, docs.select("text"), percent=50)
    plan = importance.resample(docs, docs.select("text"), percent=50).where("rank IS NOT NULL")
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in plan.collect())
    assert set(map(tuple, got.collect())) <= set(ROWS)


# Centroids


def plain_clusters(rows, k, rounds, scale=256):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in kept[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for _ in range(rounds):
        member = defaultdict(list)
        for _, v in kept:
            member[min(range(len(c)), key=lambda j: (dist(v, c[j]), j))].append(v)
        c = [[sum(x) // len(member[j]) for x in zip(*member[j])] if member[j] else p for j, p in enumerate(c)]
    out = []
    for i, v in kept:
        j = min(range(len(c)), key=lambda j: (dist(v, c[j]), j))
        out.append((i, j, min(dist(v, c[j]), centroids.MAX_LONG), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()))
    return Counter(out)


def vectors(seed, n=120, step=4):
    """Coarse components, so that exact ties are frequent."""
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.integers(-step, step, 64) * (rng.random(64) < 0.05) / 4).tolist()) for i in range(n)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (500, [0.0] * 64), (501, None), (502, [1.0] * 63), (503, [math.nan] + [0.0] * 63), (504, [math.inf] + [0.0] * 63), (505, [None] + [0.0] * 63)]
    return rows


@pytest.mark.parametrize("k,rounds,seed", [(5, 3, 1), (40, 5, 2), (200, 2, 3), (7, 1, 4)])
def test_clusters_against_plain_loops(spark, k, rounds, seed):
    rows = vectors(seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash"))
    got = centroids.cluster(df, k=k, rounds=rounds).collect()
    assert Counter((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got) == plain_clusters(rows, k, rounds)
    per = Counter()
    for r in got:
        per[r.cluster] += r.distance
    assert all(r.cluster_inertia == per[r.cluster] and r.inertia == sum(per.values()) for r in got)


def test_components_of_any_size(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=64) * 10.0 ** rng.integers(0, 12 if i % 2 else 38)).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = centroids.cluster(df, k=6, rounds=3).collect()
    assert Counter((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got) == plain_clusters(rows, 6, 3)


def test_bounds_skip_and_stay_on_their_side():
    rng = np.random.default_rng(8)
    centres = rng.integers(-900, 900, (12, 64))
    v = centres[rng.integers(0, 12, 3000)] + rng.integers(-40, 40, (3000, 64))
    points = centroids.Centroids(v[:12].tolist())
    a, up, low = centroids.assign(v, points)
    for _ in range(4):
        new = [(v[a == j].sum(0) // max(1, (a == j).sum())).tolist() if (a == j).any() else p for j, p in enumerate(points.points.tolist())]
        points = centroids.Centroids(new, points.points.tolist())
        a, up, low = centroids.assign(v, points, a, up, low)
        d = np.stack([centroids.squared(v, p) for p in points.points], axis=1)
        assert (a == d.argmin(axis=1)).all()
        assert (up.astype(float) >= np.sqrt(d.min(axis=1))).all() and (low.astype(float) <= np.sqrt(d)).all()


def test_elkan_skips_distances(monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.integers(-900, 900, (12, 64))
    v = centres[np.arange(600) % 12] + rng.integers(-9, 9, (600, 64))
    points = centroids.Centroids(v[:12].tolist())
    a, up, low = centroids.assign(v, points)
    taken = []
    monkeypatch.setattr(centroids, "squared", lambda rows, c, f=centroids.squared: taken.append(len(rows)) or f(rows, c))
    centroids.assign(v, points, a, up, low)
    assert sum(taken) == 0
