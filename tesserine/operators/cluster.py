"""Clusters of vectors: a density tree over exact minimum edges between components, which joins of blocks find."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..llm.components import components
from . import blocks
from .lineage import cut
from .search import top_k

#: Neighbours that each row knows before components ask all rows.
KNOWN = 24


def _dense_tree(d: np.ndarray, min_samples: int) -> list[tuple[float, int, int]]:
    """Prim's tree (weight, parent, node) of mutual reachability from node 0."""
    n = len(d)
    core = np.sort(d + np.diag(np.full(n, np.inf)), axis=1)[:, min(min_samples, n - 1) - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    best, parent, out, edges = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool), []
    at = 0
    for _ in range(n - 1):
        out[at] = False
        closer = out & (reach[at] < best)
        best[closer], parent[closer] = reach[at][closer], at
        at = int(np.argmin(np.where(out, best, np.inf)))
        edges.append((best[at], int(parent[at]), at))
    return edges


def _sparse_tree(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> list[tuple[float, int, int]]:
    """The same tree, with the same choice among equal weights, from edges that hold every edge of every least tree."""
    ends, others, weights = np.append(a, b), np.append(b, a), np.append(w, w)
    order = np.argsort(ends, kind="stable")
    start = np.searchsorted(ends[order], np.arange(n + 1)).tolist()
    others, weights = others[order].tolist(), weights[order].tolist()
    best, parent, out, edges, heap = [np.inf] * n, [0] * n, [True] * n, [], [(0.0, 0)]
    while heap:
        cost, at = heapq.heappop(heap)
        if not out[at]:
            continue
        out[at] = False
        if at:
            edges.append((cost, parent[at], at))
        for i in range(start[at], start[at + 1]):
            v, x = others[i], weights[i]
            if out[v] and x < best[v]:
                best[v], parent[v] = x, at
                heapq.heappush(heap, (x, v))
    if len(edges) != n - 1:
        raise RuntimeError("the edges do not join all rows")
    return edges


def density_labels(d: np.ndarray, min_samples: int, min_size: int) -> np.ndarray:
    """Flat labels (-1: noise) of the density tree with the largest excess of mass; the root is never chosen."""
    return np.full(len(d), -1) if len(d) < 2 else _flat(len(d), _dense_tree(d, min_samples), min_size)


def _flat(n: int, edges: list[tuple[float, int, int]], min_size: int) -> np.ndarray:
    edges = sorted(edges)
    # Merge tree: node n + i joins the trees at the ends of edge i.
    root, kids, size = list(range(2 * n - 1)), {}, [1] * n
    def top(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v
    for i, (w, a, b) in enumerate(edges):
        a, b = top(a), top(b)
        kids[n + i] = (a, b, w)
        root[a] = root[b] = n + i
        size.append(size[a] + size[b])

    def leaves(v: int) -> list[int]:
        found, todo = [], [v]
        while todo:
            u = todo.pop()
            todo.extend(kids[u][:2]) if u >= n else found.append(u)
        return found

    clusters: list[dict] = []
    todo = [(2 * n - 2, 0.0, None)]
    while todo:
        v, birth, above = todo.pop()
        c = {"node": v, "stability": 0.0, "children": []}
        clusters.append(c)
        if above is not None:
            clusters[above]["children"].append(len(clusters) - 1)
        me = len(clusters) - 1
        while v >= n:
            a, b, w = kids[v]
            level = 1 / max(w, 1e-12)
            big = [u for u in (a, b) if size[u] >= min_size]
            gone = size[v] if len(big) != 1 else size[v] - size[big[0]]
            c["stability"] += gone * (level - birth)
            if len(big) == 2:
                todo += [(u, level, me) for u in big]
            if len(big) != 1:
                break
            v = big[0]
    worth, chosen = [0.0] * len(clusters), [False] * len(clusters)
    for i in reversed(range(len(clusters))):
        below = sum(worth[k] for k in clusters[i]["children"])
        chosen[i] = i > 0 and clusters[i]["stability"] >= below
        worth[i] = clusters[i]["stability"] if chosen[i] else below
    labels, todo = np.full(n, -1), [0]
    while todo:
        i = todo.pop()
        if chosen[i]:
            points = leaves(clusters[i]["node"])
            labels[points] = min(points)
        else:
            todo += clusters[i]["children"]
    return labels


def _numbered(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, cx_id): unit vectors, numbered from 0 in the order of their ids."""
    units = blocks.unit_rows(rows, id_col, vec_col).select(F.col("id").alias("cx_id"), "v")
    # Equal ids stay in a fixed order.
    dealt = cut(units.orderBy("cx_id", F.xxhash64("v")))
    size = {r["part"]: r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("part")).count().collect()}
    before = {p: sum(n for q, n in size.items() if q < p) for p in size}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = before.get(TaskContext.get().partitionId(), 0)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + b.num_rows)), b.column(1), b.column(0)], names=["id", "v", "cx_id"])
            at += b.num_rows

    return cut(dealt.mapInArrow(number, "id long, v binary, cx_id long"))


def _told(rows: DataFrame) -> DataFrame:
    """(id, component, core, v) -> (cell, id, v), the first three in one payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                head = np.stack([b.column(1).to_numpy().view("<f8"), b.column(2).to_numpy()], axis=1)
                v = [h.tobytes() + x for h, x in zip(head, b.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(v), np.int32)), b.column(0), pa.array(v, pa.binary())], names=["cell", "id", "v"])

    return rows.select("id", "component", "core", "v").mapInArrow(run, "cell int, id long, v binary")


def _nearness(q: bytes, r: bytes, n: int, m: int) -> np.ndarray:
    """Minus the mutual reachability of payloads of ``_told``; minus infinity within a component."""
    a, b = np.frombuffer(q).reshape(n, -1), np.frombuffer(r).reshape(m, -1)
    d = np.clip(1 - a[:, 2:] @ b[:, 2:].T, 0, 2)
    np.maximum(d, a[:, 1:2], out=d)
    np.maximum(d, b[:, 1], out=d)
    d[a[:, 0].copy().view("<i8")[:, None] == b[:, 0].copy().view("<i8")[None]] = np.inf
    return -d


def least_edges(rows: DataFrame, min_samples: int) -> DataFrame:
    """(a, b, w), a < b: edges of mutual reachability among ``rows`` (id, v) that hold every edge of every least tree.

    Components grow from single rows. In a round every component but the largest takes its least edge to another one:
    from the ``KNOWN`` nearest neighbours of its rows, and from all rows for those of its rows whose neighbours
    all lie nearer than that edge. Ties among trees come from core distances, whose edges are kept as well.
    """
    n, lanes = rows.count(), 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k, known = min(min_samples, n - 1), min(max(min_samples, KNOWN), n - 1)
    cells = rows.select(F.lit(0).alias("cell"), "id", "v")
    met = blocks.top(cells, cells, known + 1, blocks.dots, lanes, query_lanes=8).where("query_id <> cx_id")
    near = cut(top_k(met, known, ["query_id"]).select(F.col("query_id").alias("id"), F.col("cx_id").alias("nbr"), "rank", F.least(F.greatest(1 - F.col("score"), F.lit(0.0)), F.lit(2.0)).alias("d")))
    at = cut(near.groupBy("id").agg(F.max(F.when(F.col("rank") == k, F.col("d"))).alias("core"), F.max("d").alias("far")))
    core = at.select("id", "core")
    known_edges = near.join(core, "id").join(core.select(F.col("id").alias("nbr"), F.col("core").alias("nbr_core")), "nbr")
    known_edges = cut(known_edges.select("id", "nbr", "rank", F.greatest("d", "core", "nbr_core").alias("w")))
    edge = F.struct("w", F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b")).alias("e")
    kept = [known_edges.where(F.col("rank") <= k).select(edge)]
    label = rows.select("id", F.col("id").alias("component"))
    while True:
        size = label.groupBy("component").count().orderBy(F.col("count").desc(), "component").limit(2).collect()
        if len(size) < 2:
            return cut(kept[0] if len(kept) == 1 else _union(kept)).select("e.a", "e.b", "e.w").distinct()
        there = label.select(F.col("id").alias("nbr"), F.col("component").alias("other"))
        known_best = known_edges.join(label, "id").join(there, "nbr").where("component <> other").groupBy("component").agg(F.min(edge).alias("e"))
        known_best = cut(known_best.where(F.col("component") != size[0]["component"]))
        asks = label.where(F.col("component") != size[0]["component"]).join(known_best, "component", "left").join(at.select("id", "far"), "id")
        asks = asks.where(F.col("e").isNull() | (F.col("far") < F.col("e.w"))).select("id")
        told = label.join(core, "id").join(rows.select("id", "v"), "id")
        told = cut(_told(told))
        hits = blocks.top(told, told.join(asks, "id", "left_semi").select("cell", "id", "v"), 1, _nearness, lanes, query_lanes=8).where(F.col("score") > float("-inf"))
        hits = hits.select(F.col("query_id").alias("id"), F.col("cx_id").alias("nbr"), (-F.col("score")).alias("w"))
        found = hits.select("id", edge).join(label, "id").select("component", "e").unionByName(known_best)
        best = cut(found.groupBy("component").agg(F.min("e").alias("e")))
        kept.append(best.select("e"))
        name = lambda c: label.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
        links = best.select("e.a", "e.b").join(name("a"), "a").join(name("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
        whole = components(links).select(F.col("node").alias("component"), F.col("component").alias("new"))
        label = cut(label.join(whole, "component", "left").select("id", F.coalesce("new", "component").alias("component")))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def density_clusters(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", min_samples: int = 5, min_size: int = 5) -> DataFrame:
    """(cx_id, cluster): cosine-distance density clusters, named by their first member in id order, -1 for noise.

    Pairs of rows meet in blocks (see ``least_edges``); the tree of the least edges, a few numbers for each row, is cut in one task.
    """
    if min_samples < 1 or min_size < 2:
        raise ValueError("min_samples >= 1 and min_size >= 2")
    rows = _numbered(df, id_col, vec_col)
    n = rows.count()
    if n != df.count():
        raise ValueError("null, zero or non-finite vector")
    if n < 2:
        return rows.select("cx_id", F.lit(-1).cast("long").alias("cluster"))

    def flat(edges: pa.Table) -> pa.Table:
        a, b, w = (edges.column(c).to_numpy() for c in ("a", "b", "w"))
        return pa.table({"id": np.arange(n), "first": _flat(n, _sparse_tree(n, a, b, w), min_size).astype(np.int64)})

    labels = cut(least_edges(rows, min_samples).withColumn("tree", F.lit(0)).groupBy("tree").applyInArrow(flat, "id long, first long"))
    named = rows.select(F.col("id").alias("first"), F.col("cx_id").alias("cluster"))
    return rows.select("id", "cx_id").join(labels, "id").join(named, "first", "left").select("cx_id", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))
