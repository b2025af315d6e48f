"""Graph operators over edges (src, dst, weight)."""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, with_total

ATTENUATION, LAMBDA = 0.9, 0.5


def neighbours(edges: DataFrame, node: str, direction: str = "out", kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Neighbours along or against the edges, of one ``type`` if ``kind`` is given, the first ``limit`` by name."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    e = edges.where(F.col(a) == node)
    e = e if kind is None else e.where(F.col("type") == kind)
    out = e.select(F.col(b).alias("node"), "weight")
    return out if limit is None else out.orderBy("node").limit(limit)


def normalised(edges: DataFrame) -> DataFrame:
    """Weights divided by the largest."""
    return with_total(edges, _top=F.max("weight")).withColumn("weight", F.col("weight") / F.col("_top")).drop("_top")


def bfs(edges: DataFrame, starts: list[str], hops: int = 3, cap: int = 10_000) -> DataFrame:
    """(node, hop) without the starts; more than ``cap`` followed edges is an error. One join per hop; a hop is written once, so that plans do not grow with the hops."""
    if not 0 <= hops <= 10:
        raise ValueError("0 to 10 hops")
    spark = edges.sparkSession
    seen = spark.createDataFrame([(s, 0) for s in starts], "node string, hop int")
    front, used = seen, 0
    e = cut(edges.select("src", "dst").distinct())
    for hop in range(1, hops + 1):
        step = front.join(e, front.node == e.src).select(F.col("dst").alias("node"))
        used += step.count()
        if used > cap:
            raise RuntimeError(f"traversal follows more than {cap} edges")
        front = cut(step.distinct().join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def scored_traverse(edges: DataFrame, start: str, hops: int = 3, attenuation: float = ATTENUATION, direction: str = "out") -> DataFrame:
    """Largest product of weights times ``attenuation`` per hop (consequences use 0.7) over all walks of up to ``hops`` steps
    along the edges (out), against them (in) or both ways; a node keeps its best."""
    if not 0 <= hops <= 10:
        raise ValueError("0 to 10 hops")
    out, back = edges.select("src", "dst", "weight"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    edges = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    front = edges.sparkSession.createDataFrame([(start, 1.0)], "node string, score double")
    found = None
    for _ in range(hops):
        front = front.join(edges, front.node == edges.src).groupBy(F.col("dst").alias("node")).agg(F.max(F.col("score") * F.col("weight") * attenuation).alias("score"))
        found = front if found is None else found.unionByName(front)
    if found is None:
        return front.where("false")
    return found.groupBy("node").agg(F.max("score").alias("score")).where(F.col("node") != start)


def _moved(old: DataFrame, new: DataFrame) -> float:
    """Largest change of a node's value."""
    return old.select("node", F.col("v").alias("w")).join(new, "node").agg(F.max(F.abs(F.col("v") - F.col("w")))).first()[0] or 0.0


#: Edges up to which iterations to a tolerance run on the driver over sparse arrays; larger graphs iterate as joins, with the same steps.
SMALL_GRAPH = 1_000_000


def _sparse(both: DataFrame):
    """(names, row, column, weight) of a small symmetric graph, or None."""
    import numpy as np

    rows = both.limit(2 * SMALL_GRAPH + 1).collect()
    if len(rows) > 2 * SMALL_GRAPH:
        return None
    names = sorted({r[0] for r in rows})
    at = {v: i for i, v in enumerate(names)}
    return names, np.array([at[r[0]] for r in rows], int), np.array([at[r[1]] for r in rows], int), np.array([r[2] for r in rows], float)


def _settle(value, step, rounds: int, tol: float):
    """Arrays: rounds until no value moves by more than tol; NaN stands for no value."""
    import numpy as np

    for _ in range(rounds):
        old, value = value, step(value)
        if not len(value) or np.abs(value - old).max() <= tol:
            return value
    raise RuntimeError(f"not converged after {rounds} rounds")


def _harmonic(w: DataFrame, seeds: DataFrame, rounds: int, tol: float) -> DataFrame:
    """(node, v): the values at which every node without a label is the weighted mean of its neighbours, by conjugate gradients over joins.

    Unknowns are scaled by the root of their weights' sum, so that the matrix I - D^-1/2 W D^-1/2 is symmetric; nodes
    that no label reaches stay at 0.
    """
    w = cut(w.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    root = w.groupBy(F.col("src").alias("node")).agg(F.sqrt(F.sum("weight")).alias("d"))
    known = seeds.select("node", "label").where("label IS NOT NULL")
    nodes = cut(root.join(known, "node", "left"))
    scaled = w.join(nodes.select(F.col("node").alias("src"), F.col("d").alias("ds"), F.col("label").alias("ls")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("d").alias("dd"), F.col("label").alias("ld")), "dst")
    scaled = cut(scaled.where("ls IS NULL").select("src", "dst", (F.col("weight") / (F.col("ds") * F.col("dd"))).alias("m"), (F.col("ld") * F.col("dd")).alias("held")))
    b = scaled.where("held IS NOT NULL").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("m") * F.col("held")).alias("r"))
    inner = scaled.where("held IS NULL").select("src", "dst", "m")
    t = cut(nodes.where("label IS NULL").select("node", "d").join(b, "node", "left").select("node", "d", F.lit(0.0).alias("x"), F.coalesce("r", F.lit(0.0)).alias("r")).withColumn("p", F.col("r")))
    first = rr = t.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    for _ in range(rounds):
        if rr == 0 or (rr <= first * 1e-24 or (t.agg(F.max(F.abs(F.col("r") / F.col("d")))).first()[0] or 0.0) <= tol * 1e-6):
            free = t.select("node", (F.col("x") / F.col("d")).alias("v"))
            return free.unionByName(nodes.where("label IS NOT NULL").select("node", F.col("label").alias("v")))
        ap = inner.join(t.select(F.col("node").alias("dst"), F.col("p").alias("q")), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("m") * F.col("q")).alias("s"))
        t = cut(t.join(ap, "node", "left").withColumn("s", F.col("p") - F.coalesce("s", F.lit(0.0))))
        step = rr / t.agg(F.sum(F.col("p") * F.col("s"))).first()[0]
        t = t.select("node", "d", (F.col("x") + F.col("p") * step).alias("x"), (F.col("r") - F.col("s") * step).alias("r"), "p")
        rr, old = t.agg(F.sum(F.col("r") * F.col("r"))).first()[0], rr
        t = cut(t.withColumn("p", F.col("r") + F.col("p") * (rr / old)))
    raise RuntimeError(f"not converged after {rounds} rounds")


def _harmonic_small(n: int, row, col, w, held, label, rounds: int, tol: float):
    """The same over arrays."""
    import numpy as np

    d = np.sqrt(np.bincount(row, w, n))
    m = w / (d[row] * d[col])
    free = ~held
    times = lambda v: np.where(free, np.bincount(row, m * v[col], n), 0.0)
    x = np.zeros(n)
    r = times(np.where(held, label * d, 0.0))
    p, rr = r, r @ r
    first = rr
    for _ in range(rounds):
        if rr == 0 or rr <= first * 1e-24 or np.abs(r / d).max() <= tol * 1e-6:
            return np.where(held, label, x / d)
        s = p - times(p)
        step = rr / (p @ s)
        x, r = x + step * p, r - step * s
        rr, old = r @ r, rr
        p = r + p * (rr / old)
    raise RuntimeError(f"not converged after {rounds} rounds")


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int, tol: float | None = None) -> DataFrame:
    """Jacobi rounds of the weighted neighbour mean on the symmetric graph; seeds (node, label) keep their label.

    With ``tol`` the values are those that such rounds end at, found by conjugate gradients: a node's mean then differs from it by
    a millionth of ``tol`` at most. ``rounds`` without that raise.
    """
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    if tol is not None and (small := _sparse(both)) is not None:
        import numpy as np

        names, row, col, w = small
        fixed = {r[0]: r[1] for r in seeds.select("node", "label").where("label IS NOT NULL").collect()}
        held = np.array([v in fixed for v in names], bool)
        start = np.array([fixed.get(v, 0.0) for v in names], float)
        value = _harmonic_small(len(names), row, col, w, held, start, rounds, tol) if names else start
        return edges.sparkSession.createDataFrame(list(zip(names, value.tolist(), strict=True)), "node string, v double")
    if tol is not None:
        return _harmonic(both, seeds, rounds, tol)
    value = both.select(F.col("src").alias("node")).distinct().join(seeds, "node", "left").select("node", F.coalesce("label", F.lit(0.0)).alias("v"))
    for _ in range(rounds):
        mean = both.join(value, both.dst == value.node).groupBy(F.col("src").alias("node")).agg((F.sum(F.col("weight") * F.col("v")) / F.sum("weight")).alias("m"))
        value = value.select("node").join(mean, "node", "left").join(seeds, "node", "left").select("node", F.coalesce("label", "m", F.lit(0.0)).alias("v"))
    return value


def groundedness(edges: DataFrame, anchors: list[str], max_hops: int = 3) -> DataFrame:
    """Hops to the nearest anchor along the edges' direction, by a search on reversed edges; anchors have 0."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    zero = edges.sparkSession.createDataFrame([(a, 0) for a in anchors], "node string, hop int")
    return zero.unionByName(bfs(back, anchors, max_hops, cap=1_000_000))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def betweenness(edges: DataFrame, exact_nodes: int | None = 2000, pivots: int = 512, edge_limit: int = 4_000_000) -> DataFrame:
    """Brandes betweenness, sources in parallel: all of them up to ``exact_nodes`` nodes (None: always), else ``pivots`` of them
    by a hash of their names, scaled to all. The adjacency goes to every task, so more than ``edge_limit`` edges are refused."""
    import pandas as pd

    rows = edges.select("src", "dst").distinct().limit(edge_limit + 1).collect()
    if len(rows) > edge_limit:
        raise RuntimeError(f"more than {edge_limit} edges")
    adj: dict[str, list[str]] = {}
    for a, b in rows:
        adj.setdefault(a, []).append(b)
        adj.setdefault(b, [])
    whole = exact_nodes is None or len(adj) <= exact_nodes
    chosen = [v for v in adj if adj[v]] if whole else sorted(adj, key=lambda v: (hashlib.sha256(v.encode()).digest(), v))[:pivots]
    scale = 1.0 if whole else len(adj) / max(1, len(chosen))

    def run(it):
        total: dict[str, float] = {}
        for pdf in it:
            for s in pdf["node"]:
                # Nothing is kept for nodes that a source doesn't reach.
                order, preds, sigma, dist = [], {s: []}, {s: 1.0}, {s: 0}
                queue = [s]
                for v in queue:
                    order.append(v)
                    for w in adj[v]:
                        if w not in dist:
                            dist[w], sigma[w], preds[w] = dist[v] + 1, 0.0, []
                            queue.append(w)
                        if dist[w] == dist[v] + 1:
                            sigma[w] += sigma[v]
                            preds[w].append(v)
                delta = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in preds[w]:
                        delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
                    if w != s:
                        total[w] = total.get(w, 0.0) + delta[w]
        if total:
            yield pd.DataFrame({"node": list(total), "b": list(total.values())}, columns=["node", "b"])

    sources = edges.sparkSession.createDataFrame([(v,) for v in chosen], "node string").repartition(min(256, max(8, len(chosen) // 64)))
    return sources.mapInPandas(run, "node string, b double").groupBy("node").agg((F.sum("b") * scale).alias("betweenness"))


def components_strong(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, scc): the smallest node of each strongly connected component, by forward and backward colouring.

    A node's colour is the smallest node that reaches it; nodes of a colour that reach its
    first node are one component. They leave, and the rest, cut at the borders of colours, is
    coloured again. Every step is one join on nodes; no pairs of nodes are formed.
    """
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    left = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    done: DataFrame | None = None
    for _ in range(rounds):
        colour = left.withColumn("c", F.col("node"))
        while True:
            step = e.join(colour, e.src == colour.node).groupBy(F.col("dst").alias("t")).agg(F.min("c").alias("m"))
            new = cut(colour.join(step, F.col("node") == F.col("t"), "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c")))
            same = new.join(colour.select("node", F.col("c").alias("o")), "node").where("c <> o").isEmpty()
            colour = new
            if same:
                break
        ends = e.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst")
        inner = cut(ends.where("cs = cd").select("src", "dst"))
        got = front = cut(colour.where("node = c").select("node"))
        while not front.isEmpty():
            front = cut(inner.join(front, inner.dst == front.node).select(F.col("src").alias("node")).distinct().join(got, "node", "left_anti"))
            got = got.unionByName(front)
        got = cut(got)
        part = colour.join(got, "node", "left_semi").select("node", F.col("c").alias("scc"))
        done = part if done is None else done.unionByName(part)
        left = cut(left.join(got, "node", "left_anti"))
        if left.isEmpty():
            return done
        e = cut(inner.join(got.select(F.col("node").alias("src")), "src", "left_anti").join(got.select(F.col("node").alias("dst")), "dst", "left_anti"))
    raise RuntimeError(f"strong components did not settle within {rounds} rounds")


def condensation(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """Edges between strong components: (src, dst, n) with the number of edges that cross."""
    e = edges.join(scc.select(F.col("node").alias("src"), F.col("scc").alias("a")), "src").join(scc.select(F.col("node").alias("dst"), F.col("scc").alias("b")), "dst")
    return e.where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def kernel(edges: DataFrame, anchors: list[str], fraction: float = 0.10, exact_nodes: int | None = None) -> DataFrame:
    """The ceil(fraction * n) nodes with the largest 0.4 degree + 0.4 betweenness + 0.2 groundedness, each scaled to its largest value.

    Betweenness is exact, unless ``exact_nodes`` lets larger graphs take pivots."""
    deg = degrees(edges).select("node", (F.col("out_degree") + F.col("in_degree")).alias("d"))
    all_ = deg.join(betweenness(edges, exact_nodes), "node", "left").join(groundedness(edges, anchors, 3), "node", "left")
    all_ = with_total(all_, top_d=F.max("d"), top_b=F.max("betweenness"), n=F.count(F.lit(1)))
    part = lambda c, top: F.coalesce(F.try_divide(F.coalesce(F.col(c), F.lit(0.0)), F.col(top)), F.lit(0.0))
    near = 1 - F.least(F.coalesce("hop", F.lit(3)), F.lit(3)) / 3
    # Equal nodes must tie whatever the order of their sums.
    scored = cut(all_.select("node", F.round(0.40 * part("d", "top_d") + 0.40 * part("betweenness", "top_b") + 0.20 * near, 9).alias("score")))
    k = max(1, math.ceil(fraction * scored.count()))
    # The kernel is the answer's size, a share of the nodes; it is ranked after the cut.
    best = scored.orderBy(F.col("score").desc(), "node").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "node")))


def centrality(edges: DataFrame, rounds: int = 20, tol: float | None = None) -> DataFrame:
    """Eigenvector centrality of the symmetric graph, largest value 1: power rounds of A + I, which bipartite graphs cannot make swing.

    With ``tol`` rounds go on until no value changes by more, and ``rounds`` without that raise.
    """
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    both = both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    if tol is not None and (small := _sparse(both)) is not None:
        import numpy as np

        names, row, col, w = small

        def step(v):
            new = v + np.bincount(row, w * v[col], len(names))
            return new / new.max()

        value = _settle(np.ones(len(names)), step, rounds, tol) if names else []
        return edges.sparkSession.createDataFrame(list(zip(names, map(float, value), strict=True)), "node string, v double")
    both = both if tol is None else cut(both)
    value = both.select(F.col("src").alias("node")).distinct().withColumn("v", F.lit(1.0))
    for _ in range(rounds):
        got = both.join(value, both.dst == value.node).groupBy(F.col("src").alias("node")).agg(F.sum(F.col("weight") * F.col("v")).alias("a"))
        old, value = value, value.join(got, "node").withColumn("v", F.col("v") + F.col("a"))
        value = with_total(cut(value), top=F.max("v")).select("node", (F.col("v") / F.col("top")).alias("v"))
        if tol is not None:
            value = cut(value)
            if _moved(old, value) <= tol:
                return value
    if tol is not None:
        raise RuntimeError(f"not converged after {rounds} rounds")
    return value


def feedback_vertices(edges: DataFrame, nodes_limit: int = 2000, exact: int = 20) -> list[str]:
    """Nodes whose removal leaves no cycle: a smallest set for at most ``exact`` nodes on cycles, else greedy and then pruned.

    Edges from nodes without an edge in, or to nodes without one out, lie on no cycle and go before anything reaches the driver; more than
    ``nodes_limit`` nodes that are left are refused."""
    e = cut(edges.select("src", "dst").distinct())
    n = e.count()
    while n:
        ends = lambda a, b: e.select(F.col(a).alias(b)).distinct()
        core = cut(e.join(ends("dst", "src"), "src", "left_semi").join(ends("src", "dst"), "dst", "left_semi").select("src", "dst"))
        before, e, n = n, core, core.count()
        if n == before or n <= nodes_limit:
            break
    rows = e.limit(nodes_limit * nodes_limit).collect()
    after: dict[str, set[str]] = {}
    for a, b in rows:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())
    if len(after) > nodes_limit:
        raise RuntimeError(f"more than {nodes_limit} nodes")

    def cyclic(gone: set[str]) -> set[str]:
        """What is left when nodes without an edge in or out go, again and again."""
        left = set(after) - gone
        while True:
            heads = {b for a in left for b in after[a]} & left
            stay = {a for a in heads if after[a] & left}
            if stay == left:
                return left
            left = stay

    core = cyclic(set())
    if len(core) <= exact:
        for size in range(len(core) + 1):
            for pick in combinations(sorted(core), size):
                if not cyclic(set(pick)):
                    return list(pick)
    gone: set[str] = set()
    while left := cyclic(gone):
        into = {v: sum(v in after[a] for a in left) for v in left}
        gone.add(min(left, key=lambda v: (v not in after[v], -into[v] * len(after[v] & left), v)))
    for v in sorted(gone):
        if not cyclic(gone - {v}):
            gone.remove(v)
    return sorted(gone)
