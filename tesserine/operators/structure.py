"""Structure of a graph: bridges between domains, chains, depth, quadrants, derived edges, kernel reports and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .lineage import cut
from .search import knn_many

MAX_DEPTH = 256


def bridges(edges: DataFrame, domains: DataFrame) -> DataFrame:
    """(from_domain, to_domain, n, weight): edges whose ends lie in different domains (node, domain)."""
    a = domains.select(F.col("node").alias("src"), F.col("domain").alias("from_domain"))
    b = domains.select(F.col("node").alias("dst"), F.col("domain").alias("to_domain"))
    e = edges.join(a, "src").join(b, "dst").where("from_domain <> to_domain")
    return e.groupBy("from_domain", "to_domain").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


def chains(edges: DataFrame, starts: DataFrame, ends: DataFrame, hops: int) -> DataFrame:
    """(start, end, score): the best product of weights over walks of exactly ``hops`` edges from a start to an end (node)."""
    if not 1 <= hops <= 10:
        raise ValueError("1 to 10 hops")
    front = starts.select(F.col("node").alias("start"), F.col("node").alias("at"), F.lit(1.0).alias("score"))
    e = edges.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    for _ in range(hops):
        front = front.join(e, F.col("at") == F.col("src")).groupBy("start", F.col("dst").alias("at")).agg(F.max(F.col("score") * F.col("weight")).alias("score"))
    return front.join(ends.select(F.col("node").alias("at")), "at", "left_semi").select("start", F.col("at").alias("end"), "score")


def grounded_chains(chain: DataFrame, ground: DataFrame) -> DataFrame:
    """Chains whose end is grounded (node, hop), with the hops to its anchor."""
    return chain.join(ground.select(F.col("node").alias("end"), "hop"), "end").select("start", "end", "score", "hop")


def probes(chain: DataFrame) -> DataFrame:
    """(start, ends, best, mean): what each start can be probed for."""
    return chain.groupBy("start").agg(F.count(F.lit(1)).alias("ends"), F.max("score").alias("best"), F.avg("score").alias("mean"))


def depths(edges: DataFrame, cap: int = MAX_DEPTH) -> DataFrame:
    """(node, depth): edges on the longest way out of a node; cycles are broken by taking each strong component as one step. More than ``cap`` is an error."""
    scc = graph.components_strong(edges)
    e = cut(graph.condensation(edges, scc).select("src", "dst"))
    comps = scc.select(F.col("scc").alias("c")).distinct()
    depth = comps.withColumn("depth", F.lit(0))
    for _ in range(cap):
        step = e.join(depth, e.dst == depth.c).groupBy("src").agg((F.max("depth") + 1).alias("d"))
        new = cut(comps.join(step, F.col("c") == F.col("src"), "left").select("c", F.coalesce("d", F.lit(0)).alias("depth")))
        if new.exceptAll(depth).isEmpty():
            return scc.join(new, F.col("scc") == F.col("c")).select("node", "depth")
        depth = new
    raise RuntimeError(f"ways of more than {cap} edges")


def quadrants(nodes: DataFrame, score: str, density: str, importance_permille: int = 500, coverage_permille: int = 500) -> DataFrame:
    """Nodes with ``quadrant``: important by score and covered by anchor density, each in permille of one."""
    important, covered = F.col(score) * 1000 >= importance_permille, F.col(density) * 1000 >= coverage_permille
    name = F.when(important & covered, "important_covered").when(important, "important_gap").when(covered, "minor_covered").otherwise("minor_gap")
    return nodes.withColumn("quadrant", name)


def gap_report(nodes: DataFrame, score: str) -> DataFrame:
    """(quadrant, n, score): how many nodes each quadrant has and their total score."""
    return nodes.groupBy("quadrant").agg(F.count(F.lit(1)).alias("n"), F.sum(score).alias("score"))


def derived(edges: DataFrame, nodes: DataFrame, kind: str, source: Column, target: Column) -> DataFrame:
    """Edges of a new ``type`` between ends that meet conditions on columns of nodes (node, ...), as tests that call code that is none."""
    e = edges.select("src", "dst").distinct()
    a = nodes.where(source).select(F.col("node").alias("src"))
    b = nodes.where(target).select(F.col("node").alias("dst"))
    return e.join(a, "src", "left_semi").join(b, "dst", "left_semi").withColumn("type", F.lit(kind))


def kernel_report(edges: DataFrame, anchors: list[str], fraction: float = 0.10, max_hops: int = 3) -> DataFrame:
    """Kernel of a graph with, for each of its nodes, its strong component's size, whether it is among the feedback vertices
    of the kernel's own subgraph, and whether it is a grounding gap (no anchor within ``max_hops``)."""
    top = cut(graph.kernel(edges, anchors, fraction))
    scc = graph.components_strong(edges)
    size = scc.groupBy("scc").agg(F.count(F.lit(1)).alias("component_size"))
    inner = edges.join(top.select(F.col("node").alias("src")), "src", "left_semi").join(top.select(F.col("node").alias("dst")), "dst", "left_semi")
    cyclic = graph.feedback_vertices(inner)
    ground = graph.groundedness(edges, anchors, max_hops).select("node", "hop")
    out = top.join(scc, "node").join(size, "scc").join(ground, "node", "left")
    return out.select("node", "score", "rank", "component_size", F.col("node").isin(cyclic).alias("feedback"), F.col("hop").isNull().alias("gap"))


def recall_ratio(vectors: DataFrame, kernel: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, ratio): the share of a query's k nearest rows that a subset of the rows holds among its own k nearest."""
    full = knn_many(vectors, queries, k, id_col, vec_col)
    part = knn_many(vectors.join(kernel.select(id_col), id_col, "left_semi").select(*vectors.columns), queries, k, id_col, vec_col)
    hit = part.select("query_id", "cx_id", F.lit(1).alias("hit"))
    return full.join(hit, ["query_id", "cx_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("ratio"))
