"""Discovery over association graphs: ranked bridges between domains, gated chains, ranked hypotheses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, with_total

# Fixed weights of the two rankings.
BRIDGE_WEIGHTS = {"frequency": 0.35, "degree": 0.30, "centrality": 0.20, "confidence": 0.15}
HYPOTHESIS_WEIGHTS = {"novelty": 0.25, "confidence": 0.30, "distance": 0.20, "plausibility": 0.25}
HOP_DECAY = 0.9


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): ends of edges at a node; a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def ranked_bridges(edges: DataFrame, nodes: DataFrame, inputs: DataFrame, least: float = 0.25, per_pair: int = 32) -> DataFrame:
    """Candidates (a, b, node, centrality, confidence, passed) that the gate lets through, ranked within their pair of domains.

    The score adds a node's share of the largest frequency (``nodes``: node, frequency), its share of the largest degree,
    its centrality and the gate's confidence. (a, b, node, score, rank, refused): ``refused`` counts the pair's other inputs.
    An input whose node has no frequency is an error.
    """
    known = with_total(nodes.select("node", "frequency"), _f=F.max("frequency"))
    deg = with_total(degrees(edges), _d=F.max("degree"))
    j = inputs.join(known, "node", "left").withColumn("frequency", F.coalesce("frequency", F.raise_error(F.lit("bridge input without a node")).cast("double")))
    j = j.join(deg, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    share = {"frequency": F.col("frequency") / F.col("_f"), "degree": F.coalesce(F.col("degree") / F.col("_d"), F.lit(0.0)), "centrality": F.col("centrality"), "confidence": F.col("confidence")}
    score = F.lit(0.0)
    for name, w in BRIDGE_WEIGHTS.items():
        score = score + share[name] * w
    j = j.select("a", "b", "node", "frequency", "degree", (F.col("passed") & (F.col("confidence") >= least)).alias("ok"), score.alias("score"))
    place = Window.partitionBy("a", "b", "ok").orderBy(F.col("score").desc(), F.col("frequency").desc(), F.col("degree").desc(), "node")
    refused = j.groupBy("a", "b").agg(F.count_if(~F.col("ok")).alias("refused"))
    top = j.withColumn("rank", F.row_number().over(place)).where(F.col("ok") & (F.col("rank") <= per_pair))
    return top.join(refused, ["a", "b"]).select("a", "b", "node", "score", "rank", "refused")


def reach_gate(radius: int) -> Callable[[Column], Column]:
    """Confidence from the hops to the nearest anchor: 1 at an anchor, falling to 0 beyond the radius, null where there is none."""
    return lambda hop: F.when(hop <= radius, F.when(hop == 0, 1.0).otherwise(1 - hop / (radius + 1)))


def discover(
    edges: DataFrame, nodes: DataFrame, starts: DataFrame, ground: DataFrame, gate: Callable[[Column], Column], max_hops: int = 100, branch_width: int = 3,
    probe_width: int = 16, least: float = 0.25, novelty_weight: float = 0.35,
) -> tuple[DataFrame, DataFrame]:
    """Chains of discovery from ``starts`` (chain, node), all chains at once; one join with the edges per hop.

    A node's ``probe_width`` best edges are its candidates, by weight and the novelty of their end (``nodes``: node,
    frequency). ``gate`` gives a confidence from the end's hops to an anchor (``ground``: node, hop). Of those that
    pass and are new to their chain, a chain takes its ``branch_width`` best as its next frontier.
    Returns the log (chain, hop, src, dst, score, path_score, confidence, verdict, selected, path) and how
    each chain ended (chain, hops, ended: max_hops, no_gate_pass, frontier_exhausted).
    """
    if min(max_hops, branch_width, probe_width) < 1 or not 0 <= least <= 1 or not 0 <= novelty_weight <= 1:
        raise ValueError("widths and hops start at 1, weights lie in [0, 1]")
    novelty = nodes.select(F.col("node").alias("dst"), (1 / (1 + F.col("frequency"))).alias("novelty"))
    e = edges.select("src", "dst", "weight").join(novelty, "dst")
    e = e.withColumn("score", F.col("weight") * ((1 - novelty_weight) + novelty_weight * F.col("novelty")))
    best = Window.partitionBy("src").orderBy(F.col("score").desc(), "dst")
    e = e.withColumn("k", F.row_number().over(best)).where(F.col("k") <= probe_width)
    e = cut(e.join(ground.select(F.col("node").alias("dst"), "hop"), "dst", "left").select("src", "dst", "weight", "score", gate(F.col("hop")).alias("confidence")))

    front = cut(starts.select("chain", F.col("node").alias("src"), F.lit(1.0).alias("raw"), F.array("node").alias("path")))
    visited, log, ended = starts.select("chain", F.col("node").alias("dst")).distinct(), None, None
    for hop in range(1, max_hops + 1):
        c = front.join(e, "src").join(visited.withColumn("seen", F.lit(True)), ["chain", "dst"], "left")
        verdict = F.when(F.col("seen"), "visited_loop").when(F.col("confidence").isNull(), "ungrounded").when(F.col("confidence") < least, "low_confidence").otherwise("pass")
        c = c.select("chain", "src", "dst", "score", (F.col("raw") * F.col("weight")).alias("raw"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), verdict.alias("verdict"), F.concat("path", F.array("dst")).alias("path"))
        place = Window.partitionBy("chain", "verdict").orderBy(F.col("score").desc(), F.col("confidence").desc(), "dst", "src")
        c = c.withColumn("selected", (F.col("verdict") == "pass") & (F.row_number().over(place) <= branch_width))
        c = cut(c.select("chain", F.lit(hop).alias("hop"), "src", "dst", "score", "raw", (F.col("raw") * HOP_DECAY**hop).alias("path_score"), "confidence", "verdict", "selected", "path"))
        log = c if log is None else log.unionByName(c)
        tried = c.groupBy("chain").agg(F.max("selected").alias("on"))
        stop = front.select("chain").distinct().join(tried, "chain", "left").where("NOT coalesce(`on`, false)")
        stop = stop.select("chain", F.lit(hop).alias("hops"), F.when(F.col("on").isNull(), "frontier_exhausted").otherwise("no_gate_pass").alias("ended"))
        ended = stop if ended is None else ended.unionByName(stop)
        on = c.where("selected")
        front = on.select("chain", F.col("dst").alias("src"), "raw", "path")
        visited = visited.unionByName(on.select("chain", "dst"))
        if front.isEmpty():
            break
    else:
        ended = ended.unionByName(front.select("chain").distinct().select("chain", F.lit(max_hops).alias("hops"), F.lit("max_hops").alias("ended")))
    return log.drop("raw"), ended


def ranked_hypotheses(inputs: DataFrame, most: int = 64, review: int = 10, least_review: float = 0.65) -> DataFrame:
    """(id, novelty, confidence, distance, plausibility) -> the ``most`` best with score, rank and whether a person should look at them.

    Terms other than the distance lie in [0, 1]; the distance counts as a share of the largest.
    """
    bad = F.lit(False)
    for c in ("novelty", "confidence", "plausibility"):
        bad = bad | ~F.coalesce(F.col(c).between(0, 1) & ~F.isnan(c), F.lit(False))
    checked = inputs.withColumn("novelty", F.when(bad, F.raise_error(F.lit("terms must lie in [0, 1]")).cast("double")).otherwise(F.col("novelty")))
    w = HYPOTHESIS_WEIGHTS
    j = with_total(checked, _far=F.greatest(F.max("distance"), F.lit(1)))
    score = F.col("novelty") * w["novelty"] + F.col("confidence") * w["confidence"] + F.col("distance") / F.col("_far") * w["distance"] + F.col("plausibility") * w["plausibility"]
    top = j.withColumn("score", score).orderBy(F.col("score").desc(), F.col("confidence").desc(), F.col("distance").desc(), "id").limit(most)
    place = Window.orderBy(F.col("score").desc(), F.col("confidence").desc(), F.col("distance").desc(), "id")  # at most ``most`` rows
    top = top.withColumn("rank", F.row_number().over(place))
    return top.select("id", "score", "rank", ((F.col("rank") <= review) & (F.col("score") >= least_review)).alias("review"))
