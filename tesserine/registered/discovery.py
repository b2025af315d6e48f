"""Queries of operators/discovery.py, operators/blindspots.py and of windowed recall, over parts, suppliers, orders and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import blindspots as B
from ..operators import discovery as X
from ..operators import events as E
from ..operators.lineage import cut
from ..operators.search import ALL_LANES
from ..registry import _cos_sql, QUERY, _QL, query, r6, read

#: Parts and suppliers that share order lines, in both directions, by quantity; a node's frequency is its number of lines.
_TRADE = """
w AS (SELECT 'p' || l_partkey AS p, 's' || l_suppkey AS s, least(1.0::DOUBLE, sum(l_quantity) / 60) AS w FROM lineitem GROUP BY 1, 2),
e AS (SELECT p AS src, s AS dst, w AS weight FROM w UNION ALL SELECT s, p, 0.9::DOUBLE * w FROM w),
f AS (SELECT 'p' || l_partkey AS node, CAST(count(*) AS DOUBLE) AS frequency FROM lineitem GROUP BY 1 UNION ALL SELECT 's' || l_suppkey, CAST(count(*) AS DOUBLE) FROM lineitem GROUP BY 1),
g AS (SELECT node, CAST(CASE WHEN node LIKE 's%' THEN CAST(substr(node, 2) AS BIGINT) % 5 ELSE CAST(substr(node, 2) AS BIGINT) % 4 + 1 END AS INTEGER) AS hop FROM f WHERE CAST(substr(node, 2) AS BIGINT) % 7 > 0)"""


def _trade(s, d):
    """(edges, nodes, ground): suppliers lie 0 to 4 hops and parts 1 to 4 hops from an anchor, every seventh has none."""
    line = read(s, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("p"), F.concat(F.lit("s"), "l_suppkey").alias("s"), "l_quantity")
    w = line.groupBy("p", "s").agg(F.least(F.lit(1.0), F.sum("l_quantity") / 60).alias("w"))
    edges = w.select(F.explode(F.array(F.struct(F.col("p").alias("src"), F.col("s").alias("dst"), F.col("w").alias("weight")), F.struct(F.col("s").alias("src"), F.col("p").alias("dst"), (F.col("w") * 0.9).alias("weight")))).alias("e")).select("e.*")
    nodes = line.select(F.explode(F.array("p", "s")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).cast("double").alias("frequency"))
    number = F.substring("node", 2, 20).cast("long")
    hop = F.when(F.col("node").startswith("s"), number % 5).otherwise(number % 4 + 1).cast("int")
    return edges, nodes, nodes.where(number % 7 > 0).select("node", hop.alias("hop"))


def _hops(width: int, probes: int, hops: int) -> str:
    """The frontiers of ``hops`` hops, one after the other."""
    out = [f"""WITH {_TRADE},
    r AS (SELECT * FROM (SELECT src, dst, weight, weight * (0.65::DOUBLE + 0.35::DOUBLE * (1 / (1 + frequency))) AS score,
                                CASE WHEN hop = 0 THEN 1.0::DOUBLE WHEN hop <= 3 THEN 1 - hop / 4.0::DOUBLE END AS confidence,
                                row_number() OVER (PARTITION BY src ORDER BY weight * (0.65::DOUBLE + 0.35::DOUBLE * (1 / (1 + frequency))) DESC, dst) AS k
                         FROM e JOIN f ON e.dst = f.node LEFT JOIN g ON e.dst = g.node) WHERE k <= {probes}),
    f0 AS (SELECT 'p' || p_partkey AS chain, 'p' || p_partkey AS src, ['p' || p_partkey] AS seen, ['p' || p_partkey] AS path, 1.0::DOUBLE AS raw FROM part WHERE p_partkey % 20 = 0)"""]
    for h in range(1, hops + 1):
        out.append(f"""
    c{h} AS (SELECT *, verdict = 'pass' AND row_number() OVER (PARTITION BY chain, verdict ORDER BY score DESC, confidence DESC, dst, src) <= {width} AS selected FROM (
      SELECT x.chain, {h} AS hop, x.src, r.dst, r.score, x.raw * r.weight AS raw, coalesce(confidence, 0) AS confidence,
             CASE WHEN list_contains(x.seen, r.dst) THEN 'visited_loop' WHEN confidence IS NULL THEN 'ungrounded' WHEN confidence < 0.25 THEN 'low_confidence' ELSE 'pass' END AS verdict,
             list_append(x.path, r.dst) AS path, x.seen FROM f{h - 1} x JOIN r ON x.src = r.src)),
    f{h} AS (SELECT chain, dst AS src, list_concat(seen, list(dst) OVER (PARTITION BY chain)) AS seen, path, raw FROM c{h} WHERE selected)""")
    return ",".join(out)


_WALK = _hops(2, 6, 3)
_LOG = " UNION ALL ".join(f"SELECT chain, hop, src, dst, round(score, 6) AS score, round(raw * {0.9**h!r}, 6) AS path_score, round(confidence, 6) AS confidence, verdict, selected, array_to_string(path, '>') AS path FROM c{h}" for h in (1, 2, 3))


def _discovered(s, d):
    edges, nodes, ground = _trade(s, d)
    starts = read(s, d, "part").where("p_partkey % 20 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("chain"), F.concat(F.lit("p"), "p_partkey").alias("node"))
    return X.discover(edges, nodes, starts, ground, X.reach_gate(3), max_hops=3, branch_width=2, probe_width=6)


@query("discovery_log", f"{_WALK} SELECT * FROM ({_LOG})")
def _(s, d):
    log = _discovered(s, d)[0]
    return log.withColumns({**{c: r6(c) for c in ("score", "path_score", "confidence")}, "path": F.array_join("path", ">")})


@query(
    "discovery_ends",
    f"""{_WALK}, t AS (SELECT chain, max(hop) AS hops FROM (SELECT chain, hop FROM c1 UNION ALL SELECT chain, hop FROM c2 UNION ALL SELECT chain, hop FROM c3) GROUP BY 1),
    l AS (SELECT DISTINCT chain FROM f3), o AS (SELECT chain, 1 AS h FROM f1 UNION SELECT chain, 2 FROM f2 UNION SELECT chain, 3 FROM f3), m AS (SELECT chain, max(h) AS h FROM o GROUP BY 1)
    SELECT f0.chain, CAST(CASE WHEN f0.chain IN (SELECT chain FROM l) THEN 3 ELSE coalesce(m.h, 0) + 1 END AS INTEGER) AS hops,
           CASE WHEN f0.chain IN (SELECT chain FROM l) THEN 'max_hops' WHEN coalesce(t.hops, 0) > coalesce(m.h, 0) THEN 'no_gate_pass' ELSE 'frontier_exhausted' END AS ended
    FROM f0 LEFT JOIN t USING (chain) LEFT JOIN m USING (chain)""",
)
def _(s, d):
    return _discovered(s, d)[1]


@query(
    "ranked_bridges",
    f"""WITH {_TRADE}, i AS (SELECT DISTINCT p_brand AS a, 'r' || n_regionkey AS b, 'p' || p_partkey AS node, (p_partkey % 100) / 100.0::DOUBLE AS centrality, (p_partkey % 10) / 10.0::DOUBLE AS confidence, p_partkey % 3 > 0 AS passed
                           FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
    k AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1),
    j AS (SELECT a, b, i.node, passed AND confidence >= 0.25 AS ok, frequency, degree,
                 0.35::DOUBLE * (frequency / (SELECT max(frequency) FROM f)) + 0.30::DOUBLE * (degree / CAST((SELECT max(degree) FROM k) AS DOUBLE)) + 0.20::DOUBLE * centrality + 0.15::DOUBLE * confidence AS score
          FROM i JOIN f ON i.node = f.node JOIN k ON i.node = k.node)
    SELECT a, b, node, round(score, 6) AS score, rank, refused FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY a, b, ok ORDER BY score DESC, frequency DESC, degree DESC, node) AS INTEGER) AS rank, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY a, b) AS refused FROM j)
    WHERE ok AND rank <= 3""",
)
def _(s, d):
    edges, nodes, _ = _trade(s, d)
    line = read(s, d, "lineitem").join(read(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(read(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(read(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    inputs = line.select(
        F.col("p_brand").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b"), F.concat(F.lit("p"), "p_partkey").alias("node"),
        (F.col("p_partkey") % 100 / 100.0).alias("centrality"), (F.col("p_partkey") % 10 / 10.0).alias("confidence"), (F.col("p_partkey") % 3 > 0).alias("passed"),
    ).distinct()
    return X.ranked_bridges(edges, nodes, inputs, per_pair=3).withColumn("score", r6("score"))


@query(
    "ranked_hypotheses",
    """WITH h AS (SELECT o_orderkey AS id, (o_orderkey % 97) / 97.0::DOUBLE AS novelty, (o_custkey % 89) / 89.0::DOUBLE AS confidence, o_orderkey % 7 AS distance, (o_orderkey * 7 % 101) / 101.0::DOUBLE AS plausibility FROM orders),
    s AS (SELECT *, novelty * 0.25::DOUBLE + confidence * 0.30::DOUBLE + distance / CAST((SELECT max(distance) FROM h) AS DOUBLE) * 0.20::DOUBLE + plausibility * 0.25::DOUBLE AS score FROM h),
    k AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, confidence DESC, distance DESC, id) AS INTEGER) AS rank FROM s)
    SELECT id, round(score, 6) AS score, rank, rank <= 10 AND score >= 0.65 AS review FROM k WHERE rank <= 64""",
)
def _(s, d):
    o = read(s, d, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 97 / 97.0).alias("novelty"), (F.col("o_custkey") % 89 / 89.0).alias("confidence"),
        (F.col("o_orderkey") % 7).alias("distance"), (F.col("o_orderkey") * 7 % 101 / 101.0).alias("plausibility"),
    )
    return X.ranked_hypotheses(o).withColumn("score", r6("score"))


def _slot(row: str, k: int) -> str:
    return f"{row}.embedding[{16 * k + 1}:{16 * k + 16}]::DOUBLE[]"


_ALL_DELTAS = f"""WITH p AS (SELECT q.vec_id AS cx_id, e.vec_id AS other_id, {_cos_sql(_slot('q', 0), _slot('e', 0))} AS a, {_cos_sql(_slot('q', 1), _slot('e', 1))} AS b FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id),
    n AS (SELECT *, row_number() OVER (PARTITION BY cx_id ORDER BY a DESC, other_id) AS k FROM p),
    d AS (SELECT cx_id, avg(a) AS own, avg(b) AS other, avg(a) - avg(b) AS delta FROM n WHERE k <= 5 GROUP BY 1)"""

_DELTAS = _ALL_DELTAS.replace("q.vec_id <> e.vec_id)", "q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)")


def _deltas(s, d):
    e = read(s, d, "embeddings")
    return B.differences(e, e.where("vec_id % 20 = 0"), 0, 1, 16, 5)


def _all_deltas(s, d):
    e = read(s, d, "embeddings")
    return B.differences(e, e, 0, 1, 16, 5, query_lanes=ALL_LANES)


@query("blind_spots", f"{_DELTAS} SELECT cx_id, round(own, 6) AS own, round(other, 6) AS other, round(delta, 6) AS delta, CASE WHEN delta >= 0.8 THEN 'high' WHEN delta >= 0.65 THEN 'medium' ELSE 'low' END AS severity FROM d WHERE delta >= 0.5")
def _(s, d):
    return B.plain(_deltas(s, d)).withColumns({c: r6(c) for c in ("own", "other", "delta")})


@query(
    "blind_spots_calibrated",
    f"""{_ALL_DELTAS}, c AS (SELECT x.cx_id, x.delta, count(*) FILTER (WHERE y.delta <= x.delta) / CAST(count(*) AS DOUBLE) AS percentile, count(*) FILTER (WHERE y.delta >= x.delta) / CAST(count(*) AS DOUBLE) AS p_value FROM d x, d y GROUP BY 1, 2)
    SELECT cx_id, round(delta, 6) AS delta, round(percentile, 6) AS percentile, round(p_value, 6) AS p_value, CASE WHEN percentile >= 1 - 0.4::DOUBLE / 3 THEN 'high' WHEN percentile >= 1 - 2 * 0.4::DOUBLE / 3 THEN 'medium' ELSE 'low' END AS severity FROM c WHERE p_value <= 0.4""",
)
def _(s, d):
    x = cut(_all_deltas(s, d))  # counted, ranked and returned
    return B.calibrated(x, x, alpha=0.4, least=20).withColumns({c: r6(c) for c in ("delta", "percentile", "p_value")})


@query(
    "windowed_recall",
    f"""WITH h AS (SELECT vec_id AS cx_id, round({_cos_sql('embedding::DOUBLE[]', _QL)}, 9) AS score FROM embeddings), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, cx_id) AS k FROM h),
    b AS (SELECT min(b) AS b, min(i) AS rounds FROM (VALUES (10, 1), (40, 2), (160, 3), (640, 4), (2560, 5), (10240, 6)) t(b, i) WHERE (SELECT count(*) FROM k WHERE k <= b AND cx_id % 7 = 3) >= 15)
    SELECT cx_id, score, CAST(rounds AS INTEGER) AS rounds, CAST(b AS INTEGER) AS budget FROM k, b WHERE k <= b AND cx_id % 7 = 3 ORDER BY score DESC, cx_id LIMIT 15""",
)
def _(s, d):
    """Every seventh row lies in the window; the budget starts at 10."""
    hits = read(s, d, "embeddings").select(F.col("vec_id").alias("cx_id"), F.round(V.cosine(F.col("embedding"), V.literal(QUERY)), 9).alias("score"))
    top, report = E.windowed_recall(hits, 15, 10, F.col("cx_id") % 7 == 3, 10_240)
    return top.select("cx_id", "score", F.lit(report["rounds"]).alias("rounds"), F.lit(report["budget"]).alias("budget"))
