"""Queries of operators/dedup.py and operators/structure.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup as D
from ..operators import graph as G
from ..operators import search as S
from ..operators import structure as X
from ..registry import _cos_sql, _EDGES, _edges, query, r6, read

#: Low enough for pairs on both sides of the bar.
_TAU = {0: 0.25, 1: 0.25, 2: 0.25, 3: 0.25}
_PAIRS = "(SELECT a.id AS a, b.id AS b, a.anchor AS x, b.anchor AS y FROM v a JOIN v b ON a.id < b.id WHERE " + " AND ".join(
    _cos_sql(f"a.e[{16 * k + 1}:{16 * k + 16}]::DOUBLE[]", f"b.e[{16 * k + 1}:{16 * k + 16}]::DOUBLE[]") + " >= 0.25" for k in range(4)
) + ")"
_V = "WITH RECURSIVE v AS (SELECT min(vec_id) AS id, embedding AS e, arg_min(CASE WHEN vec_id % 3 > 0 THEN vec_id % 2 END, vec_id) AS anchor FROM embeddings GROUP BY embedding)"


def _pairs(s, d):
    e = read(s, d, "embeddings")
    anchors = e.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 > 0, F.col("vec_id") % 2).alias("anchor"))
    return D.conflicts(D.slot_pairs(e, _TAU, 16), anchors)


@query("slot_dedup_pairs", f"{_V} SELECT a, b, coalesce(x <> y, false) AS conflict FROM (SELECT p.a, p.b, CASE WHEN p.a % 3 > 0 THEN p.a % 2 END AS x, CASE WHEN p.b % 3 > 0 THEN p.b % 2 END AS y FROM {_PAIRS} p)")
def _(s, d):
    return _pairs(s, d).select("a", "b", "conflict")


@query(
    "slot_dedup_collapse",
    f"""{_V}, p AS (SELECT a, b FROM {_PAIRS} WHERE NOT coalesce((CASE WHEN a % 3 > 0 THEN a % 2 END) <> (CASE WHEN b % 3 > 0 THEN b % 2 END), false)),
    t AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r(a, b) AS (SELECT id, id FROM v UNION SELECT r.a, t.b FROM r JOIN t ON r.b = t.a)
    SELECT a AS vec_id FROM r GROUP BY a HAVING min(b) = a""",
)
def _(s, d):
    e = read(s, d, "embeddings")
    first = e.groupBy("embedding").agg(F.min("vec_id").alias("vec_id")).select("vec_id")
    return D.merged(first, _pairs(s, d), "collapse", "vec_id")


_PERM = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(D.permutations()))


@query(
    "minhash_pairs",
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, greatest(len(w) - 1, 1))) AS t(i) WHERE len(w) >= 30),
    h AS (SELECT doc_id, CAST('0x' || substr(md5(g), 1, 7) AS BIGINT) AS h FROM g), p(i, a, b) AS (VALUES {_PERM}),
    m AS (SELECT doc_id, i, min((a * h + b) % {D.PRIME}) AS m FROM h, p GROUP BY 1, 2), s AS (SELECT doc_id, list(m ORDER BY i) AS m FROM m GROUP BY 1), c AS (SELECT min(doc_id) AS id, m FROM s GROUP BY m),
    k AS (SELECT id, m, band, m[band * 4 + 1 : band * 4 + 4] AS key FROM c, unnest(range(0, 16)) AS t(band)), q AS (SELECT DISTINCT x.id AS a, y.id AS b, x.m AS x, y.m AS y FROM k x JOIN k y ON x.band = y.band AND x.key = y.key AND x.id < y.id)
    SELECT * FROM (SELECT a, b, len([i FOR i IN range(1, 65) IF x[i] = y[i]]) / 64.0::DOUBLE AS similarity FROM q) WHERE similarity >= 0.5""",
)
def _(s, d):
    docs = read(s, d, "documents")
    return D.minhash_pairs(docs, S.tokens(F.coalesce("text", F.lit(""))), 0.5)


def _domains(s, d):
    n = _edges(s, d).select(F.col("src").alias("node")).union(_edges(s, d).select("dst")).distinct()
    return n.withColumn("domain", F.substring("node", 1, 1))


@query("domain_bridges", f"SELECT substr(src, 1, 1) AS from_domain, substr(dst, 1, 1) AS to_domain, count(*) AS n, round(sum(weight), 6) AS weight FROM {_EDGES} WHERE substr(src, 1, 1) <> substr(dst, 1, 1) GROUP BY 1, 2")
def _(s, d):
    return X.bridges(_edges(s, d), _domains(s, d)).withColumn("weight", r6("weight"))


_CHAIN = f"(SELECT a.src AS start, b.dst AS \"end\", max(a.weight * b.weight) AS score FROM {_EDGES} a JOIN {_EDGES} b ON a.dst = b.src WHERE substr(a.src, 1, 1) = 's' AND substr(b.dst, 1, 1) = 'r' GROUP BY 1, 2)"


def _chains(s, d):
    n = _domains(s, d)
    return X.chains(_edges(s, d), n.where("domain = 's'"), n.where("domain = 'r'"), 2)


@query("discovery_chains", f'SELECT start, "end", round(score, 6) AS score FROM {_CHAIN}')
def _(s, d):
    return _chains(s, d).withColumn("score", r6("score"))


@query("grounded_chains", f"SELECT start, \"end\", round(score, 6) AS score, CASE WHEN \"end\" IN ('r0', 'r2') THEN 0 END AS hop FROM {_CHAIN} WHERE \"end\" IN ('r0', 'r2')")
def _(s, d):
    zero = G.groundedness(_edges(s, d), ["r0", "r2"], 3).where("hop = 0")
    return X.grounded_chains(_chains(s, d), zero).withColumn("score", r6("score"))


@query("probe_matrix", f"SELECT start, count(*) AS ends, round(max(score), 6) AS best, round(avg(score), 6) AS mean FROM {_CHAIN} GROUP BY start")
def _(s, d):
    return X.probes(_chains(s, d)).withColumns({"best": r6("best"), "mean": r6("mean")})


@query("longest_depth", f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_EDGES} WHERE src NOT LIKE 'r%'), w(node, last, depth) AS (SELECT n, n, 0 FROM (SELECT src AS n FROM e UNION SELECT dst FROM e) UNION ALL SELECT w.node, dst, depth + 1 FROM w JOIN e ON last = src) SELECT node, max(depth) AS depth FROM w GROUP BY node")
def _(s, d):
    return X.depths(_edges(s, d).where("src NOT LIKE 'r%'"))


@query("coverage_quadrants", "WITH q AS (SELECT CASE WHEN score >= 0.5 AND density >= 0.3 THEN 'important_covered' WHEN score >= 0.5 THEN 'important_gap' WHEN density >= 0.3 THEN 'minor_covered' ELSE 'minor_gap' END AS quadrant, score FROM (SELECT n_nationkey, (n_nationkey % 10) / 10.0::DOUBLE AS score, count(s_suppkey) / CAST(max(count(s_suppkey)) OVER () AS DOUBLE) AS density FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2)) SELECT quadrant, count(*) AS n, round(sum(score), 6) AS score FROM q GROUP BY 1")
def _(s, d):
    per = read(s, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("c"))
    n = read(s, d, "nation").join(per, "n_nationkey", "left").select("n_nationkey", ((F.col("n_nationkey") % 10) / 10.0).alias("score"), F.coalesce("c", F.lit(0)).alias("c"))
    n = n.crossJoin(F.broadcast(n.agg(F.max("c").alias("top")))).withColumn("density", F.col("c") / F.col("top"))
    return X.gap_report(X.quadrants(n, "score", "density", 500, 300), "score").withColumn("score", r6("score"))


@query("derived_edges", "SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst, 'TESTS' AS type FROM supplier WHERE s_suppkey % 2 = 1 AND s_nationkey % 2 = 0")
def _(s, d):
    """Calls of test nodes (odd) to nodes that are no tests (even)."""
    e = _edges(s, d).where("src LIKE 's%'")
    n = _domains(s, d).withColumn("is_test", F.substring("node", 2, 20).cast("long") % 2 == 1)
    return X.derived(e, n, "TESTS", F.col("is_test"), ~F.col("is_test"))


@query("graph_condensation", f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_EDGES}), r(a, b) AS (SELECT n, n FROM (SELECT src AS n FROM e UNION SELECT dst FROM e) UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src), c AS (SELECT x.a AS node, min(x.b) AS scc FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a) SELECT p.scc AS src, q.scc AS dst, count(*) AS n FROM e JOIN c p ON p.node = e.src JOIN c q ON q.node = e.dst WHERE p.scc <> q.scc GROUP BY 1, 2")
def _(s, d):
    e = _edges(s, d).select("src", "dst").distinct()
    return G.condensation(e, G.components_strong(e))


_WALK = "WITH RECURSIVE e AS ({edges}), w(node, score, hop) AS (SELECT '{start}', 1.0::DOUBLE, 0 UNION ALL SELECT dst, score * weight * 0.9::DOUBLE, hop + 1 FROM w JOIN e ON w.node = e.src WHERE hop < {hops}) SELECT node, round(max(score), 6) AS score FROM w WHERE hop > 0 AND node <> '{start}' GROUP BY node"


@query("graph_scored_traverse_in", _WALK.format(edges=f"SELECT dst AS src, src AS dst, weight FROM {_EDGES}", start="r1", hops=3))
def _(s, d):
    """Reverse query: what leads to a region."""
    return G.scored_traverse(_edges(s, d), "r1", 3, direction="in").withColumn("score", r6("score"))


@query("graph_scored_traverse_both", _WALK.format(edges=f"SELECT src, dst, weight FROM {_EDGES} UNION ALL SELECT dst, src, weight FROM {_EDGES}", start="n3", hops=2))
def _(s, d):
    return G.scored_traverse(_edges(s, d), "n3", 2, direction="both").withColumn("score", r6("score"))


query("kernel_report")(lambda s, d: X.kernel_report(_edges(s, d), ["r0", "r3"]).withColumn("score", r6("score")))

_C = _cos_sql("q.embedding::DOUBLE[]", "e.embedding::DOUBLE[]")


@query(
    "kernel_recall",
    f"""WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS cx_id, {_C} AS c FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, cx_id) AS k FROM p) WHERE k <= 10),
    g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, cx_id) AS k FROM p WHERE cx_id % 4 > 0) WHERE k <= 10)
    SELECT f.query_id, round(count(g.cx_id) / CAST(count(*) AS DOUBLE), 6) AS ratio FROM f LEFT JOIN g ON f.query_id = g.query_id AND f.cx_id = g.cx_id GROUP BY 1""",
)
def _(s, d):
    """Three quarters of the rows as the kernel."""
    e = read(s, d, "embeddings")
    return X.recall_ratio(e, e.where("vec_id % 4 > 0"), e.where("vec_id % 20 = 0")).withColumn("ratio", r6("ratio"))
