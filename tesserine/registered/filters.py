"""Queries of operators/filters.py."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import temporal as T
from ..operators import filters as X
from ..operators.lineage import cut
from ..registry import EPOCH, _edges, _EDGES, query, r6, read

_ANCHORS = "SELECT l_orderkey, l_returnflag AS kind, l_linestatus AS value, 1 - l_discount AS confidence, CAST(l_suppkey % 10 AS VARCHAR) AS source FROM lineitem"
_CX_NODES = "SELECT 's' || s_suppkey AS node, s_acctbal AS bal FROM supplier UNION ALL SELECT 'n' || n_nationkey, n_regionkey * 1000.0::DOUBLE FROM nation UNION ALL SELECT 'r' || r_regionkey, 0.0::DOUBLE FROM region"


def _scalars(s, d):
    e = read(s, d, "events")
    amount = F.create_map(F.lit("value"), F.col("value"), F.lit("hour"), T.hour(T.epoch("ts")).cast("double"))
    return e.select("event_id", F.when(F.col("event_id") % 7 == 0, F.map_filter(amount, lambda k, v: k != "value")).otherwise(amount).alias("scalars"))


@query("filter_scalar", f"SELECT event_id FROM events WHERE event_id % 7 <> 0 AND value >= 100 AND CAST({EPOCH} % 86400 // 3600 AS INTEGER) < 12")
def _(s, d):
    return _scalars(s, d).where(X.scalar("scalars", "value", "gte", 100) & X.scalar("scalars", "hour", "lt", 12)).select("event_id")


@query("filter_anchor", f"SELECT DISTINCT l_orderkey FROM ({_ANCHORS}) WHERE kind = 'R' AND value = 'F' AND confidence >= 0.95::DOUBLE AND source = '3'")
def _(s, d):
    a = F.struct(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("value"), (1 - F.col("l_discount")).alias("confidence"), (F.col("l_suppkey") % 10).cast("string").alias("source"))
    cx = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(a).alias("anchors"))
    return cx.where(X.anchor("anchors", "R", "F", 0.95, "3")).select("l_orderkey")


@query("filter_metadata", "SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id % 4 = 1 AND n_chars BETWEEN 100 AND 5000 AND doc_id % 3 <> 0 AND contains(source || '/' || doc_id, '/1')")
def _(s, d):
    cx = read(s, d, "documents").select(
        "doc_id", F.col("source").alias("vault"), F.col("lang").alias("modality"), (F.col("doc_id") % 4).alias("panel_version"), F.col("n_chars").alias("created_at"),
        (F.col("doc_id") % 3 == 0).alias("redacted"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("pointer"),
    )
    return cx.where(X.metadata(modality="en", panel_version=1, created=(100, 5000), redacted=False, pointer_contains="/1")).select("doc_id")


@query("filter_attributes", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3 AND c_acctbal >= 0")
def _(s, d):
    c = read(s, d, "customer")
    attrs = F.map_concat(F.create_map(F.lit("segment"), F.col("c_mktsegment")), F.when(F.col("c_acctbal") >= 0, F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"))).otherwise(F.create_map().cast("map<string,string>")))
    return c.select("c_custkey", attrs.alias("attrs")).where(X.attributes("attrs", {"segment": "BUILDING", "nation": "3"})).select("c_custkey")


def _nodes(s, d):
    sup = read(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), F.col("s_acctbal").alias("bal"))
    nat = read(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), (F.col("n_regionkey") * 1000.0).alias("bal"))
    reg = read(s, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.lit(0.0).alias("bal"))
    return sup.unionByName(nat).unionByName(reg)


_POOR, _RICH = "bal < 3000", "bal > 900"


@query(
    "scope_union",
    f"""WITH e AS (SELECT src, dst, weight FROM {_EDGES}), n AS ({_CX_NODES}), a AS (SELECT node FROM n WHERE {_POOR}), b AS (SELECT node FROM n WHERE {_RICH})
    SELECT DISTINCT src, dst, weight FROM e WHERE (src IN (SELECT node FROM a) AND dst IN (SELECT node FROM a)) OR (src IN (SELECT node FROM b) AND dst IN (SELECT node FROM b))""",
)
def _(s, d):
    n, e = _nodes(s, d), _edges(s, d)
    return X.Scope.where(n, e, F.expr(_POOR)).union(X.Scope.where(n, e, F.expr(_RICH))).edges


@query(
    "scope_intersect",
    f"""WITH e AS (SELECT src, dst, weight FROM {_EDGES}), n AS ({_CX_NODES}), c AS (SELECT node FROM n WHERE {_POOR} INTERSECT SELECT node FROM n WHERE {_RICH})
    SELECT src, dst, weight FROM e WHERE src IN (SELECT node FROM c) AND dst IN (SELECT node FROM c)""",
)
def _(s, d):
    n, e = _nodes(s, d), _edges(s, d)
    return X.Scope.where(n, e, F.expr(_POOR)).intersect(X.Scope.where(n, e, F.expr(_RICH)), e).edges


@query("scope_domain", f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_EDGES}), w(node) AS (SELECT 's1' UNION SELECT dst FROM w JOIN e ON node = src) SELECT node FROM w")
def _(s, d):
    return X.Scope.domain(_edges(s, d), ["s1"]).nodes


@query("paged_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1200 ORDER BY o_orderkey LIMIT 250")
def _(s, d):
    return X.page(read(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1200, 250)


@query("provenance_annotate", "SELECT c_custkey AS cx_id, max(o_orderkey) AS ledger_seq, arg_max(sha256(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS entry_hash FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(s, d):
    ledger = read(s, d, "orders").select(F.col("o_custkey").alias("cx_id"), F.col("o_orderkey").alias("seq"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("entry_hash"))
    return X.provenance(read(s, d, "customer").select(F.col("c_custkey").alias("cx_id")), ledger).select("cx_id", "ledger_seq", "entry_hash")


@query(
    "freshness_check",
    """WITH b AS (SELECT user_id, max(event_id) AS base_seq FROM events GROUP BY 1), v AS (SELECT user_id, max(event_id) AS derived_seq FROM events WHERE event_type = 'view' GROUP BY 1)
    SELECT user_id, base_seq, derived_seq, CASE WHEN derived_seq IS NULL THEN 'missing' ELSE 'stale' END AS state FROM b LEFT JOIN v USING (user_id) WHERE derived_seq IS NULL OR derived_seq < base_seq""",
)
def _(s, d):
    e = read(s, d, "events")
    return X.freshness(e, e.where("event_type = 'view'"), "user_id", "event_id")


@query("path_equality", "SELECT l_returnflag AS k, sum(l_linenumber) AS v, 'a' AS side FROM lineitem GROUP BY 1 EXCEPT SELECT l_returnflag, sum(l_linenumber), 'a' FROM lineitem GROUP BY 1")
def _(s, d):
    """The row path and the column path of one aggregate agree: no rows."""
    x = read(s, d, "lineitem")
    row = x.groupBy(F.col("l_returnflag").alias("k")).agg(F.sum("l_linenumber").alias("v"))
    col = x.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_linenumber").alias("p")).groupBy(F.col("l_returnflag").alias("k")).agg(F.sum("p").alias("v"))
    return X.differences(row, col)


@query("graph_import", "SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst, 'unknown target' AS reason FROM supplier WHERE s_nationkey >= 20")
def _(s, d):
    e = read(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"))
    known = e.select(F.col("src").alias("id")).union(read(s, d, "nation").where("n_nationkey < 20").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))))
    return X.import_graph(known, e)[1]


@query("sink_ledger", 'SELECT \'events\' AS "table", CAST(event_id % 3 AS BIGINT) AS batch, count(*) AS rows FROM events GROUP BY 2')
def _(s, d):
    """Three batches, each sent twice: every batch is in the ledger once."""
    cut(s.range(1))  # the folder below is the shared one
    base = f"{s.sparkContext.getCheckpointDir().rstrip('/')}/sink-{uuid.uuid4().hex}"
    e = read(s, d, "events").select("event_id", "user_id", "value")
    for batch in (0, 1, 2, 1, 0, 2):
        X.append_with_ledger(e.where(F.col("event_id") % 3 == batch), f"{base}/table", f"{base}/ledger", "events", batch)
    return s.read.parquet(f"{base}/ledger").select("table", "batch", "rows")


@query("slot_column", "SELECT count(*) AS n, round(sum(list_sum(embedding[17:32]::DOUBLE[])), 6) AS total FROM embeddings")
def _(s, d):
    """One slot written as a column table of its own and read back."""
    cut(s.range(1))
    path = f"{s.sparkContext.getCheckpointDir().rstrip('/')}/slot-{uuid.uuid4().hex}"
    read(s, d, "embeddings").select(F.col("vec_id").alias("cx_id"), F.slice("embedding", 17, 16).alias("slot_1")).write.parquet(path)
    total = F.aggregate(F.transform("slot_1", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return s.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), r6(F.sum(total)).alias("total"))
