"""Filters over constellation maps and arrays, scopes of a graph, paged scans, and sinks that leave a ledger row."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .lineage import cut

_COMPARE = {"eq": lambda a, b: a == b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


def scalar(scalars: str, name: str, op: str, value: float) -> Column:
    """A named scalar of a map compares with a finite value; a missing one fails."""
    if not math.isfinite(value):
        raise ValueError("scalar filters need a finite value")
    return F.coalesce(_COMPARE[op](F.try_element_at(F.col(scalars), F.lit(name)), F.lit(float(value))), F.lit(False))


def anchor(anchors: str, kind: str, value: str | None = None, min_confidence: float | None = None, source: str | None = None) -> Column:
    """Some anchor of an array of (kind, value, confidence, source) has the kind and all that is given besides."""

    def fits(a: Column) -> Column:
        tests = [a["kind"] == kind]
        tests += [] if value is None else [a["value"] == value]
        tests += [] if min_confidence is None else [a["confidence"] >= min_confidence]
        tests += [] if source is None else [a["source"] == source]
        return F.coalesce(reduce(lambda x, y: x & y, tests), F.lit(False))

    return F.coalesce(F.exists(anchors, fits), F.lit(False))


def metadata(vault: str | None = None, modality: str | None = None, panel_version: int | None = None, created: tuple[int, int] | None = None, redacted: bool | None = None, pointer_contains: str | None = None) -> Column:
    """All given conditions on columns vault, modality, panel_version, created_at (both ends included), redacted and pointer."""
    tests = [F.col(c) == v for c, v in (("vault", vault), ("modality", modality), ("panel_version", panel_version), ("redacted", redacted)) if v is not None]
    tests += [] if created is None else [F.col("created_at").between(*created)]
    tests += [] if pointer_contains is None else [F.col("pointer").contains(pointer_contains)]
    return reduce(lambda x, y: x & y, tests, F.lit(True))


def attributes(col: str, wanted: dict[str, str]) -> Column:
    """Every wanted key is in the map with exactly that value."""
    return reduce(lambda x, y: x & y, [F.coalesce(F.try_element_at(F.col(col), F.lit(k)) == v, F.lit(False)) for k, v in sorted(wanted.items())], F.lit(True))


@dataclass(frozen=True)
class Scope:
    """A part of a graph: ``nodes`` (node) and ``edges`` (src, dst, ...)."""

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def induced(nodes: DataFrame, edges: DataFrame) -> Scope:
        """The nodes and the edges with both ends among them."""
        n = nodes.select("node").distinct()
        ends = edges.join(n.select(F.col("node").alias("src")), "src", "left_semi").join(n.select(F.col("node").alias("dst")), "dst", "left_semi")
        return Scope(n, ends.select(*edges.columns))

    @staticmethod
    def whole(edges: DataFrame) -> Scope:
        return Scope(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), edges)

    @staticmethod
    def where(nodes: DataFrame, edges: DataFrame, test: Column) -> Scope:
        """Collection, tenant, time window and filter scopes: nodes by a condition on their own columns."""
        return Scope.induced(nodes.where(test), edges)

    @staticmethod
    def domain(edges: DataFrame, anchors: list[str], radius: int | None = None) -> Scope:
        """All that the anchors reach along the edges, themselves included; within ``radius`` hops if given."""
        e = edges.select("src", "dst").distinct()
        seen = front = edges.sparkSession.createDataFrame([(a,) for a in anchors], "node string")
        hop = 0
        while (radius is None or hop < radius) and not front.isEmpty():
            front = cut(front.join(e, front.node == e.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
            seen, hop = seen.unionByName(front), hop + 1
        return Scope.induced(seen, edges)

    def reachable(self, edges: DataFrame, radius: int) -> Scope:
        """What the scope's nodes reach within some hops."""
        seen = self.nodes
        step = edges.select("src", "dst").distinct()
        for _ in range(radius):
            seen = seen.unionByName(seen.join(step, seen.node == step.src).select(F.col("dst").alias("node"))).distinct()
        return Scope.induced(seen, edges)

    def union(self, other: Scope) -> Scope:
        """Both node sets and both edge sets; edges between the two parts are not added."""
        return Scope(self.nodes.unionByName(other.nodes).distinct(), self.edges.unionByName(other.edges).distinct())

    def intersect(self, other: Scope, edges: DataFrame) -> Scope:
        """The common nodes with every edge of the full graph between them."""
        return Scope.induced(self.nodes.intersect(other.nodes), edges)

    def hash(self) -> str:
        """A digest of the sorted node names."""
        return self.nodes.agg(F.sha2(F.array_join(F.array_sort(F.collect_set("node")), "\n"), 256)).first()[0]


def summarise(scope: Scope, anchors: list[str], fraction: float = 0.10) -> DataFrame:
    """The kernel of a scope."""
    return graph.kernel(scope.edges, anchors, fraction)


def page(df: DataFrame, key: str, after: object | None, size: int) -> DataFrame:
    """The next ``size`` rows after a cursor in order of a unique key; the scan is pruned by the cursor."""
    if size <= 0:
        raise ValueError("a page has at least one row")
    return (df if after is None else df.where(F.col(key) > F.lit(after))).orderBy(key).limit(size)


def provenance(hits: DataFrame, ledger: DataFrame, key: str = "cx_id") -> DataFrame:
    """Hits with the last ledger entry of their id, NULL where none names it."""
    last = ledger.groupBy(key).agg(F.max_by("entry_hash", "seq").alias("entry_hash"), F.max("seq").alias("ledger_seq"))
    return hits.join(last, key, "left")


def freshness(base: DataFrame, derived: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, base_seq, derived_seq, state) of keys whose derived rows are missing or older than the base."""
    b = base.groupBy(key).agg(F.max(seq).alias("base_seq"))
    d = derived.groupBy(key).agg(F.max(seq).alias("derived_seq"))
    state = F.when(F.col("derived_seq").isNull(), "missing").when(F.col("derived_seq") < F.col("base_seq"), "stale")
    return b.join(d, key, "left").withColumn("state", state).where("state IS NOT NULL")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with multiplicity, that one of two paths gives and the other does not; empty if the paths agree."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def import_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with both ends known, each once; rejected edges with the reason)."""
    known = nodes.select("id").distinct()
    e = edges.join(known.select(F.col("id").alias("_s")), F.col("src") == F.col("_s"), "left").join(known.select(F.col("id").alias("_d")), F.col("dst") == F.col("_d"), "left")
    reason = F.when(F.col("_s").isNull(), "unknown source").when(F.col("_d").isNull(), "unknown target")
    e = e.withColumn("reason", reason)
    return e.where("reason IS NULL").select(*edges.columns).distinct(), e.where("reason IS NOT NULL").select(*edges.columns, "reason")


def append_with_ledger(df: DataFrame, path: str, ledger: str, table: str, batch: int) -> None:
    """One batch into a table and its row into the ledger; a batch that the ledger has is left out, so a retry adds nothing."""
    spark = df.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path) and not spark.read.parquet(ledger).where((F.col("table") == table) & (F.col("batch") == batch)).isEmpty():
        return
    target = f"{path}/batch={batch}"
    df.write.mode("overwrite").parquet(target)
    entry = spark.read.parquet(target).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))
    entry.select(F.lit(table).alias("table"), F.lit(batch).cast("long").alias("batch"), "rows", "digest").write.mode("append").parquet(ledger)
