"""One declarative query over all models, planned in a fixed order with a cost cap.

Order: relational, key-value, document, time series, graph, vector, aggregate. The
relational and document steps replace the rows, key-value and time series append,
the graph step restricts to reached nodes, the aggregate replaces all by one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import graph, search

# Fixed values of the cost model, in milliseconds.
COSTS = {"scan": 50.0, "scan_rows": 50.0, "kv": 0.1, "ts_rows": 1.0, "hop": 10.0, "lens": 5.0, "doc": 25.0, "doc_rows": 0.5, "agg": 1.0}
CAP_MS = 30_000.0


@dataclass
class UniversalQuery:
    relational: tuple[DataFrame, list[tuple[str, str, object]]] | None = None
    keyvalue: tuple[DataFrame, str, int] | None = None
    document: tuple[DataFrame, str, list[str], str | None] | None = None
    series: tuple[DataFrame, str, int, int] | None = None
    hops: tuple[DataFrame, list[str], int, str] | None = None
    vector: tuple[DataFrame, list[float], int, str, str] | None = None
    aggregate: tuple[str, str] | None = None
    cap_ms: float = CAP_MS
    explain: list[str] = field(default_factory=list)

    def plan(self, rows: int = 0) -> list[tuple[str, float]]:
        """(step, estimated cost) in execution order; over the cap is an error, never a smaller query."""
        steps = []
        if self.relational:
            steps.append(("relational", max(COSTS["scan"], COSTS["scan_rows"] * rows / 1000)))
        if self.keyvalue:
            steps.append(("keyvalue", COSTS["kv"]))
        if self.document:
            steps.append(("document", max(COSTS["doc"], COSTS["doc_rows"] * rows / 1000)))
        if self.series:
            steps.append(("series", COSTS["ts_rows"] * rows / 1000))
        if self.hops:
            steps.append(("graph", COSTS["hop"] * self.hops[2]))
        if self.vector:
            steps.append(("vector", COSTS["lens"]))
        if self.aggregate:
            steps.append(("aggregate", COSTS["agg"]))
        total = sum(c for _, c in steps)
        self.explain = [f"{n}: {c:g} ms" for n, c in steps] + [f"total: {total:g} of {self.cap_ms:g} ms"]
        if total > self.cap_ms:
            raise RuntimeError(f"estimated cost {total:g} ms exceeds the cap {self.cap_ms:g} ms")
        return steps

    def rows(self) -> int:
        """Rows of the largest table that the query scans."""
        tables = [x[0] for x in (self.relational, self.keyvalue, self.document, self.series) if x]
        return max((t.count() for t in tables), default=0)

    def run(self) -> DataFrame:
        self.plan(self.rows())
        rows: DataFrame | None = None
        if self.relational:
            rows = P.where_all(*self.relational)
        if self.keyvalue:
            df, expires_at, now = self.keyvalue
            part = df.where(P.live(now, expires_at))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        if self.document:
            df, col, path, value = self.document
            rows = df.where(P.json_path(col, path, value))
        if self.series:
            df, ts, start, end = self.series
            part = df.where(P.in_window(ts, start, end))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        if self.hops:
            edges, starts, hops, key = self.hops
            reached = graph.bfs(edges, starts, hops, cap=100_000).select(F.col("node").alias(key))
            rows = reached if rows is None else rows.join(reached, key, "left_semi")
        if self.vector:
            df, query, k, id_col, vec_col = self.vector
            pool = df if rows is None else df.join(rows.select(id_col).distinct(), id_col, "left_semi")
            rows = search.knn(pool, query, k, id_col, vec_col)
        if rows is None:
            raise ValueError("an empty query")
        if self.aggregate:
            op, col = self.aggregate
            agg = {"count": F.count(F.lit(1)), "sum": F.coalesce(F.sum(col), F.lit(0.0)), "min": F.min(col), "max": F.max(col), "avg": F.coalesce(F.avg(col), F.lit(0.0))}[op]
            rows = rows.agg(agg.alias("value"))
        return rows
