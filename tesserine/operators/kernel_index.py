"""A search index under the kernel of a graph: kernel nodes, their regions, and the rows of a region.

Every row lies in the region of the kernel node nearest to it, its home, and in those of the
next nearest ones (``copies`` in all). The table is partitioned by region (the kernel node's
rank), so that a search reads the regions of the kernel nodes nearest to the query, and new or
changed rows rewrite only the regions they leave or enter. ``sampled_kernel`` fits a kernel
of bounded size, so that regions do not grow in number with the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, graph
from .lineage import cut
from .search import knn_many, top_k

#: Kernel nodes that each lane of rows holds at most.
NODES_PER_LANE = 8192


def sampled_kernel(vectors: DataFrame, anchors: list[str], fraction: float = 0.25, most: int = 512, degree: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``graph.kernel`` of the graph of exact nearest neighbours between ``most`` different vectors at most.

    These are the anchors and the ones with the smallest hashes of their ids among 8 times as many rows, so that copies of one vector do not fill the sample.
    """
    key = [(~F.col("id").cast("string").isin(anchors)).alias("other"), F.xxhash64("id").alias("hash"), F.col("id")]
    some = blocks.unit_rows(vectors, id_col, vec_col).orderBy(*key).limit(8 * most)
    sample = cut(some.groupBy("cell", "v").agg(F.min(F.struct(*key)).alias("key")).orderBy("key").limit(most).select("cell", F.col("key.id").alias("id"), "v"))
    near = blocks.top(sample, sample, degree + 1, blocks.dots, 1).where("query_id <> cx_id")
    near = top_k(near, degree, ["query_id"]).select(F.col("query_id").alias("id"), "cx_id", "score")
    edges = sample.select("id").join(near, "id", "left")  # a single row is its own neighbour
    edges = edges.select(F.col("id").cast("string").alias("src"), F.coalesce("cx_id", "id").cast("string").alias("dst"), F.coalesce("score", F.lit(1.0)).alias("weight"))
    return graph.kernel(cut(edges), anchors, fraction)


class KernelIndex:
    """``kernel``: (node, rank) of ``graph.kernel``, whose nodes are ids of ``vectors``."""

    def __init__(self, vectors: DataFrame, kernel: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding", copies: int = 1):
        self.path, self.id_col, self.vec_col, self.copies = path, id_col, vec_col, copies
        spark = vectors.sparkSession
        self.lanes = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        nodes = kernel.select(F.col("node").cast("long").alias("id"), F.col("rank").cast("long").alias("rank"))
        rows = blocks.unit_rows(vectors, id_col, vec_col)
        # The kernel's vectors under the number of their region.
        self.kernel = cut(rows.join(F.broadcast(nodes), "id").select(F.lit(0).alias("cell"), F.col("rank").alias("id"), "v", F.col("id").alias("node")))
        self.node_lanes = 1 + self.kernel.count() // NODES_PER_LANE
        # A region with very many rows, such as copies of one, is dealt over several tasks.
        self._assigned(rows).hint("rebalance", F.col("region")).write.partitionBy("region").parquet(path)
        self.table = spark.read.parquet(path)

    def _assigned(self, rows: DataFrame) -> DataFrame:
        """(id, v, home, region): each row in the regions of its ``copies`` nearest kernel nodes. The kernel goes to every lane of rows, a row to one."""
        near = blocks.top(self.kernel.select("cell", "id", "v"), rows, self.copies, blocks.dots, self.node_lanes, query_lanes=self.lanes)
        near = top_k(near, self.copies, ["query_id"]).select(F.col("query_id").alias("id"), (F.col("rank") == 1).alias("home"), F.col("cx_id").cast("int").alias("region"))
        return rows.select("id", "v").join(near, "id")

    def regions(self) -> DataFrame:
        """(region, node, n): the kernel node of each region and the number of rows that are at home there."""
        n = self.table.where("home").groupBy("region").agg(F.count(F.lit(1)).alias("n"))
        return self.kernel.select(F.col("id").cast("int").alias("region"), "node").join(n, "region", "left").select("region", "node", F.coalesce("n", F.lit(0)).alias("n"))

    def route(self, queries: DataFrame, regions: int) -> DataFrame:
        """(query_id, region): the regions of the kernel nodes nearest to a query."""
        near = blocks.top(self.kernel.select("cell", "id", "v"), blocks.unit_rows(queries, self.id_col, self.vec_col), regions, blocks.dots, self.node_lanes, query_lanes=self.lanes)
        return top_k(near, regions, ["query_id"]).select("query_id", F.col("cx_id").cast("int").alias("region"), F.col("rank").alias("turn"))

    def search_many(self, queries: DataFrame, k: int, regions: int = 8) -> DataFrame:
        """(query_id, cx_id, score): kernel, regions, rows; each hop of all queries is one join of blocks."""
        to = self.route(queries, regions).select(F.col("query_id").alias("id"), F.col("region").alias("cell"))
        asked = blocks.unit_rows(queries, self.id_col, self.vec_col).select("id", "v").join(to, "id").select("cell", "id", "v").repartition("cell")
        hits = blocks.top(self.table.select(F.col("region").alias("cell"), "id", "v"), asked, k, blocks.dots, 4)
        hits = hits.groupBy("query_id", "cx_id").agg(F.max("score").alias("score"))  # copies
        return top_k(hits, k, ["query_id"]).drop("rank")

    def search(self, query: list[float], k: int, regions: int = 8) -> DataFrame:
        """(cx_id, score) for one query, from the folders of its regions only."""
        q = np.asarray(query, float)
        q = (q / np.linalg.norm(q)).tolist()
        asked = self.kernel.sparkSession.createDataFrame([(0, q)], f"{self.id_col} long, {self.vec_col} array<double>")
        near = [r["region"] for r in self.route(asked, regions).collect()]
        rows = self.table.where(F.col("region").isin(near)).select(F.lit(0).alias("cell"), "id", "v").dropDuplicates(["id"])
        hits = blocks.top(rows, blocks.unit_rows(asked, self.id_col, self.vec_col), k, blocks.dots, self.lanes)
        return top_k(hits, k, ["query_id"]).select("cx_id", "score")

    def answer(self, queries: DataFrame, ground: DataFrame, k: int = 10, regions: int = 8) -> DataFrame:
        """(query_id, cx_id, score, node, hop): the best rows with the kernel node nearest to them and their hops to an anchor (``ground``: node, hop), null beyond reach."""
        hits = self.search_many(queries, k, regions)
        at = self.table.where("home").select(F.col("id").alias("cx_id"), "region").join(self.kernel.select(F.col("id").cast("int").alias("region"), "node"), "region")
        known = ground.select(F.col("node").cast("long").alias("cx_id"), "hop")
        return hits.join(at, "cx_id").join(known, "cx_id", "left").select("query_id", "cx_id", "score", "node", "hop")

    def refresh(self, changed: DataFrame, removed: DataFrame | None = None) -> list[int]:
        """Takes in new and changed rows and drops ``removed`` ids; only the regions that they leave or enter are written again. Returns these."""
        rows = cut(self._assigned(blocks.unit_rows(changed, self.id_col, self.vec_col)))
        ids = rows.select("id") if removed is None else rows.select("id").unionByName(removed.select(F.col(self.id_col).cast("long").alias("id")))
        left = self.table.join(ids, "id", "left_semi").select("region")
        touched = sorted(r["region"] for r in left.unionByName(rows.select("region")).distinct().collect())  # at most the kernel's size
        old = self.table.where(F.col("region").isin(touched)).join(ids, "id", "left_anti")
        new = cut(old.select(*rows.columns).unionByName(rows))
        new.repartition("region").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("region").parquet(self.path)
        # A region that lost its last row has nothing to write: its rows are written as none.
        empty = set(touched) - {r["region"] for r in new.select("region").distinct().collect()}
        spark = self.kernel.sparkSession
        for region in empty:
            gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/region={region}")
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
        spark.catalog.refreshByPath(self.path)
        self.table = spark.read.parquet(self.path)
        return touched

    def recall(self, vectors: DataFrame, queries: DataFrame, k: int = 10, regions: int = 8) -> DataFrame:
        """(query_id, ratio): the share of the exact k nearest that the index finds."""
        hit = self.search_many(queries, k, regions).select("query_id", "cx_id", F.lit(1).alias("hit"))
        full = knn_many(vectors, queries, k, self.id_col, self.vec_col)
        return full.join(hit, ["query_id", "cx_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("ratio"))
