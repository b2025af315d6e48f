"""Approximate search over vectors: product codes, cells with boundary copies, and a neighbour graph.

Codes decide which rows are looked at, exact cosines over the fetched vectors decide the
result. Codebooks and centroids are fitted on the ``MAX_FIT`` rows with the smallest
hash of their id; every row is coded, placed and linked. Cells and edges hold codes
(one byte for each part of a vector), never vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import blocks
from .lineage import cut
from .search import top_k

MAX_FIT = 20_000
#: Scored pairs that a task of the neighbour graph holds before it hands them on.
MOST_HELD = 100_000


def lloyd(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k means of a bounded sample; fewer where it has fewer distinct rows."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        a = nearest(x, c, 1)[:, 0]
        total = np.zeros_like(c)
        np.add.at(total, a, x)
        n = np.bincount(a, minlength=len(c))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0))


def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    d = distances(x, c)
    return d.argmin(axis=1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n]


def _matrix(cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells)).reshape(len(cells), -1)


def _sample(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.xxhash64("id"), "id").limit(n)


@dataclass(frozen=True)
class ProductCodes:
    """One codebook for each part of a vector; a vector's code is a byte for each part."""

    books: np.ndarray  # parts x entries x width

    @classmethod
    def fit(cls, rows: DataFrame, parts: int = 16, entries: int = 256, max_fit: int = MAX_FIT) -> ProductCodes:
        """Parts are fitted apart from each other, one task each."""

        def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column(0).to_pylist()).reshape(b.num_rows, parts, -1)
                for p in range(parts):
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(x), pa.int32()), pa.array([v.tobytes() for v in x[:, p]], pa.binary())], names=["part", "v"])

        def book(part: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            c = lloyd(_matrix(pdf["v"].tolist()), entries)
            return pd.DataFrame({"part": [part[0]], "book": [np.resize(c, (entries, c.shape[1])).tobytes()]})

        found = _sample(rows, max_fit).select("v").mapInArrow(cuts, "part int, v binary").groupBy("part").applyInPandas(book, "part int, book binary").collect()
        return cls(np.stack([np.frombuffer(r["book"]).reshape(entries, -1) for r in sorted(found, key=lambda r: r["part"])]))

    def codes(self, x: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        cut_up = x.reshape(len(x), parts, width)
        return np.stack([nearest(cut_up[:, p], self.books[p], 1)[:, 0] for p in range(parts)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x parts x entries: what each entry adds to the dot product."""
        parts, _, width = self.books.shape
        return np.einsum("npw,pew->npe", q.reshape(len(q), parts, width), self.books)

    def scores(self, q: bytes, codes: bytes, n: int, m: int) -> np.ndarray:
        t, c = self.tables(np.frombuffer(q).reshape(n, -1)), np.frombuffer(codes, np.uint8).reshape(m, -1)
        return sum(t[:, p, c[:, p]] for p in range(c.shape[1]))

    def encode(self, rows: DataFrame) -> DataFrame:
        """(cell, id, v) -> (cell, id, v) with codes for vectors."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    c = self.codes(_matrix(b.column(2).to_pylist()))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in c], pa.binary())], names=["cell", "id", "v"])

        return rows.mapInArrow(run, "cell int, id long, v binary")

    def score(self, code: Column, query: list[float]) -> Column:
        """Look-up score of a code against one unit query, as an expression."""
        table = self.tables(np.asarray(query, float)[None])[0]
        digits = F.hex(code)
        out = F.lit(0.0)
        for p, row in enumerate(table):
            entries = F.split(F.lit(",".join(map(repr, row.tolist()))), ",").cast("array<double>")
            out = out + F.element_at(entries, F.conv(F.substring(digits, 2 * p + 1, 2), 16, 10).cast("int") + 1)
        return out


def exact(hits: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str) -> DataFrame:
    """(query_id, cx_id, score): the best k of some (query_id, cx_id) by the cosine of their vectors."""
    v = vectors.select(F.col(id_col).cast("long").alias("cx_id"), F.col(vec_col).alias("row_v"))
    q = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).alias("query_v"))
    met = hits.select("query_id", "cx_id").join(v, "cx_id").join(q, "query_id")
    scored = met.select("query_id", "cx_id", V.cosine(F.col("query_v"), F.col("row_v")).alias("score")).where("score IS NOT NULL")
    return top_k(scored, k, ["query_id"]).drop("rank")


class CellTable:
    """Codes in cells around two-level centroids; a row lies in every cell that is nearly as close as its nearest one.

    The table at ``path`` is partitioned by cell, so that a search reads the folders it probes.
    """

    def __init__(self, vectors: DataFrame, path: str, cells: int = 64, ratio: float = 1.15, copies: int = 12, codes: ProductCodes | None = None, id_col: str = "vec_id", vec_col: str = "embedding", max_fit: int = MAX_FIT):
        self.vectors, self.path, self.id_col, self.vec_col = vectors, path, id_col, vec_col
        rows = blocks.unit_rows(vectors, id_col, vec_col)
        self.codes = codes or ProductCodes.fit(rows, max_fit=max_fit)
        self.centers = self._centers(rows, cells, max_fit)
        centers, coder = self.centers, self.codes

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = _matrix(b.column(2).to_pylist())
                d = distances(x, centers)
                near = np.argsort(d, axis=1, kind="stable")[:, :copies]
                far = np.take_along_axis(d, near, 1)
                row, turn = np.nonzero(far <= far[:, :1] * ratio)
                c = [v.tobytes() for v in coder.codes(x)]
                yield pa.RecordBatch.from_arrays([pa.array(near[row, turn].astype(np.int32)), b.column(1).take(pa.array(row)), pa.array([c[i] for i in row], pa.binary()), pa.array(turn == 0)], names=["cell", "id", "v", "home"])

        placed = rows.mapInArrow(place, "cell int, id long, v binary, home boolean")
        placed.repartition("cell").write.partitionBy("cell").parquet(path)
        self.table = vectors.sparkSession.read.parquet(path)

    @staticmethod
    def _centers(rows: DataFrame, cells: int, max_fit: int) -> np.ndarray:
        """First about sqrt(cells) means, then each of them cut into means in proportion to its rows, so that cells are alike in size."""
        sample = cut(_sample(rows, max_fit).select("v"))
        first = max(1, int(np.sqrt(cells)))
        fit = lambda k: lambda pdf: pd.DataFrame({"v": [c.tobytes() for c in lloyd(_matrix(pdf["v"].tolist()), k)]})
        tops = _matrix([r["v"] for r in sample.withColumn("top", F.lit(0)).groupBy("top").applyInPandas(fit(first), "v binary").collect()])

        def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pdf.assign(top=nearest(_matrix(pdf["v"].tolist()), tops, 1)[:, 0].astype(np.int32))

        split = sample.mapInPandas(home, "v binary, top int")
        size = {r["top"]: r["count"] for r in split.groupBy("top").count().collect()}
        whole = sum(size.values())
        share = {t: max(1, round(cells * n / whole)) for t, n in size.items()}
        while sum(share.values()) > cells:
            share[max(share, key=lambda t: (share[t], t))] -= 1
        leaves = split.groupBy("top").applyInPandas(lambda key, pdf: fit(share[int(key[0])])(pdf), "v binary").collect()
        return _matrix(sorted(bytes(r["v"]) for r in leaves))

    def probes(self, query: list[float], n: int) -> list[int]:
        q = np.asarray(query, float)
        return nearest((q / np.linalg.norm(q))[None], self.centers, n)[0].tolist()

    def candidates(self, query: list[float], probes: int, rerank: int) -> DataFrame:
        """(cx_id, score) by codes alone, read from the probed folders."""
        q = np.asarray(query, float) / np.linalg.norm(query)
        found = self.table.where(F.col("cell").isin(self.probes(query, probes))).groupBy(F.col("id").alias("cx_id")).agg(F.first("v").alias("v"))
        return found.select("cx_id", self.codes.score(F.col("v"), q.tolist()).alias("score")).orderBy(F.col("score").desc(), "cx_id").limit(rerank)

    def search(self, query: list[float], k: int, probes: int = 4, rerank: int = 100) -> DataFrame:
        """(cx_id, score): codes of the probed cells choose ``rerank`` rows, whose vectors decide."""
        near = self.candidates(query, probes, rerank).select("cx_id").join(self.vectors.select(F.col(self.id_col).cast("long").alias("cx_id"), F.col(self.vec_col).alias("v")), "cx_id")
        return near.select("cx_id", V.cosine(F.col("v"), V.literal(query)).alias("score")).orderBy(F.col("score").desc(), "cx_id").limit(k)

    def search_many(self, queries: DataFrame, k: int, probes: int = 4, rerank: int = 100) -> DataFrame:
        """(query_id, cx_id, score) for every row of ``queries``, each in its own nearest cells."""
        centers = self.centers

        def reads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    near = nearest(_matrix(b.column(2).to_pylist()), centers, probes)
                    row = np.repeat(np.arange(len(near)), near.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(near.reshape(-1).astype(np.int32)), b.column(1).take(pa.array(row)), b.column(2).take(pa.array(row))], names=["cell", "id", "v"])

        wanted = blocks.unit_rows(queries, self.id_col, self.vec_col).mapInArrow(reads, "cell int, id long, v binary").repartition("cell")
        hits = blocks.top(self.table.select("cell", "id", "v"), wanted, rerank, self.codes.scores, lanes=4)
        hits = hits.groupBy("query_id", "cx_id").agg(F.max("score").alias("score"))
        return exact(top_k(hits, rerank, ["query_id"]), self.vectors, queries, k, self.id_col, self.vec_col)


class NeighbourGraph:
    """A pruned neighbour graph as a table of edges (node, nbr, code of nbr), built by rounds of joins of neighbours with neighbours.

    A round takes for every node its ``sample`` best new and old neighbours in both directions,
    fetches their vectors once, and scores them with each other; what beats the worst
    neighbour kept by either end goes on. Rounds end when fewer than ``delta`` of the
    neighbours change. Rounds move vectors of half precision; the neighbours that they end with
    are scored by exact cosines. Edges are then thinned (a neighbour goes that is closer to a kept
    one than ``slack`` times to the node) and taken in both directions.
    """

    def __init__(self, vectors: DataFrame, degree: int = 24, sample: int = 12, rounds: int = 8, delta: float = 0.01, slack: float = 1.3, codes: ProductCodes | None = None, id_col: str = "vec_id", vec_col: str = "embedding", max_fit: int = MAX_FIT):
        self.vectors, self.id_col, self.vec_col = vectors, id_col, vec_col
        rows = cut(blocks.unit_rows(vectors, id_col, vec_col).dropDuplicates(["id"]))
        self.rows, self.degree, self.sample = rows, degree, sample
        self._codes, self.max_fit, self.slack = codes, max_fit, slack
        self.count = rows.count()
        self.rounds = 0
        self.half = cut(self._halved(rows))
        near = self._first()
        for _ in range(rounds):
            near = self._round(near)
            self.rounds += 1
            if near.where("fresh").count() < delta * self.count * degree:
                break
        self.near = self._exact(near)

    @cached_property
    def codes(self) -> ProductCodes:
        """Only walks need codes and edges."""
        return self._codes or ProductCodes.fit(self.rows, max_fit=self.max_fit)

    @cached_property
    def edges(self) -> DataFrame:
        return self._edges(self.slack)

    @staticmethod
    def _halved(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column(1).to_pylist()).astype(np.float16)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "v"])

        return rows.select("id", "v").mapInArrow(run, "id long, v binary")

    def _exact(self, near: DataFrame) -> DataFrame:
        """The neighbours with their cosines in double precision; the vectors of a node's neighbours come once."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, bool)]]
                for node, own, g in zip(*(b.column(i) for i in range(3)), strict=True):
                    g = g.as_py()
                    nbr, s = np.array([x["nbr"] for x in g]), _matrix([x["v"] for x in g]) @ np.frombuffer(own.as_py())
                    for o, x in zip(out, (np.full(len(nbr), node.as_py()), nbr, s, np.array([x["fresh"] for x in g])), strict=True):
                        o.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["node", "nbr", "score", "fresh"])

        v = self.rows.select(F.col("id").alias("nbr"), "v")
        groups = near.join(v, "nbr").groupBy("node").agg(F.collect_list(F.struct("nbr", "v", "fresh")).alias("g"))
        groups = groups.join(self.rows.select(F.col("id").alias("node"), F.col("v").alias("own")), "node").select("node", "own", "g")
        return cut(groups.mapInArrow(run, "node long, nbr long, score double, fresh boolean"))

    def _best(self, pairs: DataFrame) -> DataFrame:
        """(node, nbr, score, fresh) -> the ``degree`` best per node, a pair known before counting as old."""
        one = pairs.repartition("node").groupBy("node", "nbr").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
        place = Window.partitionBy("node").orderBy(F.col("score").desc(), "nbr")  # dealt by node already
        return one.withColumn("place", F.row_number().over(place)).where(F.col("place") <= self.degree).drop("place")

    def _met(self, groups: DataFrame) -> DataFrame:
        """(a list of (id, v, fresh, bar)) -> scored pairs of its members that are new and above either one's bar."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[list] = [[], [], []]
                held = 0
                for g in b.column(0):  # one group at a time
                    g = g.as_py()
                    ids = np.array([x["id"] for x in g])
                    v = np.frombuffer(b"".join(x["v"] for x in g), np.float16).reshape(len(g), -1).astype(np.float64)
                    s, fresh, bar = v @ v.T, np.array([x["fresh"] for x in g]), np.array([x["bar"] for x in g])
                    i, j = np.nonzero((fresh[:, None] | fresh[None]) & (s > bar[:, None]) & (ids[:, None] != ids[None]))
                    out[0].append(ids[i]), out[1].append(ids[j]), out[2].append(s[i, j])
                    held += len(i)
                    if held >= MOST_HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["node", "nbr", "score"])
                        out, held = [[], [], []], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["node", "nbr", "score"])

        return groups.mapInArrow(run, "node long, nbr long, score double").withColumn("fresh", F.lit(True))

    def _first(self) -> DataFrame:
        """Neighbours within two deals of the rows into random groups of about three times the degree."""
        groups = max(1, self.count // (3 * self.degree))
        deals = self.half.select("id", "v", F.explode(F.array(F.lit(1), F.lit(2))).alias("deal"))
        member = F.struct("id", "v", F.lit(True).alias("fresh"), F.lit(-2.0).alias("bar"))
        dealt = deals.groupBy("deal", F.pmod(F.xxhash64("id", "deal"), F.lit(groups)).alias("grp")).agg(F.collect_list(member).alias("g"))
        return cut(self._best(self._met(dealt.select("g"))))

    def _round(self, near: DataFrame) -> DataFrame:
        bars = near.groupBy("node").agg(F.when(F.count(F.lit(1)) < self.degree, F.lit(-2.0)).otherwise(F.min("score")).alias("bar"))
        both = near.select("node", "nbr", "score", "fresh").unionByName(near.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "score", "fresh"))
        both = both.repartition("node").groupBy("node", "nbr").agg(F.max("score").alias("score"), F.max("fresh").alias("fresh"))
        place = Window.partitionBy("node", "fresh").orderBy(F.col("score").desc(), "nbr")
        some = both.withColumn("place", F.row_number().over(place)).where(F.col("place") <= self.sample)
        told = self.half.select(F.col("id").alias("nbr"), "v").join(bars.withColumnRenamed("node", "nbr"), "nbr", "left")
        member = F.struct(F.col("nbr").alias("id"), "v", "fresh", F.coalesce("bar", F.lit(-2.0)).alias("bar"))
        groups = some.join(told, "nbr").groupBy("node").agg(F.collect_list(member).alias("g"))
        used = some.where("fresh").select("node", "nbr", F.lit(False).alias("was"))
        old = near.join(used, ["node", "nbr"], "left").select("node", "nbr", "score", F.coalesce("was", "fresh").alias("fresh"))
        return cut(self._best(old.unionByName(self._met(groups.select("g")))))

    def _edges(self, slack: float) -> DataFrame:
        def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                node, nbr = [], []
                for i, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    g = sorted(g, key=lambda x: (-x["score"], x["nbr"]))
                    v = _matrix([x["v"] for x in g])
                    s, keep = v @ v.T, []
                    for k, x in enumerate(g):
                        if all(s[k, m] < x["score"] * slack for m in keep):
                            keep.append(k)
                    node += [i] * len(keep)
                    nbr += [g[k]["nbr"] for k in keep]
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(nbr, pa.int64())], names=["node", "nbr"])

        vectors = self.rows.select(F.col("id").alias("nbr"), "v")
        kept = self.near.join(vectors, "nbr").groupBy("node").agg(F.collect_list(F.struct("nbr", "score", "v")).alias("g")).mapInArrow(thin, "node long, nbr long")
        both = kept.unionByName(kept.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"))).distinct()
        codes = self.codes.encode(self.rows).select(F.col("id").alias("nbr"), F.col("v").alias("code"))
        return cut(both.join(codes, "nbr").select("node", "nbr", "code"))

    def _hop(self, asked: DataFrame, keep: int, beam: int, width: int) -> DataFrame:
        """(query_id, q, beam state, found (node, code) in parts) -> the ``keep`` best nodes met so far, what is open to open next."""
        coder = self.codes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[list] = [[], [], [], []]
                for q, node, score, done, nbrs, codes in zip(*(b.column(c).to_pylist() for c in ("q", "node", "score", "done", "nbrs", "codes")), strict=True):
                    node, score, done = np.frombuffer(node, "<i8"), np.frombuffer(score), np.frombuffer(done, bool)
                    new, first = np.unique(np.frombuffer(b"".join(nbrs or ()), "<i8"), return_index=True)
                    fresh = ~np.isin(new, node)
                    new, first = new[fresh], first[fresh]
                    if len(new):
                        code = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, len(coder.books))[first]
                        x = np.concatenate([coder.books[p, code[:, p]] for p in range(code.shape[1])], axis=1)
                        node, score, done = np.append(node, new), np.append(score, x @ np.frombuffer(q)), np.append(done, np.zeros(len(new), bool))
                    best = np.lexsort((node, -score))[:keep]
                    node, score, done = node[best], score[best], done[best].copy()
                    front = np.flatnonzero(~done[:beam])[:width]
                    done[front] = True
                    for o, x in zip(out, (node.astype("<i8").tobytes(), score.tobytes(), done.tobytes(), node[front].tolist()), strict=True):
                        o.append(x)
                kinds = (pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, out, kinds)], names=["query_id", "q", "node", "score", "done", "front"])

        return asked.select("query_id", "q", "node", "score", "done", "nbrs", "codes").mapInArrow(run, "query_id long, q binary, node binary, score binary, done binary, front array<long>")

    def walk(self, queries: DataFrame, beam: int = 60, width: int = 12, entries: int = 16, max_hops: int | None = None, keep: int | None = None) -> DataFrame:
        """(query_id, node, score): the ``keep`` (by default ``beam``) best nodes that a beam search meets; one hop of all queries is one join with the edges.

        A hop opens the ``width`` best of the ``beam`` best nodes that are not open yet; a query ends when its beam is open, which
        every query comes to, since a node opens once. More than ``max_hops`` hops, where given, are an error.
        A query is one row with its best nodes: one that has fallen behind them can never come back, so that no others are held.
        """
        keep = max(beam, keep or 0)
        q = blocks.unit_rows(queries, self.id_col, self.vec_col).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
        pack = lambda rows, by: rows.groupBy(*by).agg(F.collect_list(F.struct("nbr", "code")).alias("e"))
        start = self._packed(pack(self.codes.encode(_sample(self.rows, entries)).select(F.lit(0).cast("long").alias("node"), F.col("id").alias("nbr"), F.col("v").alias("code")), ["node"]))
        empty = F.lit(b"").alias
        lists = [F.collect_list("nbrs").alias("nbrs"), F.collect_list("codes").alias("codes")]
        begun = q.crossJoin(F.broadcast(start.agg(*lists))).select("query_id", "q", empty("node"), empty("score"), empty("done"), "nbrs", "codes")
        state = cut(self._hop(begun, keep, beam, width))
        edges = cut(self._packed(pack(self.edges, ["node"])))
        for _ in count() if max_hops is None else range(max_hops):
            front = state.select("query_id", F.explode("front").alias("node"))
            if front.isEmpty():
                return self._best_nodes(state)
            met = front.join(edges, "node").groupBy("query_id").agg(*lists)
            state = cut(self._hop(state.join(met, "query_id", "left"), keep, beam, width))
        raise ValueError(f"some queries still have open nodes after {max_hops} hops")

    @staticmethod
    def _packed(groups: DataFrame) -> DataFrame:
        """(node, list of (nbr, code)) -> (node, nbrs, codes) end to end."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                e = b.column(1).to_pylist()
                nbrs = [np.array([x["nbr"] for x in g], "<i8").tobytes() for g in e]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nbrs, pa.binary()), pa.array([b"".join(x["code"] for x in g) for g in e], pa.binary())], names=["node", "nbrs", "codes"])

        return groups.select("node", "e").mapInArrow(run, "node long, nbrs binary, codes binary")

    @staticmethod
    def _best_nodes(state: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                node = [np.frombuffer(x, "<i8") for x in b.column(1).to_pylist()]
                if node:
                    query = np.repeat(b.column(0).to_numpy(), [len(x) for x in node])
                    score = np.frombuffer(b"".join(b.column(2).to_pylist()))
                    yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate(node)), pa.array(score)], names=["query_id", "node", "score"])

        return state.select("query_id", "node", "score").mapInArrow(run, "query_id long, node long, score double")

    def search_many(self, queries: DataFrame, k: int, beam: int = 60, width: int = 12, rerank: int | None = None) -> DataFrame:
        """(query_id, cx_id, score): the ``rerank`` best nodes of the walk by codes (the beam by default), decided by their vectors."""
        met = self.walk(queries, beam, width, keep=rerank).withColumnRenamed("node", "cx_id")
        return exact(top_k(met, rerank or beam, ["query_id"]), self.vectors, queries, k, self.id_col, self.vec_col)
