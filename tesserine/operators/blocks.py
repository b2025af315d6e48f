"""Top rows for many queries in one pass: packed blocks of rows meet packed blocks of queries in groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: (queries as bytes, rows as bytes, number of queries, number of rows) -> a matrix of scores.
Score = Callable[[bytes, bytes, int, int], np.ndarray]
#: The same and places (i, j) of the matrix -> their scores, each from its own two vectors alone.
Settle = Callable[[bytes, bytes, int, int, np.ndarray, np.ndarray], np.ndarray]
QUERIES_PER_BLOCK, ROWS_PER_BLOCK = 256, 2048
#: How far a score of a matrix product may lie from the settled one, with room to spare.
MARGIN = 1e-9
#: Lanes of rows at most: each holds a copy of the queries of its cell.
MOST_LANES = 32


def _packed(df: DataFrame, size: int) -> DataFrame:
    """(cell, id, v) -> (cell, ids, vs): up to ``size`` rows of one cell in one, their ids and payloads of equal length end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, ids, v = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            order = np.argsort(cell, kind="stable")
            out: list[list] = [[], [], []]
            for at in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                for a in range(0, len(at), size):
                    some = at[a : a + size]
                    out[0].append(int(cell[some[0]])), out[1].append(ids[some].astype("<i8").tobytes()), out[2].append(b"".join(v[i] for i in some))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["cell", "ids", "vs"])

    return df.select(F.col("cell").cast("int"), F.col("id").cast("long"), "v").mapInArrow(run, "cell int, ids binary, vs binary")


def _each(n: int):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def top(rows: DataFrame, queries: DataFrame, k: int, score: Score, lanes: int, query_lanes: int = 1, settled: Settle | None = None) -> DataFrame:
    """(query_id, cx_id, score): for each query and lane of rows of its cell, the best k (score descending, id ascending).

    ``rows`` and ``queries`` are (cell, id, v). Blocks of rows are dealt over ``lanes``, blocks of queries over ``query_lanes``,
    and every lane meets every other in a group of its own, which holds these two lanes and each block once.
    ``settled`` scores what comes within ``MARGIN`` of the best k once more, so that equal rows have equal scores wherever they lie in a block.
    """
    lanes = min(lanes, MOST_LANES)
    deal = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n).cast("long"))
    r = _packed(rows, ROWS_PER_BLOCK).select(F.col("cell").alias("cell"), deal(lanes).alias("lane"), _each(query_lanes).alias("turn"), F.col("ids").alias("r_ids"), F.col("vs").alias("r_vs"))
    q = _packed(queries, QUERIES_PER_BLOCK).select(F.col("cell").alias("cell"), _each(lanes).alias("lane"), deal(query_lanes).alias("turn"), F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        for q_ids, q_vs in zip(right.column("q_ids"), right.column("q_vs"), strict=True):
            q_id, q_v = np.frombuffer(q_ids.as_py(), "<i8"), q_vs.as_py()
            at, ids, got, bar = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(len(q_id), -np.inf)
            for r_ids, r_vs in zip(left.column("r_ids"), left.column("r_vs"), strict=True):
                r_id = np.frombuffer(r_ids.as_py(), "<i8")
                r_v = r_vs.as_py()
                s = score(q_v, r_v, len(q_id), len(r_id)).astype(np.float64, copy=False)
                # Later blocks meet the bar of those before.
                if len(r_id) > k and np.isneginf(bar).any():
                    bar = np.maximum(bar, np.partition(s, -k, axis=1)[:, -k])
                near = bar if settled is None else bar - MARGIN
                i, j = np.divmod(np.flatnonzero(s >= near[:, None]), len(r_id))
                hit = s[i, j] if settled is None else settled(q_v, r_v, len(q_id), len(r_id), i, j)
                at, ids, got = np.append(at, i), np.append(ids, r_id[j]), np.append(got, hit)
                order = np.lexsort((ids, -got, at))
                at, ids, got = at[order], ids[order], got[order]
                place = np.arange(len(at)) - np.searchsorted(at, at)
                at, ids, got, last = at[place < k], ids[place < k], got[place < k], place == k - 1
                bar[at[np.flatnonzero(last[place < k])]] = got[np.flatnonzero(last[place < k])]
            out[0].append(q_id[at]), out[1].append(ids), out[2].append(got)
        return pa.table({n: np.concatenate(x) for n, x in zip(("query_id", "cx_id", "score"), out, strict=True)})

    by = ["cell", "lane", "turn"]
    return r.groupBy(*by).cogroup(q.groupBy(*by)).applyInArrow(run, "query_id long, cx_id long, score double")


def unit_rows(df: DataFrame, id_col: str, vec_col: str, cell: str | None = None) -> DataFrame:
    """(cell, id, v): unit vectors as bytes; null, zero and non-finite vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [np.asarray(x, float) for x in b.column(2).to_pylist()]
            n = np.array([np.sqrt(x @ x) for x in v])
            good = (n > 0) & np.isfinite(n)
            yield pa.RecordBatch.from_arrays([*(b.column(i).filter(pa.array(good)) for i in range(2)), pa.array([(x / m).tobytes() for x, m, g in zip(v, n, good, strict=True) if g], pa.binary())], names=["cell", "id", "v"])

    rows = df.select((F.lit(0) if cell is None else F.col(cell)).cast("int").alias("cell"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).mapInArrow(run, "cell int, id long, v binary")


def dots(q: bytes, r: bytes, n: int, m: int) -> np.ndarray:
    return np.frombuffer(q).reshape(n, -1) @ np.frombuffer(r).reshape(m, -1).T


def settled_dots(q: bytes, r: bytes, n: int, m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A matrix product may add up equal columns in different orders; here equal vectors have equal scores."""
    q, r = np.frombuffer(q).reshape(n, -1), np.frombuffer(r).reshape(m, -1)
    cuts = range(0, len(i), 1 << 15)
    return np.concatenate([np.zeros(0), *((q[i[a : a + (1 << 15)]] * r[j[a : a + (1 << 15)]]).sum(axis=1) for a in cuts)])


def pairs(rows: DataFrame, worst: Callable[[np.ndarray, np.ndarray], np.ndarray], lanes: int = 8) -> DataFrame:
    """(a, b, score): pairs a < b of rows (cell, id, v) in one cell or in cells next to each other whose ``worst`` is not negative.

    Blocks are written once, so that both sides of a meeting hold the same ones; they are dealt over ``lanes``, and
    every two lanes meet in a group of their own, so that a cell that holds all rows is as many tasks.
    """
    packed = cut(_packed(rows.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(lanes))), ROWS_PER_BLOCK))
    lane = F.pmod(F.xxhash64("ids"), F.lit(lanes).cast("long"))
    p = packed.select(F.col("cell").alias("cell"), lane.alias("one"), _each(lanes).alias("two"), F.col("ids").alias("p_ids"), F.col("vs").alias("p_vs"))
    both = F.explode(F.array(F.col("cell"), F.col("cell") - 1)).alias("cell")
    q = packed.select(both, F.col("cell").alias("home"), lane.alias("two"), F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs")).select("cell", "home", _each(lanes).alias("one"), "two", "q_ids", "q_vs")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        for q_cell, q_ids, q_vs in zip(*(right.column(c).to_pylist() for c in ("home", "q_ids", "q_vs")), strict=True):
            for p_cell, p_ids, p_vs in zip(*(left.column(c).to_pylist() for c in ("cell", "p_ids", "p_vs")), strict=True):
                if q_cell == p_cell and p_ids > q_ids:
                    continue  # they meet the other way round
                p_id, q_id = np.frombuffer(p_ids, "<i8"), np.frombuffer(q_ids, "<i8")
                s = worst(np.frombuffer(p_vs).reshape(len(p_id), -1), np.frombuffer(q_vs).reshape(len(q_id), -1))
                # A block that meets itself holds each pair twice.
                hit = (s >= 0) & ((p_id[:, None] < q_id[None]) if p_ids == q_ids else (p_id[:, None] != q_id[None]))
                i, j = np.nonzero(hit)
                out[0].append(np.minimum(p_id[i], q_id[j])), out[1].append(np.maximum(p_id[i], q_id[j])), out[2].append(s[i, j])
        return pa.table({n: np.concatenate(x) for n, x in zip(("a", "b", "score"), out, strict=True)})

    by = ["cell", "one", "two"]
    return p.groupBy(*by).cogroup(q.groupBy(*by)).applyInArrow(run, "a long, b long, score double")
