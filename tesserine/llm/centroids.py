"""k-means on integer vectors with Elkan's bounds.

A table of the shared folder holds, per vector, its integer components, its cluster, an
upper bound of the distance to its centroid and one lower bound per centroid. A round is
one pass over that table: bounds are widened by how far the centroids moved, a centroid
is skipped where its lower bound, or half its distance to the vector's centroid, lies
strictly above the upper bound, and what is left is decided by exact integer distances.
Bounds are single precision and rounded outwards (upper ones up, lower ones down), so
that neither rounding nor a tie can lose a nearest centroid. The pass writes its
clusters' sums in rows of their own, merged by cluster; k centroids reach the driver.
A table is removed when its successor is written, so two exist at most.

Cases: vectors that are null, of another length, or hold null or non-finite components
are left out; zero vectors are kept; a null id counts as the empty string in the choice
of seeds; equal ids or hashes are ordered by their components; repeated rows count as
often as they occur; fewer vectors than k give as many clusters; an empty cluster keeps
its centroid; an empty table gives an empty result; components beyond 2**27 in size are
computed with integers of any length, and what exceeds a long is given as the largest
long; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, record_batch, remove, table_path

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, "2"
#: Components up to this size keep squared distances of 64 components below 2**63.
EXACT_LONG = 1 << 27
MAX_LONG = (1 << 63) - 1
#: Relative room for the rounding of a root, of a sum of two bounds and of single precision.
SLACK = 1e-6
STATE = "vec_id long, vec binary, cluster int, upper float, lower binary, part int, n long, sums binary"
_KINDS = [pa.int64(), pa.binary(), pa.int32(), pa.float32(), pa.binary(), pa.int32(), pa.int64(), pa.binary()]
OUTPUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
RESULT = "vec_id long, cluster int, distance long, part int, n long, sums binary"
_RESULT_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]


def usable(vec: Column, dims: int = DIMS) -> Column:
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vec) == dims) & whole, F.lit(False))


def to_integers(flat: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x), as Python integers where int64 might overflow."""
    raw = flat.astype(np.float64).reshape(-1, dims)
    if raw.size and np.abs(raw).max() > EXACT_LONG / scale - 1:
        return np.array([[math.floor(v * scale) if abs(v) < 1e300 else int(v) * scale for v in r] for r in raw.tolist()], object).reshape(-1, dims)
    return np.floor(raw * scale).astype(np.int64)


def pack(rows: np.ndarray) -> list[bytes]:
    """A tag and two bytes a component where they fit, else decimal text."""
    if rows.dtype != object and (not rows.size or -32768 <= rows.min() and rows.max() <= 32767):
        return [b"\0" + r.tobytes() for r in rows.astype("<i2")]
    return [b"\1" + ",".join(map(str, r)).encode() for r in rows.tolist()]


def unpack(cells: list[bytes], dims: int) -> np.ndarray:
    if all(c[0] == 0 for c in cells):
        flat = np.frombuffer(b"".join(cells), np.uint8).reshape(-1, 2 * dims + 1)[:, 1:]
        return np.ascontiguousarray(flat).view("<i2").astype(np.int64)
    rows = [[int(v) for v in c[1:].split(b",")] if c[0] else np.frombuffer(c, "<i2", offset=1).tolist() for c in cells]
    big = max((abs(v) for r in rows for v in r), default=0)
    return np.array(rows, np.int64 if big <= EXACT_LONG else object)


def squared(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    return ((rows - centroid) ** 2).sum(axis=1)


def root(d: np.ndarray) -> np.ndarray:
    """Square roots as doubles; integers of any length."""
    if d.dtype == object:
        return np.array([math.sqrt(v) if v < 1 << 1000 else min(float(math.isqrt(v)) if v < 1 << 2000 else math.inf, math.inf) for v in d.tolist()], np.float64)
    return np.sqrt(d.astype(np.float64))


def rounded_up(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (x * (1 + SLACK)).astype(np.float32)


def rounded_down(x: np.ndarray) -> np.ndarray:
    """A bound that single precision cannot hold becomes its largest number."""
    return np.minimum(np.fmax(x, 0) * (1 - SLACK), float(np.finfo(np.float32).max)).astype(np.float32)


class Centroids:
    """The k centroids of a round: integers, half distances between them, and how far each has moved."""

    def __init__(self, points: list[list[int]], before: list[list[int]] | None = None) -> None:
        big = max((abs(v) for p in points for v in p), default=0)
        self.points = np.array(points, np.int64 if big <= EXACT_LONG else object)
        self.half = np.array([root(squared(self.points, c)) for c in self.points]) * (0.5 * (1 - SLACK))
        old = self.points if before is None else np.array(before, object)
        self.moved = root(((self.points.astype(object) - old) ** 2).sum(axis=1)) * (1 + SLACK)


def assign(rows: np.ndarray, c: Centroids, a: np.ndarray | None = None, upper: np.ndarray | None = None, lower: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each row (ties: the smaller number), its upper bound and all lower bounds.

    Without bounds every distance is taken. With them, centroid j is skipped where it is
    strictly farther than the row's own by its lower bound or by the triangle inequality.
    """
    n, k = len(rows), len(c.points)
    if a is None:
        every = np.stack([squared(rows, p) for p in c.points], axis=1)
        a = every.argmin(axis=1) if every.dtype != object else np.array([min(range(k), key=r.__getitem__) for r in every.tolist()], np.int64)
        far = np.stack([root(every[:, j]) for j in range(k)], axis=1)
        return a, rounded_up(far[np.arange(n), a]), rounded_down(far)
    with np.errstate(invalid="ignore"):
        upper = rounded_up(upper.astype(np.float64) + c.moved[a])
        lower = rounded_down(lower.astype(np.float64) - c.moved)
    me = np.arange(k)

    def open_to(i: np.ndarray) -> np.ndarray:
        """Centroids that the bounds leave open, for some rows."""
        return ~((lower[i] > upper[i, None]) | (c.half[a[i]] > upper[i, None])) & (me != a[i, None])

    todo = np.flatnonzero(open_to(np.arange(n)).any(axis=1))
    if not len(todo):
        return a, upper, lower
    best = np.zeros(n, rows.dtype if rows.dtype == c.points.dtype else object)
    for j in np.unique(a[todo]):
        i = todo[a[todo] == j]
        best[i] = squared(rows[i], c.points[j])
        upper[i], lower[i, j] = rounded_up(root(best[i])), rounded_down(root(best[i]))
    left = open_to(todo)
    for j in range(k):
        i = todo[left[:, j]]
        if len(i):
            d = squared(rows[i], c.points[j])
            lower[i, j] = rounded_down(root(d))
            nearer = (d < best[i]) | ((d == best[i]) & (j < a[i]))
            i, d = i[nearer], d[nearer]
            best[i], a[i] = d, j
    upper[todo] = rounded_up(root(best[todo]))
    return a, upper, lower


class Sums:
    """Sums of one task: per cluster the rows, their components and their squared distances."""

    def __init__(self, k: int, dims: int) -> None:
        self.n, self.total = [0] * k, [[0] * (dims + 1) for _ in range(k)]

    def add(self, rows: np.ndarray, a: np.ndarray, d: np.ndarray | None) -> None:
        for j in np.unique(a).tolist():
            i = a == j
            self.n[j] += int(i.sum())
            extra = 0 if d is None else sum(d[i].tolist())
            self.total[j] = [x + int(y) for x, y in zip(self.total[j], [*rows[i].sum(axis=0).tolist(), extra], strict=True)]

    def rows(self) -> tuple[list, list, list]:
        used = [j for j, n in enumerate(self.n) if n]
        return used, [self.n[j] for j in used], [",".join(map(str, self.total[j])).encode() for j in used]


def _merged(table: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Cluster -> rows and sums; tasks' sums meet by cluster, at most k rows reach the driver."""

    def run(t: pa.Table) -> pa.Table:
        cells = [list(map(int, x.split(b","))) for x in t.column("sums").to_pylist()]
        text = ",".join(str(sum(x)) for x in zip(*cells)).encode()
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "sums": pa.array([text], pa.binary())})

    found = table.where("part IS NOT NULL").select("part", "n", "sums").groupBy("part").applyInArrow(run, "part int, n long, sums binary").collect()
    return {r["part"]: (r["n"], [int(x) for x in bytes(r["sums"]).split(b",")]) for r in found}


def _floats(column: pa.Array) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False) if isinstance(column, pa.ChunkedArray) else column.flatten().to_numpy(zero_copy_only=False)


def cluster(rows: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector that is kept."""
    if k < 1 or rounds < 1:
        raise ValueError("k and rounds start at 1")
    spark = rows.sparkSession
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where(usable(F.col("vec"), dims))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = kept.orderBy(mark, "vec").limit(k).collect()
    if not seeds:
        return spark.createDataFrame([], OUTPUT)
    points = [to_integers(np.array(r["vec"]), dims, scale)[0].tolist() for r in seeds]

    def start(it: Iterator[pa.RecordBatch], c: Centroids) -> Iterator[pa.RecordBatch]:
        sums = Sums(k, dims)
        for b in it:
            v = to_integers(_floats(b.column(1)), dims, scale)
            if len(v):
                a, up, low = assign(v, c)
                sums.add(v, a, None)
                yield _state(b.column(0), v, a, up, low)
        yield _sums(sums)

    def again(it: Iterator[pa.RecordBatch], c: Centroids, last: bool) -> Iterator[pa.RecordBatch]:
        sums = Sums(k, dims)
        for b in it:
            if not b.num_rows:
                continue
            v = unpack(b.column(1).to_pylist(), dims)
            low = np.frombuffer(b"".join(b.column(4).to_pylist()), "<f4").reshape(len(v), -1).copy()
            a, up, low = assign(v, c, b.column(2).to_numpy(zero_copy_only=False).astype(np.int64), b.column(3).to_numpy(zero_copy_only=False).copy(), low)
            d = None
            if last:
                d = np.zeros(len(v), object)
                for j in np.unique(a):
                    d[a == j] = squared(v[a == j], c.points[j]).astype(object)
            sums.add(v, a, d)
            if last:
                n = len(v)
                yield record_batch([f.split()[0] for f in RESULT.split(", ")], [b.column(0), a, [min(x, MAX_LONG) for x in d.tolist()], *[[None] * n] * 3], _RESULT_KINDS)
            else:
                yield _state(b.column(0), v, a, up, low)
        if last:
            j, n, s = sums.rows()
            yield record_batch([f.split()[0] for f in RESULT.split(", ")], [*[[None] * len(j)] * 3, j, n, s], _RESULT_KINDS)
        else:
            yield _sums(sums)

    centroids, path, table = Centroids(points), None, kept
    for turn in range(rounds + 1):
        last = turn == rounds
        if turn == 0:
            made = table.mapInArrow(lambda it, c=centroids: start(it, c), STATE)
        else:
            made = table.mapInArrow(lambda it, c=centroids, z=last: again(it, c, z), RESULT if last else STATE)
        if last:
            made = cut_lineage(made)
        else:
            new = table_path(spark, "centroids")
            made.write.parquet(new)
            made = spark.read.schema(STATE).parquet(new)
        if path:
            remove(spark, path)
        found = _merged(made)
        if not last:
            path, table, old = new, made.where("part IS NULL"), points
            points = [[x // found[j][0] for x in found[j][1][:dims]] if j in found else p for j, p in enumerate(points)]
            centroids = Centroids(points, old)
    whole = sum(s[dims] for _, s in found.values())
    facts = [(j, min(s[dims], MAX_LONG), min(whole, MAX_LONG), hashlib.sha256(",".join(map(str, points[j])).encode()).hexdigest()) for j, (_, s) in found.items()]
    per = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return made.where("part IS NULL").select("vec_id", "cluster", "distance").join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _state(ids: pa.Array, v: np.ndarray, a: np.ndarray, up: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    empty = [None] * len(v)
    return record_batch([f.split()[0] for f in STATE.split(", ")], [ids, pack(v), a, up, [r.tobytes() for r in low.astype("<f4")], empty, empty, empty], _KINDS)


def _sums(sums: Sums) -> pa.RecordBatch:
    j, n, s = sums.rows()
    empty = [None] * len(j)
    return record_batch([f.split()[0] for f in STATE.split(", ")], [empty, empty, empty, empty, empty, j, n, s], _KINDS)
