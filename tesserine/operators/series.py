"""Dependence of bounded series: Python workers, one group per task, larger samples refused."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .estimators import LIMIT, _one, digamma


def kendall_tau_b(df: DataFrame, x: str, y: str) -> DataFrame:
    """Concordant minus discordant pairs over the pairs that are untied in each column; a constant column is refused."""

    def fn(v: np.ndarray) -> dict:
        s = both = only_x = only_y = 0.0
        for i in range(len(v) - 1):
            dx, dy = np.sign(v[i + 1 :, 0] - v[i, 0]), np.sign(v[i + 1 :, 1] - v[i, 1])
            s, only_x, only_y, both = s + (dx * dy).sum(), only_x + np.abs(dx).sum(), only_y + np.abs(dy).sum(), both + len(dx)
        if only_x == 0 or only_y == 0:
            raise ValueError("constant column")
        return {"tau": float(s / np.sqrt(only_x * only_y)), "n": len(v)}

    return _one(df, [x, y], fn, "tau double, n long", 3)


def _conditional_mi(a: np.ndarray, b: np.ndarray, given: np.ndarray, k: int) -> float:
    """Nearest-neighbour estimate of I(a; b | given) in nats, maximum norm."""
    da, db, dz = (np.abs(c[:, None] - c[None, :]) for c in (a, b, given))
    joint = np.maximum(np.maximum(da, db), dz)
    np.fill_diagonal(joint, np.inf)
    eps = np.partition(joint, k - 1, axis=1)[:, k - 1][:, None]
    inside = lambda d: (d < eps).sum(axis=1) - (eps[:, 0] > 0)
    terms = [digamma(np.maximum(inside(d), 0) + 1.0) for d in (dz, np.maximum(da, dz), np.maximum(db, dz))]
    return float(digamma(np.array([float(k)]))[0] + np.mean(terms[0] - terms[1] - terms[2]))


def transfer_entropy(df: DataFrame, t: str, x: str, y: str, lag: int = 1, k: int = 4) -> DataFrame:
    """Bits that the past of one series tells about the other's next value beyond its own past, both ways; at least 50 steps, 4,000 at most."""

    def fn(v: np.ndarray) -> dict:
        if len(v) > 4000:
            raise ValueError("more than 4000 steps")
        one = lambda p, q: max(_conditional_mi(q[lag:], p[:-lag], q[:-lag], k), 0.0) / np.log(2)
        return {"x_to_y": one(v[:, 1], v[:, 2]), "y_to_x": one(v[:, 2], v[:, 1]), "n": len(v) - lag}

    return _one(df.select(F.col(t).alias("t"), x, y), ["t", x, y], fn, "x_to_y double, y_to_x double, n long", 50 + lag)


def _cross_map(source: np.ndarray, target: np.ndarray, dim: int, tau: int, library: int) -> float:
    """Skill (correlation) of the target's values read off the source's delay embedding by simplex projection."""
    first = (dim - 1) * tau
    points = np.column_stack([source[first - i * tau : len(source) - i * tau] for i in range(dim)])
    value = target[first:]
    d = np.linalg.norm(points[:, None, :] - points[None, :library, :], axis=2)
    d[np.arange(library), np.arange(library)] = np.inf
    near = np.argsort(d, axis=1, kind="stable")[:, : dim + 1]
    dist = np.take_along_axis(d, near, axis=1)
    w = np.exp(-dist / np.maximum(dist[:, :1], 1e-12))
    guess = (w * value[near]).sum(axis=1) / w.sum(axis=1)
    return float(np.corrcoef(guess, value)[0, 1]) if guess.std() > 0 and value.std() > 0 else 0.0


def cross_mapping(df: DataFrame, t: str, x: str, y: str, dim: int = 2, tau: int = 1) -> DataFrame:
    """Convergent cross mapping: skill at the whole library and its gain over a quarter of it. ``x_to_y`` reads y off x's manifold."""

    def fn(v: np.ndarray) -> dict:
        n = len(v) - (dim - 1) * tau
        if n > 4000:
            raise ValueError("more than 4000 points")
        out = {}
        for name, p, q in (("x_to_y", v[:, 1], v[:, 2]), ("y_to_x", v[:, 2], v[:, 1])):
            out[name] = _cross_map(p, q, dim, tau, n)
            out[f"{name}_gain"] = out[name] - _cross_map(p, q, dim, tau, max(n // 4, dim + 2))
        return out

    return _one(df.select(F.col(t).alias("t"), x, y), ["t", x, y], fn, "x_to_y double, x_to_y_gain double, y_to_x double, y_to_x_gain double", 20)


def _pulls(t: np.ndarray, p: np.ndarray, first: np.ndarray, size: np.ndarray, kinds: int, decay: float) -> np.ndarray:
    """Per event and source kind the kernel sum over strictly earlier events of its group; events lie in groups, by time in each.

    All groups take their i-th event in one step: sums fade by the time since the event before, and events of one time wait for the next.
    """
    out = np.zeros((len(t), kinds))
    order = np.argsort(-size, kind="stable")  # the groups that have an i-th event come first
    at, longest = first[order], size[order]
    total, waiting = np.zeros((len(at), kinds)), np.zeros((len(at), kinds))
    for i in range(longest[0]):
        n = np.searchsorted(-longest, -i, side="left")
        now = at[:n] + i
        if i:
            gap = (t[now] - t[now - 1])[:, None]
            total[:n] = np.where(gap > 0, (total[:n] + waiting[:n]) * np.exp(-decay * gap), total[:n])
            waiting[:n] = np.where(gap > 0, 0.0, waiting[:n])
        out[now] = total[:n]
        waiting[np.arange(n), p[now]] += decay
    return out


def _fits(g: np.ndarray, t: np.ndarray, p: np.ndarray, kinds: int, decay: float, rounds: int) -> tuple[np.ndarray, ...]:
    """EM of many groups at once; g: group from 0, sorted with t within it; p: kind. (branching, baseline, seen, span) by group."""
    size = np.bincount(g)
    first = np.cumsum(size) - size
    t = t - t[first][g]
    end = t[first + size - 1]
    at = _pulls(t, p, first, size, kinds, decay)
    slot = g * kinds + p  # the fit of a target kind of a group
    order = np.argsort(slot, kind="stable")
    slot, at = slot[order], at[order]
    starts = np.flatnonzero(np.append(True, np.diff(slot) > 0))
    mine, have = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(slot)))), slot[starts]
    exposure = np.zeros((len(size), kinds))
    np.add.at(exposure, (g, p), 1 - np.exp(-decay * (end[g] - t)))
    span = end[have // kinds]
    with np.errstate(divide="ignore", invalid="ignore"):
        base, branch = np.bincount(mine) / span / 2, np.full((len(starts), kinds), 0.05)
        below = np.maximum(exposure[have // kinds], 1e-12)
        for _ in range(rounds):
            share = at * branch[mine]
            mean = base[mine]
            total = mean + share.sum(axis=1)
            base, branch = np.add.reduceat(mean / total, starts) / span, np.add.reduceat(share / total[:, None], starts) / below
    full, fixed, seen = np.zeros((len(size), kinds, kinds)), np.zeros((len(size), kinds)), np.zeros((len(size), kinds), bool)
    full[have // kinds, have % kinds], fixed[have // kinds, have % kinds], seen[have // kinds, have % kinds] = branch, base, True
    return full, fixed, seen, end


def hawkes(df: DataFrame, t: str, process: str, decay: float, rounds: int = 50, by: str | None = None) -> DataFrame:
    """(target, source, branching, baseline) of mutually exciting processes with kernel decay * exp(-decay * age), by EM.

    Only strictly earlier events excite; time starts at the first event and ends at the last. With ``by`` one fit per
    group, under its column; there a group in which no time passes has null values instead of an error.
    Groups come sorted, and all whole groups of a batch are fitted at once.
    """
    group = "_g" if by is None else by

    def fit(rows: pa.Table) -> list[pa.RecordBatch]:
        times = rows.column("t").to_numpy()
        starts = np.flatnonzero(rows.column("_new").to_numpy())
        size = np.diff(np.append(starts, len(times)))
        if rows.column("t").null_count or rows.column("p").null_count or not np.isfinite(times).all() or size.max() > LIMIT:
            raise ValueError("too many or non-finite events")
        code = rows.column("p").combine_chunks().dictionary_encode()
        names = np.array(code.dictionary.to_pylist(), object)
        rank = np.argsort(names)
        turn = np.empty(len(names), int)
        turn[rank] = np.arange(len(names))
        branch, base, seen, end = _fits(np.repeat(np.arange(len(starts)), size), times, turn[code.indices.to_numpy()], len(names), decay, rounds)
        if by is None and not (end > 0).all():
            raise ValueError("no time passes")
        who, a, b = np.nonzero(seen[:, :, None] & seen[:, None, :])
        still, kinds = ~(end > 0)[who], pa.array(names[rank], pa.string())
        values = [pa.array(x, pa.float64(), mask=still) for x in (branch[who, a, b], base[who, a])]
        table = pa.table([rows.column("_g").take(pa.array(starts[who])), kinds.take(pa.array(a)), kinds.take(pa.array(b)), *values], names=[group, "target", "source", "branching", "baseline"])
        return (table if by is not None else table.drop_columns([group])).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the group that may go on in the next batch
        for b in batches:
            starts = np.flatnonzero(b.column(3).to_numpy(zero_copy_only=False))
            if len(starts):
                if held or starts[-1]:
                    yield from fit(pa.Table.from_batches([*held, b.slice(0, starts[-1])]))
                held, b = [], b.slice(starts[-1])
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) > LIMIT:
                raise ValueError("too many or non-finite events")
        if held:
            yield from fit(pa.Table.from_batches(held))

    rows = df.select((F.lit(1) if by is None else F.col(by)).alias("_g"), F.col(t).cast("double").alias("t"), F.col(process).cast("string").alias("p"))
    before = F.row_number().over(Window.partitionBy("_g").orderBy("t", "p"))
    rows = rows.withColumn("_new", before == 1)
    kind = rows.schema["_g"].dataType.simpleString()
    fits = "target string, source string, branching double, baseline double"
    return rows.mapInArrow(run, fits if by is None else f"{by} {kind}, {fits}")


def _equal_frequency(v: np.ndarray, bins: int) -> np.ndarray:
    """Bin per value; equal values stay together."""
    order = np.sort(v)
    return np.minimum(np.searchsorted(order, v, side="left") * bins // len(v), bins - 1)


def _best_grids(x: np.ndarray, y: np.ndarray, budget: float) -> dict[tuple[int, int], float]:
    """Largest information of x cut freely against equal-frequency bins of y, normalised, per grid size."""
    order = np.argsort(x, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(x[order])) + 1, len(x))
    found: dict[tuple[int, int], float] = {}
    for rows in range(2, int(budget // 2) + 1):
        q = _equal_frequency(y, rows)[order]
        seen = np.vstack([np.zeros(rows), np.cumsum(np.eye(rows)[q], axis=0)[ends - 1]])
        cell = seen[None, :, :] - seen[:, None, :]
        size = np.maximum(cell.sum(axis=2), 1e-300)
        with np.errstate(divide="ignore", invalid="ignore"):
            cost = -np.where(cell > 0, cell * np.log2(cell / size[:, :, None]), 0).sum(axis=2)
        cost[np.tril_indices(len(cost))] = np.inf
        p = seen[-1] / len(x)
        h = -(p[p > 0] * np.log2(p[p > 0])).sum()
        best = cost[0]
        for cols in range(2, int(budget // rows) + 1):
            best = (best[:, None] + cost).min(axis=0)
            if np.isfinite(best[-1]):
                found[cols, rows] = (h - best[-1] / len(x)) / np.log2(min(cols, rows))
    return found


def mic(df: DataFrame, x: str, y: str, alpha: float = 0.6) -> DataFrame:
    """Maximal information coefficient over grids of at most max(n^alpha, 4) cells; 4 to 1,000 rows, no constant column."""

    def fn(v: np.ndarray) -> dict:
        if len(v) > 1000 or (np.ptp(v, axis=0) == 0).any():
            raise ValueError("more than 1000 rows or a constant column")
        budget = max(len(v) ** alpha, 4.0)
        scores = list(_best_grids(v[:, 0], v[:, 1], budget).values()) + list(_best_grids(v[:, 1], v[:, 0], budget).values())
        return {"mic": float(min(max(scores, default=0.0), 1.0)), "n": len(v)}

    return _one(df, [x, y], fn, "mic double, n long", 4)


def bootstrap_mean(df: DataFrame, x: str, resamples: int = 200, seed: int = 0) -> DataFrame:
    """Mean with the 2.5 and 97.5 percentiles of resampled means."""

    def fn(v: np.ndarray) -> dict:
        draws = np.random.default_rng(seed).integers(0, len(v), (resamples, len(v)))
        low, high = np.percentile(v[draws, 0].mean(axis=1), [2.5, 97.5])
        return {"mean": float(v.mean()), "low": float(low), "high": float(high)}

    return _one(df, [x], fn, "mean double, low double, high double", 2)
