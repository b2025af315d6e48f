"""Estimators over one bounded sample: Python workers, one group per task.

Each takes a DataFrame with the named numeric columns and returns one row. Samples
above ``limit`` rows are refused, not truncated.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 20_000


def _one(df: DataFrame, cols: list[str], fn: Callable[[np.ndarray], dict], schema: str, least: int) -> DataFrame:
    """One bounded sample in one task; it is counted before any row of it moves."""
    if not least <= (rows := df.count()) <= LIMIT:
        raise ValueError(f"needs {least} to {LIMIT} rows, got {rows}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[cols].to_numpy(float)
        v = v[np.lexsort(v.T[::-1])] if "t" not in cols else v[np.argsort(v[:, cols.index("t")], kind="stable")]
        if len(v) < least or len(v) > LIMIT:
            raise ValueError(f"needs {least} to {LIMIT} rows, got {len(v)}")
        if not np.isfinite(v).all():
            raise ValueError("non-finite input")
        return pd.DataFrame([fn(v)])

    return df.select(F.lit(1).alias("_g"), *[F.col(c).cast("double").alias(c) for c in cols]).groupBy("_g").applyInPandas(run, schema)


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (x < 6).any():
        low = x < 6
        out[low] -= 1 / x[low]
        x[low] += 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i / 252))


def ksg_mi(df: DataFrame, x: str, y: str, k: int = 3) -> DataFrame:
    """Kraskov-Stoegbauer-Grassberger mutual information in bits; at least 50 rows."""

    def fn(v: np.ndarray) -> dict:
        dx, dy = (np.abs(c[:, None] - c[None, :]) for c in v.T)
        d = np.maximum(dx, dy)
        np.fill_diagonal(d, np.inf)
        eps = np.partition(d, k - 1, axis=1)[:, k - 1]
        nx, ny = ((m < eps[:, None]).sum(axis=1) - 1 for m in (dx, dy))
        mi = digamma(np.array([k]))[0] + digamma(np.array([len(v)]))[0] - np.mean(digamma(np.maximum(nx, 0) + 1) + digamma(np.maximum(ny, 0) + 1))
        return {"mi_bits": max(mi, 0) / np.log(2), "n": len(v)}

    return _one(df, [x, y], fn, "mi_bits double, n long", 50)


def _centred(c: np.ndarray) -> np.ndarray:
    d = np.abs(c[:, None] - c[None, :])
    return d - d.mean(axis=0) - d.mean(axis=1)[:, None] + d.mean()


def distance_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    def fn(v: np.ndarray) -> dict:
        a, b = _centred(v[:, 0]), _centred(v[:, 1])
        den = np.sqrt((a * a).mean() * (b * b).mean())
        return {"dcor": float(np.sqrt(max((a * b).mean(), 0) / den)) if den > 0 else 0.0, "n": len(v)}

    return _one(df, [x, y], fn, "dcor double, n long", 4)


def hsic(df: DataFrame, x: str, y: str) -> DataFrame:
    """Biased HSIC with Gaussian kernels at the median distance."""

    def fn(v: np.ndarray) -> dict:
        ks = []
        for c in v.T:
            d = (c[:, None] - c[None, :]) ** 2
            ks.append(np.exp(-d / max(np.median(d[d > 0]) if (d > 0).any() else 1.0, 1e-12)))
        n = len(v)
        h = ks[0] - ks[0].mean(axis=0) - ks[0].mean(axis=1)[:, None] + ks[0].mean()
        return {"hsic": float((h * ks[1]).sum() / (n - 1) ** 2), "n": n}

    return _one(df, [x, y], fn, "hsic double, n long", 4)


def granger(df: DataFrame, t: str, x: str, y: str, lag: int = 2) -> DataFrame:
    """F statistic for x helping to predict y beyond y's own lags."""

    def fn(v: np.ndarray) -> dict:
        xs, ys = v[:, 1], v[:, 2]
        n = len(ys) - lag
        own = np.column_stack([np.ones(n), *(ys[lag - i : len(ys) - i] for i in range(1, lag + 1))])
        both = np.column_stack([own, *(xs[lag - i : len(xs) - i] for i in range(1, lag + 1))])
        rss = [float(((ys[lag:] - m @ np.linalg.lstsq(m, ys[lag:], rcond=None)[0]) ** 2).sum()) for m in (own, both)]
        dof = n - both.shape[1]
        return {"f": ((rss[0] - rss[1]) / lag) / (rss[1] / dof) if rss[1] > 0 else 0.0, "dof": dof}

    return _one(df.select(F.col(t).alias("t"), x, y), ["t", x, y], fn, "f double, dof long", 3 * lag + 5)


def lomb_scargle(df: DataFrame, t: str, y: str, periods: list[float]) -> DataFrame:
    """Period with the largest floating-mean power: the share of variance that a sine and cosine of that period explain,
    from three correlations per period in one aggregate over any number of rows; ties go to the longer period."""
    rows = df.select(F.col(t).cast("double").alias("t"), F.col(y).cast("double").alias("y"))
    parts = []
    for i, p in enumerate(periods):
        c, s = F.cos(2 * np.pi * F.col("t") / p), F.sin(2 * np.pi * F.col("t") / p)
        parts += [F.corr("y", c).alias(f"yc{i}"), F.corr("y", s).alias(f"ys{i}"), F.corr(c, s).alias(f"cs{i}")]
    a = rows.agg(F.count(F.lit(1)).alias("n"), *parts)
    power = lambda i: (F.col(f"yc{i}") ** 2 + F.col(f"ys{i}") ** 2 - 2 * F.col(f"yc{i}") * F.col(f"ys{i}") * F.col(f"cs{i}")) / (1 - F.col(f"cs{i}") ** 2)
    best = F.greatest(*[F.struct(F.coalesce(power(i), F.lit(0.0)).alias("power"), F.lit(float(p)).alias("period")) for i, p in enumerate(periods)])
    enough = F.when(F.col("n") >= 5, best).otherwise(F.raise_error(F.lit("needs 5 rows")).cast("struct<power:double,period:double>"))
    return a.select(enough.alias("b")).select("b.power", "b.period")


def mmd(df: DataFrame, x: str, group: str) -> DataFrame:
    """Squared maximum mean discrepancy of x between group 0 and group 1."""

    def fn(v: np.ndarray) -> dict:
        a, b = v[v[:, 1] == 0, 0], v[v[:, 1] != 0, 0]
        d = (v[:, 0][:, None] - v[:, 0][None, :]) ** 2
        s = max(float(np.median(d[d > 0])) if (d > 0).any() else 1.0, 1e-12)
        k = lambda p, q: float(np.exp(-((p[:, None] - q[None, :]) ** 2) / s).mean())
        return {"mmd2": k(a, a) + k(b, b) - 2 * k(a, b), "n": len(v)}

    return _one(df, [x, group], fn, "mmd2 double, n long", 4)
