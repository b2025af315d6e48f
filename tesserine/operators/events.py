"""Occurrence series beyond cadence: hazards, change points, periodic recall, roll-up limits, triggers, traces; and the windowed, boosted and gated order of hits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import temporal as T
from . import recurrence as R

# Fixed values of the change-point and hazard tests.
CUSUM_SLACK, CUSUM_THRESHOLD, CUSUM_SIGMA_SHARE, CUSUM_GAPS = 0.5, 5.0, 1e-3, 4
HAZARD_GAPS, OVERDUE_ALPHA, STEADY_CV = 3, 0.05, 1e-6
FULL_SUPPORT = 12
MAX_OCCURRENCES, MAX_AGE = 10_000, 365 * 86_400


def cusum(occ: DataFrame, slack: float = CUSUM_SLACK, threshold: float = CUSUM_THRESHOLD) -> DataFrame:
    """(key, t) -> (key, n_gaps, max_up, max_down, change_gap, shift) for series of at least four gaps.

    The first half of the gaps (two at least) is the base; both one-sided sums restart at
    zero, which is the running sum less its smallest value so far, so two windows suffice.
    """
    by = Window.partitionBy("key").orderBy("t", "gap")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("key")
    g = R.gaps(occ).where("gap IS NOT NULL").withColumns({"i": F.row_number().over(by), "n": F.count(F.lit(1)).over(whole)}).where(F.col("n") >= CUSUM_GAPS)
    base = F.when(F.col("i") <= F.greatest(F.floor(F.col("n") / 2), F.lit(2)), F.col("gap").cast("double"))
    g = g.withColumns({"mu": F.avg(base).over(whole), "sd": F.stddev_pop(base).over(whole)})
    z = (F.col("gap") - F.col("mu")) / F.greatest("sd", CUSUM_SIGMA_SHARE * F.col("mu"))
    g = g.withColumns({"up": F.sum(z - slack).over(upto), "down": F.sum(-z - slack).over(upto)})
    g = g.withColumns({c: F.col(c) - F.least(F.min(c).over(upto), F.lit(0.0)) for c in ("up", "down")})
    hit = F.struct("i", F.when(F.col("up") > threshold, "slow_down").otherwise("speed_up").alias("shift"))
    first = F.min(F.when((F.col("up") > threshold) | (F.col("down") > threshold), hit))
    out = g.groupBy("key").agg(F.max("n").alias("n_gaps"), F.max("up").alias("max_up"), F.max("down").alias("max_down"), first.alias("f"))
    return out.select("key", "n_gaps", "max_up", "max_down", F.col("f.i").alias("change_gap"), F.col("f.shift").alias("shift"))


def upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function, by its series below a + 1 and its continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    scale = np.exp(np.where(x > 0, -x + a * np.log(np.maximum(x, 1e-300)) - np.array([math.lgamma(v) for v in a.ravel()]).reshape(a.shape), -np.inf))
    term = total = 1 / a
    for n in range(1, 500):
        term = term * x / (a + n)
        total = total + term
    b = x + 1 - a
    c, d = np.full(a.shape, 1e300), 1 / np.where(np.abs(b) < 1e-300, 1e-300, b)
    h = d
    for n in range(1, 500):
        an, b = -n * (n - a), b + 2
        d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
        c = b + an / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * d * c
    return np.clip(np.where(x < a + 1, 1 - scale * total, scale * h), 0, 1)


def hazard(occ: DataFrame, now: int, alpha: float = OVERDUE_ALPHA) -> DataFrame:
    """(key, t) -> gamma renewal of the gaps for series of at least three: moments, shape, scale, survival of the elapsed
    time, its empirical share, the hazard, and whether the next occurrence is overdue. A steady series has a step instead."""
    last = occ.groupBy("key").agg(F.max("t").alias("last_t")).where(F.col("last_t") <= now)
    g = R.gaps(occ).where("gap IS NOT NULL").join(last, "key").withColumn("elapsed", F.lit(now) - F.col("last_t"))
    m = g.groupBy("key", "last_t", "elapsed").agg(
        F.count(F.lit(1)).alias("n_gaps"), F.avg("gap").alias("mean_gap"), F.var_pop("gap").alias("gap_variance"), F.avg((F.col("gap") >= F.col("elapsed")).cast("double")).alias("empirical_survival")
    ).where((F.col("n_gaps") >= HAZARD_GAPS) & (F.col("mean_gap") > 0))
    m = m.withColumns({"cv": F.sqrt("gap_variance") / F.col("mean_gap"), "shape": F.try_divide(F.col("mean_gap") * F.col("mean_gap"), F.col("gap_variance")), "scale": F.col("gap_variance") / F.col("mean_gap"), "expected_next": F.col("last_t") + F.col("mean_gap")})

    @F.pandas_udf("survival double, hazard double")
    def model(mean: pd.Series, cv: pd.Series, shape: pd.Series, scale: pd.Series, elapsed: pd.Series) -> pd.DataFrame:
        steady = (cv <= STEADY_CV).to_numpy()
        k, s, e = np.where(steady, 1, shape), np.where(steady, 1, scale), elapsed.to_numpy(float)
        tail = upper_gamma(k, e / s)
        log_density = (k - 1) * np.log(np.maximum(e, 1e-300)) - e / s - k * np.log(s) - np.array([math.lgamma(v) for v in k])
        rate = np.exp(log_density) / np.maximum(tail, np.finfo(float).tiny)
        before = e < mean.to_numpy()
        return pd.DataFrame({"survival": np.where(steady, before.astype(float), tail), "hazard": np.where(steady, np.where(before, 0.0, np.finfo(float).max), rate)})

    out = m.withColumn("x", model("mean_gap", "cv", "shape", "scale", "elapsed"))
    return out.select("key", "n_gaps", "mean_gap", "gap_variance", "cv", "shape", "scale", "elapsed", "empirical_survival", "expected_next", "x.survival", "x.hazard", (F.col("x.survival") <= alpha).alias("overdue"))


def predicted(occ: DataFrame, ceiling: float = 1.0) -> DataFrame:
    """Next occurrence of series of three or more with its confidence (regularity x support x best mode share) and interval."""
    def share(cell: Column, name: str) -> DataFrame:
        c = occ.groupBy("key", cell.alias("_m")).agg(F.count(F.lit(1)).alias("_c"))
        return c.groupBy("key").agg((F.max("_c") / F.sum("_c")).alias(name))

    h, w = T.hour(F.col("t")), T.weekday(F.col("t"))
    out = R.next_occurrence(occ).join(R.cadence(occ).select("key", "cadence", "last_t"), "key").where("cadence > 0")
    for cell, name in ((h, "_h"), (w, "_w"), (h * 7 + w, "_hw")):
        out = out.join(share(cell, name), "key")
    regular = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("mad") / F.col("cadence")))
    confidence = F.least(regular * F.least(F.col("n") / FULL_SUPPORT, F.lit(1.0)) * F.greatest("_h", "_w", "_hw"), F.lit(ceiling))
    out = out.withColumn("confidence", confidence)
    half = F.round(F.greatest(F.col("mad"), F.col("cadence") * (1 - F.col("confidence")))).cast("long")
    return out.select("key", "next_t", "confidence", (F.col("next_t") - half).alias("low_t"), (F.col("next_t") + half).alias("high_t"))


def periodic_recall(occ: DataFrame, hour: int | None = None, day: int | None = None, support: int = 2) -> DataFrame:
    """(key, n, hits): series of enough occurrences whose only most frequent hour (and weekday) is the wanted one."""
    if hour is None and day is None:
        raise ValueError("a target hour or weekday")
    out = occ.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
    for cell, target in ((T.hour(F.col("t")), hour), (T.weekday(F.col("t")), day)):
        if target is not None:
            out = out.join(R.mode_share(occ, cell).where(F.col("mode") == target).select("key"), "key", "left_semi")
    return out


def rolled_up(occ: DataFrame, now: int, keep: int = MAX_OCCURRENCES, max_age: int = MAX_AGE) -> DataFrame:
    """(key, active, rolled, rolled_first, rolled_last): occurrences beyond the newest ``keep`` or older than ``max_age`` are counted, not kept."""
    r = occ.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(F.col("t").desc())))
    old = (F.col("k") > keep) | (F.col("t") < now - max_age)
    return r.groupBy("key").agg(F.count_if(~old).alias("active"), F.count_if(old).alias("rolled"), F.min(F.when(old, F.col("t"))).alias("rolled_first"), F.max(F.when(old, F.col("t"))).alias("rolled_last"))


def recurs(occ: DataFrame, since: int, least: int) -> DataFrame:
    """Trigger: series that reach ``least`` occurrences with those from ``since`` on, and had fewer before."""
    c = occ.groupBy("key").agg(F.count_if(F.col("t") < since).alias("before"), F.count(F.lit(1)).alias("now"))
    return c.where((F.col("before") < least) & (F.col("now") >= least))


def drifted(scores: DataFrame, split: Column, threshold: float) -> DataFrame:
    """Trigger: (slot, before, after, delta) of slots whose mean cosine moved by at least the threshold between two windows."""
    c = scores.groupBy("slot").agg(F.avg(F.when(~split, F.col("score"))).alias("before"), F.avg(F.when(split, F.col("score"))).alias("after"))
    return c.withColumn("delta", F.col("after") - F.col("before")).where(F.abs("delta") >= threshold)


def new_region(arrivals: DataFrame, nearest: str, tau: float) -> DataFrame:
    """Trigger: arrivals whose nearest known row lies below the threshold, or that have none."""
    return arrivals.where(F.col(nearest).isNull() | (F.col(nearest) < tau))


def promoted(spans: DataFrame, routes: DataFrame, error_rate: float, least: int = 1) -> DataFrame:
    """Trace promotion: spans (span_id, path, status) of known routes (path) -> one edge each with its number of calls as
    weight, the share of 5xx answers, and whether that makes an incident. Repeated spans count once."""
    s = spans.dropDuplicates(["span_id"]).join(routes.select("path").distinct(), "path", "left_semi")
    c = s.groupBy("path").agg(F.count(F.lit(1)).alias("weight"), F.avg(F.col("status").between(500, 599).cast("double")).alias("error_rate"))
    return c.withColumn("incident", (F.col("error_rate") >= error_rate) & (F.col("weight") >= least))


def boosted_order(hits: DataFrame, start: int, end: int, fuse: Column, recurrence: Column, gate: Column, alpha: float = T.ALPHA) -> DataFrame:
    """Window, boost, gate: hits (cx_id, score, rank, t) in [start, end], boosted where positive and ranked again by score,
    old rank and id, then multiplied by the causal gate and ranked again."""
    def again(df: DataFrame, score: Column) -> DataFrame:
        new = df.withColumn("score", score)
        best = Window.orderBy(F.col("score").desc(), "rank", "cx_id")  # hits of one search
        return new.withColumn("new_rank", F.row_number().over(best)).withColumn("rank", F.col("new_rank")).drop("new_rank")

    inside = hits.where(F.col("t").between(start, end))
    return again(again(inside, T.boosted(F.col("score"), fuse, recurrence, alpha)), F.col("score") * gate).select("cx_id", "score", "rank")


DEEPEN = 4


def windowed_recall(hits: DataFrame, k: int, budget: int, in_window: Column, most: int | None = None) -> tuple[DataFrame, dict]:
    """(the best k of ``hits`` (cx_id, score, ...) in the window, a report).

    Without ``most`` all hits are looked at. With it, the best ``budget`` hits are, then four times as many, and so on,
    until k of them lie in the window or there are no more; if ``most`` is reached before that, it is an error.
    """
    if k < 1 or budget < 1 or (most is not None and most < budget):
        raise ValueError("k and budget start at 1, and most is no less than the budget")
    order = [F.col("score").desc(), F.col("cx_id").asc()]
    report = {"policy": "exhaustive" if most is None else "bounded", "requested_k": k, "rounds": 0}
    while True:
        report["rounds"] += 1
        some = hits if most is None else hits.orderBy(*order).limit(budget)
        seen, inside = some.agg(F.count(F.lit(1)), F.count_if(in_window)).first()
        done = most is None or seen < budget
        report |= {"budget": seen if most is None else budget, "fetched": seen, "in_window": inside, "exhausted": done}
        if inside >= k or done:
            return some.where(in_window).orderBy(*order).limit(k), report
        if budget == most:
            raise ValueError(f"{inside} of {k} hits lie in the window among the best {most}")
        budget = min(budget * DEEPEN, most)


def integer_boost(scores: DataFrame, recency: DataFrame, alpha_millis: int) -> DataFrame:
    """(cx_id, score) in whole micros times at most 1 + alpha; ids without a recency (0 to 1000 millis) keep their score."""
    if not 0 <= alpha_millis <= 100:
        raise ValueError("alpha is at most 100 millis")
    r = recency.select("cx_id", F.when(F.col("recency").between(0, 1000), F.col("recency")).otherwise(F.raise_error(F.lit("recency must lie in [0, 1000]")).cast("long")).alias("recency"))
    j = scores.join(r, "cx_id", "left").withColumn("recency", F.coalesce("recency", F.lit(0)))
    return j.select("cx_id", F.expr(f"(score * (1000 + ({alpha_millis} * recency) div 1000)) div 1000").alias("score"))
