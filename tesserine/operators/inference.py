"""Tests, intervals, gates and market screens on top of the statistics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, with_total
from .stats import contingency, value_ranks

# Fixed values of lens admission, of a reliable base rate, and of a full screen.
MIN_SIGNAL_BITS, MAX_PAIR_CORR = 0.05, 0.6
MIN_RELIABILITY = 0.5


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 400):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + up * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + up / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


def student_p(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))


def pearson_test(df: DataFrame, x: str, y: str, z: float = 1.959963984540054) -> DataFrame:
    """(r, n, t, p, low, high) over rows that have both values: t on n - 2 degrees, interval by Fisher's z; at least four rows."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.corr(x, y), F.count(F.lit(1))).first()
    r, n = both
    if n < 4 or r is None or math.isnan(r):
        raise ValueError("at least four rows and two values each")
    t = math.inf * r if abs(r) >= 1 else r * math.sqrt((n - 2) / (1 - r * r))
    mid = math.atanh(max(-1 + 1e-15, min(1 - 1e-15, r)))
    half = z / math.sqrt(n - 3)
    row = (r, n, t, student_p(t, n - 2) if math.isfinite(t) else 0.0, math.tanh(mid - half), math.tanh(mid + half))
    return df.sparkSession.createDataFrame([row], "r double, n long, t double, p double, low double, high double")


def partial_network(df: DataFrame, columns: list[str], least: float = 0.0, limit: int = 64) -> DataFrame:
    """(a, b, r): correlation of each pair given all other columns, from the inverse of the correlation matrix, where it reaches
    ``least``. One aggregate of a row of moments; the matrix of at most ``limit`` columns is inverted on the driver."""
    if len(columns) > limit:
        raise ValueError(f"more than {limit} columns")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    got = df.dropna(subset=columns).agg(*[F.corr(a, b) for a, b in pairs]).first()
    m = np.eye(len(columns))
    for (a, b), r in zip(pairs, got, strict=True):
        i, j = columns.index(a), columns.index(b)
        m[i, j] = m[j, i] = r
    inverse = np.linalg.inv(m)
    scale = np.sqrt(np.diag(inverse))
    out = [(a, b, float(-inverse[i, j] / (scale[i] * scale[j]))) for a, b in pairs for i, j in [(columns.index(a), columns.index(b))]]
    return df.sparkSession.createDataFrame([r for r in out if abs(r[2]) >= least], "a string, b string, r double")


def skeleton(df: DataFrame, columns: list[str], alpha_z: float = 2.5758293035489004, depth: int = 2) -> DataFrame:
    """(a, b): edges that PC-stable keeps: a pair goes when its partial correlation given some neighbours of one end, up to
    ``depth`` of them, is not told from zero by Fisher's z. Only the correlation matrix leaves the executors."""
    from itertools import combinations

    pairs = list(combinations(columns, 2))
    got = df.dropna(subset=columns).agg(F.count(F.lit(1)), *[F.corr(a, b) for a, b in pairs]).first()
    n, at = got[0], {c: i for i, c in enumerate(columns)}
    m = np.eye(len(columns))
    for (a, b), r in zip(pairs, got[1:], strict=True):
        m[at[a], at[b]] = m[at[b], at[a]] = r
    near = {c: set(columns) - {c} for c in columns}
    for size in range(depth + 1):
        frozen = {c: set(v) for c, v in near.items()}  # stable: removals of one depth don't change its other tests
        for a, b in pairs:
            if b not in near[a]:
                continue
            for given in [g for end, other in ((a, b), (b, a)) for g in combinations(sorted(frozen[end] - {other}), size)]:
                use = [at[a], at[b], *(at[g] for g in given)]
                inv = np.linalg.pinv(m[np.ix_(use, use)])
                r = -inv[0, 1] / math.sqrt(inv[0, 0] * inv[1, 1])
                if abs(math.atanh(max(-1 + 1e-15, min(1 - 1e-15, r)))) * math.sqrt(max(n - size - 3, 0)) <= alpha_z:
                    near[a].discard(b)
                    near[b].discard(a)
                    break
    return df.sparkSession.createDataFrame([(a, b) for a, b in pairs if b in near[a]], "a string, b string")


def theil(df: DataFrame, x: str, y: str) -> DataFrame:
    """(u_xy, u_yx): the share of x's entropy that y explains, and the other way round."""
    c = contingency(df, x, y)
    one = lambda v: F.when(v > 0, -v * F.log2(v)).otherwise(0.0)
    h = c.agg(F.sum(one(F.col("o") / F.col("n"))).alias("hxy"))
    hx = c.select("x", (F.col("r") / F.col("n")).alias("p")).distinct().agg(F.sum(one(F.col("p"))).alias("hx"))
    hy = c.select("y", (F.col("c") / F.col("n")).alias("p")).distinct().agg(F.sum(one(F.col("p"))).alias("hy"))
    j = h.crossJoin(hx).crossJoin(hy)  # one row each
    mi = F.greatest(F.col("hx") + F.col("hy") - F.col("hxy"), F.lit(0.0))
    return j.select(F.coalesce(F.try_divide(mi, F.col("hx")), F.lit(0.0)).alias("u_xy"), F.coalesce(F.try_divide(mi, F.col("hy")), F.lit(0.0)).alias("u_yx"))


def gini_gamma(df: DataFrame, x: str, y: str) -> DataFrame:
    """Gini's gamma of the ranks: how much closer they lie to each other than to their reverse; ties share their first rank."""
    n = df.count()
    a, b = (value_ranks(df, c).select(F.col("v").alias(f"_v{k}"), F.col("low").alias(k)) for c, k in ((x, "p"), (y, "q")))
    j = df.join(a, F.col(x) == F.col("_vp")).join(b, F.col(y) == F.col("_vq"))
    return j.agg((F.sum(F.abs(F.col("p") + F.col("q") - (n + 1)) - F.abs(F.col("p") - F.col("q"))) / (n * n // 2)).alias("gamma"))


def beta_moments(hits: Column, n: Column, a: float = 1.0, b: float = 1.0) -> tuple[Column, Column]:
    """Mean and variance of a Beta posterior after hits of n."""
    p, q = hits + a, n - hits + b
    return p / (p + q), p * q / ((p + q) * (p + q) * (p + q + 1))


def gamma_moments(events: Column, exposure: Column, shape: float = 1.0, rate: float = 1.0) -> tuple[Column, Column]:
    """Mean and variance of a Gamma posterior of a rate."""
    return (events + shape) / (exposure + rate), (events + shape) / ((exposure + rate) * (exposure + rate))


def apportioned(strata: DataFrame, name: str, size: str, seats: int) -> DataFrame:
    """Strata with ``seats`` by largest remainder, ties to the smaller name; as many as there are rows at most. One row a stratum."""
    s = strata.crossJoin(F.broadcast(strata.agg(F.sum(size).alias("_n")))).withColumn("_t", F.least(F.lit(seats).cast("long"), F.col("_n")))
    s = s.withColumns({"_base": F.expr(f"(_t * {size}) div _n"), "_rest": F.expr(f"(_t * {size}) % _n")})
    left = s.agg((F.max("_t") - F.sum("_base")).alias("_left"))
    k = F.row_number().over(Window.orderBy(F.col("_rest").desc(), name))  # strata, not rows
    s = s.crossJoin(F.broadcast(left)).withColumn("_k", k)
    return s.select(*strata.columns, (F.col("_base") + (F.col("_k") <= F.col("_left")).cast("long")).alias("seats"))


def admitted(signal: DataFrame, corr: DataFrame) -> DataFrame:
    """(slot, bits) and (a, b, corr) -> each slot with its largest correlation with another and whether it is admitted."""
    c = corr.select(F.col("a").alias("slot"), F.abs("corr").alias("c")).unionByName(corr.select(F.col("b").alias("slot"), F.abs("corr").alias("c")))
    top = c.groupBy("slot").agg(F.max("c").alias("max_corr"))
    ok = (F.col("bits") >= MIN_SIGNAL_BITS) & (F.coalesce("max_corr", F.lit(0.0)) <= MAX_PAIR_CORR)
    return signal.join(top, "slot", "left").withColumn("admitted", ok)


def mutual_bits(df: DataFrame, x: Column, y: Column, by: list[str] | None = None) -> DataFrame:
    """(by, bits, target_bits): mutual information of two columns and the entropy of the second, per group."""
    by = by or []
    c = df.groupBy(*by, x.alias("_x"), y.alias("_y")).agg(F.count(F.lit(1)).cast("double").alias("o"))
    w = lambda *k: Window.partitionBy(*by, *k)
    c = c.withColumn("n", F.sum("o").over(w())) if by else with_total(cut(c), n=F.sum("o"))
    c = c.withColumns({"r": F.sum("o").over(w("_x")), "c": F.sum("o").over(w("_y"))})
    bits = F.greatest(F.sum(F.col("o") / F.col("n") * F.log2(F.col("o") * F.col("n") / (F.col("r") * F.col("c")))), F.lit(0.0))
    # Each cell carries its share of its column's term, so that the terms add up to the entropy.
    return c.groupBy(*by).agg(bits.alias("bits"), (-F.sum(F.col("o") / F.col("n") * F.log2(F.col("c") / F.col("n")))).alias("target_bits"))


def sufficiency(panel: DataFrame, share: float = 0.9) -> DataFrame:
    """Panel bits against the target's entropy: deficit, ceiling by data processing, and whether the share is reached."""
    return panel.select("bits", "target_bits", F.greatest(F.col("target_bits") - F.col("bits"), F.lit(0.0)).alias("deficit"), F.least(F.lit(1.0), F.coalesce(F.try_divide("bits", "target_bits"), F.lit(1.0))).alias("ceiling")).withColumn("sufficient", F.col("ceiling") >= share)


def signal_yield(inputs: int, lenses: int) -> tuple[int, int]:
    """(cross terms of a panel, signals it can give): every lens, every pair of lenses and one agreement per input."""
    cross = lenses * (lenses - 1) // 2
    return cross, inputs * (lenses + cross + 1)


def forecast_scores(df: DataFrame, p: str, y: str) -> DataFrame:
    """Brier score and log loss per row; the latter is NULL where p is 0 or 1."""
    loss = -(F.col(y) * F.ln(p) + (1 - F.col(y)) * F.ln(1 - F.col(p)))
    return df.withColumns({"brier": (F.col(p) - F.col(y)) * (F.col(p) - F.col(y)), "log_loss": F.when((F.col(p) > 0) & (F.col(p) < 1), loss)})


def calibration(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy, gap) of equal-width bins of a forecast."""
    cell = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long")
    c = df.groupBy(cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("confidence"), F.avg(y).alias("accuracy"))
    return c.withColumn("gap", F.abs(F.col("confidence") - F.col("accuracy")))


def counterparties(trades: DataFrame, market: str, party: str, amount: str) -> DataFrame:
    """(market, parties, volume, top_share, herfindahl) of the counterparties' total volumes."""
    v = trades.groupBy(market, party).agg(F.sum(amount).alias("v"))
    c = v.groupBy(market).agg(F.count(F.lit(1)).alias("parties"), F.sum("v").alias("volume"), F.max("v").alias("_top"), F.sum(F.col("v") * F.col("v")).alias("_sq"))
    return c.select(market, "parties", "volume", F.coalesce(F.try_divide("_top", "volume"), F.lit(0.0)).alias("top_share"), F.coalesce(F.try_divide(F.col("_sq"), F.col("volume") * F.col("volume")), F.lit(0.0)).alias("herfindahl"))


def wash_screen(parties: DataFrame, raw: DataFrame, market: str, min_parties: int, min_ratio: float, max_top_share: float) -> DataFrame:
    """Markets with ``ratio`` of counterparty volume to raw volume and the first test that fails, or ok."""
    j = raw.join(parties, market, "left").withColumn("ratio", F.try_divide("volume", "raw_volume"))
    code = (
        F.when(F.col("raw_volume").isNull() | (F.col("raw_volume") <= 0), "missing_raw_volume").when(F.coalesce("parties", F.lit(0)) == 0, "missing_counterparties")
        .when(F.col("ratio") > 1.000001, "volume_exceeds_raw").when(F.col("parties") < min_parties, "few_counterparties").when(F.col("ratio") < min_ratio, "low_ratio")
        .when(F.col("top_share") > max_top_share, "one_counterparty").otherwise("ok")
    )
    return j.withColumn("code", code)


def mispriced(rates: DataFrame, price: str, p: str, reliability: str, threshold: float, least: float = MIN_RELIABILITY) -> DataFrame:
    """Price against the neighbours' rate: divergence, direction, and whether it is flagged (reliable and beyond the threshold)."""
    gap = F.abs(F.col(price) - F.col(p))
    side = F.when(gap <= threshold, "aligned").when(F.col(price) > F.col(p), "overpriced").otherwise("underpriced")
    return rates.withColumns({"divergence": gap, "direction": side, "flagged": (gap > threshold) & (F.col(reliability) >= least)})


def softmax_weights(scores: DataFrame, region: str, score: str, beta: float) -> DataFrame:
    """Weights exp(beta * score) over their region's sum, shifted by the region's largest score first."""
    top = scores.groupBy(region).agg(F.max(score).alias("_m"))
    e = scores.join(top, region).withColumn("_e", F.exp(beta * (F.col(score) - F.col("_m"))))
    total = e.groupBy(region).agg(F.sum("_e").alias("_s"))
    return e.join(total, region).withColumn("weight", F.col("_e") / F.col("_s")).drop("_m", "_e", "_s")


def capped_prediction(prediction: DataFrame, self_consistency: float, ceiling: float, least: float) -> DataFrame:
    """Confidence under both ceilings; below ``least`` no prediction is given."""
    c = prediction.withColumn("confidence", F.least(F.col("confidence"), F.lit(self_consistency), F.lit(ceiling)))
    return c.withColumn("sufficient", F.col("confidence") >= least).withColumn("prediction", F.when(F.col("sufficient"), F.col("prediction")))
