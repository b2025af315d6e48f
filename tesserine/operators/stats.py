"""Dependence and information estimators that are plain aggregates and windows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, running, with_total


def value_ranks(df: DataFrame, col: str) -> DataFrame:
    """(v, low, mid, n): the first and the middle rank of each distinct value and how often it occurs; NULL has no rank."""
    n = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return running(n, "v", ["n"]).select("v", (F.col("n_before") + 1).alias("low"), (F.col("n_before") + (F.col("n") + 1) / 2).alias("mid"), "n")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson of mid-ranks. Ranks come from counts per distinct value, so rows are never sorted in one task."""

    def ranks(c: str) -> DataFrame:
        return value_ranks(df, c).select(F.col("v").alias(f"v_{c}"), F.col("mid").alias(f"r_{c}"))

    j = df.join(ranks(x), F.col(x) == F.col(f"v_{x}")).join(ranks(y), F.col(y) == F.col(f"v_{y}"))
    return j.agg(F.corr(f"r_{x}", f"r_{y}").alias("rho"), F.count(F.lit(1)).alias("n"))


def partial_corr(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    c = df.agg(F.corr(x, y).alias("xy"), F.corr(x, z).alias("xz"), F.corr(y, z).alias("yz"))
    return c.select(((F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2))).alias("r"))


def contingency(df: DataFrame, x: str, y: str) -> DataFrame:
    """Cells (x, y, o) with row, column and total sums."""
    c = df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).cast("double").alias("o"))
    return with_total(cut(c), n=F.sum("o")).withColumns({"r": F.sum("o").over(Window.partitionBy("x")), "c": F.sum("o").over(Window.partitionBy("y"))})


def categorical(df: DataFrame, x: str, y: str) -> DataFrame:
    """Chi-squared, G, phi, Cramer's V, mutual information in bits and Theil's U(y|x)."""
    c = contingency(df, x, y)
    a = c.agg(
        F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("q"), F.max("n").alias("n"), F.countDistinct("x").alias("kx"), F.countDistinct("y").alias("ky"),
        F.sum(F.col("o") * F.ln(F.col("o") * F.col("n") / (F.col("r") * F.col("c")))).alias("g"),
        F.sum(-F.col("o") / F.col("n") * F.log2(F.col("c") / F.col("n"))).alias("hy"),
    )
    chi = F.col("n") * (F.col("q") - 1)
    mi = F.col("g") / F.col("n") / F.ln(F.lit(2.0))
    return a.select(
        chi.alias("chi2"), (2 * F.col("g")).alias("g"), F.sqrt(chi / F.col("n")).alias("phi"),
        F.least(F.lit(1.0), F.sqrt(chi / (F.col("n") * (F.least("kx", "ky") - 1)))).alias("cramers_v"), mi.alias("mi_bits"), (mi / F.col("hy")).alias("theil_u"),
        ((F.col("kx") - 1) * (F.col("ky") - 1)).alias("dof"),
    )


def nmi(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Normalised mutual information over equal-width bins."""
    ext = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()
    bin_ = lambda c, lo, hi: F.least(F.floor((F.col(c) - lo) / max(hi - lo, 1e-12) * bins), F.lit(bins - 1))
    c = contingency(df.select(bin_(x, ext["x0"], ext["x1"]).alias("bx"), bin_(y, ext["y0"], ext["y1"]).alias("by")), "bx", "by")
    p = F.col("o") / F.col("n")
    h = c.agg(F.sum(-p * F.log2(p)).alias("hxy"), F.sum(-p * F.log2(F.col("r") / F.col("n"))).alias("hx"), F.sum(-p * F.log2(F.col("c") / F.col("n"))).alias("hy"))
    mi = F.greatest(F.col("hx") + F.col("hy") - F.col("hxy"), F.lit(0.0))
    return h.select(mi.alias("mi_bits"), F.coalesce(F.try_divide(mi, F.sqrt(F.col("hx") * F.col("hy"))), F.lit(0.0)).alias("nmi"))


def concentration(df: DataFrame, amount: str) -> DataFrame:
    """Herfindahl index and top share of the positive amounts; 0 when there are none."""
    p = df.where(F.col(amount) > 0).agg(F.sum(amount).alias("t"), F.sum(F.col(amount) * F.col(amount)).alias("q"), F.max(amount).alias("m"))
    return p.select(F.coalesce(F.col("q") / (F.col("t") * F.col("t")), F.lit(0.0)).alias("herfindahl"), F.coalesce(F.col("m") / F.col("t"), F.lit(0.0)).alias("top_share"))


def cross_correlation(df: DataFrame, t: str, x: str, y: str, lags: range) -> DataFrame:
    """(lag, r): a positive lag means that x leads. Rows meet on their index shifted by each lag."""
    shifted = df.select(F.col(x).alias("xv"), F.explode(F.array(*[F.struct((F.col(t) + k).alias("t"), F.lit(k).alias("lag")) for k in lags])).alias("s"))
    j = shifted.join(df.select(F.col(t).alias("t2"), F.col(y).alias("yv")), F.col("s.t") == F.col("t2"))
    return j.groupBy(F.col("s.lag").alias("lag")).agg(F.corr("xv", "yv").alias("r"), F.count(F.lit(1)).alias("n"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p, zz = hits / n, z * z
    mid, half = p + zz / (2 * n), z * F.sqrt((p * (1 - p) + zz / (4 * n)) / n)
    return (mid - half) / (1 + zz / n), (mid + half) / (1 + zz / n)


def copula(df: DataFrame, x: str, y: str, q: float = 0.1) -> DataFrame:
    """Blomqvist's beta and tail dependence of the ranks u = rank / (n + 1); ties are refused."""
    n = df.count()
    ranks = [value_ranks(df, c).select(F.col("v").alias(f"_{k}"), (F.col("low") / F.lit(n + 1)).alias(k)) for c, k in ((x, "u"), (y, "v"))]
    u = df.join(ranks[0], F.col(x) == F.col("_u")).join(ranks[1], F.col(y) == F.col("_v")).select("u", "v")
    half = F.count_if((F.col("u") <= 0.5) & (F.col("v") <= 0.5)) / F.count(F.lit(1))
    low = F.count_if((F.col("u") <= q) & (F.col("v") <= q)) / F.count(F.lit(1)) / q
    high = F.count_if((F.col("u") > 1 - q) & (F.col("v") > 1 - q)) / F.count(F.lit(1)) / q
    whole = F.assert_true((F.countDistinct("u") == F.count(F.lit(1))) & (F.countDistinct("v") == F.count(F.lit(1))), "ties")
    a = u.agg((4 * half - 1).alias("beta"), F.least(low, F.lit(1.0)).alias("lower"), F.least(high, F.lit(1.0)).alias("upper"), whole.alias("_ok"))
    return a.where(F.col("_ok").isNull()).select("beta", "lower", "upper")


def base_rate(neighbours: DataFrame, outcome: str, score: str, saturation: int = 20) -> DataFrame:
    """Mean outcome of the nearest neighbours; reliability is their mean similarity times min(k / saturation, 1)."""
    sim = F.avg(F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)))
    return neighbours.agg(F.avg(F.col(outcome).cast("double")).alias("p"), (sim * F.least(F.count(F.lit(1)) / saturation, F.lit(1.0))).alias("reliability"))


def information_parts(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Total correlation and interaction information (H of singles - H of pairs + H of all) of three categories in bits, with the effective number of columns.

    One shuffle counts the cells; every marginal is a window over the cells.
    """
    names = [x, y, z]
    cells = df.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("_o"))
    sets = [c for r in (1, 2, 3) for c in combinations(names, r)]
    p = F.col("_o") / F.sum("_o").over(Window.partitionBy())
    h = cells.select(p.alias("p"), *[(F.sum("_o").over(Window.partitionBy(*c)) / F.sum("_o").over(Window.partitionBy())).alias(f"m{i}") for i, c in enumerate(sets)])
    h = h.agg(*[F.sum(-F.col("p") * F.log2(f"m{i}")).alias(f"h{i}") for i in range(7)])
    single, pairs = F.col("h0") + F.col("h1") + F.col("h2"), F.col("h3") + F.col("h4") + F.col("h5")
    total = F.greatest(single - F.col("h6"), F.lit(0.0))
    n_eff = F.least(F.greatest(3 * (1 - F.coalesce(F.try_divide(total, single), F.lit(0.0))), F.lit(1.0)), F.lit(3.0))
    return h.select(total.alias("total_correlation"), (single - pairs + F.col("h6")).alias("interaction"), n_eff.alias("n_eff"))


def stable_rank(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Squared trace over squared Frobenius norm of the second-moment matrix. Each task adds up one matrix of dim x dim, so the shuffle does not grow with the rows."""
    import numpy as np
    import pandas as pd

    def gram(batches):
        total = None
        for b in batches:
            if len(b):
                v = np.stack([np.asarray(x, float) for x in b["v"]])
                total = v.T @ v if total is None else total + v.T @ v
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "g": total.ravel()})

    cells = vectors.where(F.col(vec_col).isNotNull()).select(F.col(vec_col).alias("v")).mapInPandas(gram, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))
    trace = F.sum(F.when(F.col("i") == F.col("j"), F.col("g")).otherwise(0.0))
    return cells.agg(F.try_divide(trace * trace, F.sum(F.col("g") * F.col("g"))).alias("stable_rank"))


def region_energy(scores: DataFrame, region: str, score: str, beta: float) -> DataFrame:
    """(region, energy): -ln of the summed exp(beta * cosine). Cosines are at most 1, so exp(beta * (cosine - 1)) cannot overflow."""
    if not 0 <= beta <= 300:
        raise ValueError("beta from 0 to 300")
    return scores.groupBy(region).agg((-(beta + F.ln(F.sum(F.exp(beta * (F.col(score) - 1)))))).alias("energy"))


def gamma_poisson(events: Column, exposure: Column, shape: float = 1.0, rate: float = 1.0) -> Column:
    """Posterior mean of a Poisson rate under a gamma prior."""
    return (shape + events) / (rate + exposure)
