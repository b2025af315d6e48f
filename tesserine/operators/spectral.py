"""Laplacian eigenmaps and communities by block power iteration.

The vectors of a block are the columns of a node table. A step multiplies them by the lazy
normalised adjacency (one join with the edges and one aggregate); small Gram matrices,
summed by Spark and solved on the driver, make them orthonormal again and tell how far
they are from eigenvectors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import collapsed
from .lineage import cut

EXTRA = 3


def _grams(df: DataFrame, x: list[str], y: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """X'X, X'Y and Y'Y from one aggregate; Y is a symmetric matrix times X, so that all three are symmetric."""
    n = len(x)
    upper = [(i, j) for i in range(n) for j in range(i, n)]
    both = [(one[i], two[j]) for one, two in ((x, x), (x, y), (y, y)) for i, j in upper]
    r = df.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"g{k}") for k, (a, b) in enumerate(both)]).first()
    out = np.zeros((3, n, n))
    for k, value in enumerate(r):
        i, j = upper[k % len(upper)]
        out[k // len(upper), i, j] = out[k // len(upper), j, i] = value or 0.0
    return out[0], out[1], out[2]


def _times(columns: list[str], m: np.ndarray) -> list[Column]:
    out = []
    for j in range(m.shape[1]):
        c = F.lit(0.0)
        for i, name in enumerate(columns):
            c = c + F.col(name) * float(m[i, j])
        out.append(c)
    return out


def eigenmaps(edges: DataFrame, k: int, rounds: int = 30, steps: int = 8, tol: float = 1e-3) -> tuple[DataFrame, list[float]]:
    """(node, x) with the k lowest eigenvectors of the symmetric normalised Laplacian, and their eigenvalues.

    A round is a Chebyshev filter of ``steps`` multiplications, which damps what lies below the lowest value that the
    block holds, and one orthonormalisation. The eigenvectors of eigenvalue 0 are known, one for each connected component; they
    come first, and the iteration finds the others at right angles to them. It ends when every residual is at most ``tol``; ``rounds`` without that are
    an error. Multiple eigenvalues give some basis of their space. Edges with weights that are not positive are
    left out; both directions of an edge add up.
    """
    e = edges.where("weight > 0").select("src", "dst", F.col("weight").cast("double").alias("weight"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    deg = cut(both.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("d")))
    n = deg.count()
    if n < k:
        raise ValueError(f"{n} nodes have no {k} eigenvectors")
    scaled = both.join(deg.select(F.col("node").alias("src"), F.col("d").alias("ds")), "src").join(deg.select(F.col("node").alias("dst"), F.col("d").alias("dd")), "dst")
    scaled = cut(scaled.select("src", "dst", (F.col("weight") / F.sqrt(F.col("ds") * F.col("dd"))).alias("w")))
    # A component's own vector: the roots of its degrees, of length one.
    comps = collapsed(both.select(F.col("src").alias("a"), F.col("dst").alias("b"))).select(F.col("id").alias("node"), F.col("kept").alias("comp"))
    deg = deg.join(comps, "node")
    whole = deg.groupBy("comp").agg(F.sum("d").alias("all"))
    deg = cut(deg.join(whole, "comp").select("node", "d", "comp", F.sqrt(F.col("d") / F.col("all")).alias("null")))
    count = whole.count()
    # By weight, the heaviest first; names decide where weights are equal.
    named = [r["comp"] for r in whole.orderBy(F.col("all").desc(), "comp").limit(k).collect()]
    nulls = [F.when(F.col("comp") == c, F.col("null")).otherwise(0.0) for c in named]
    if count >= k:
        return cut(deg.select("node", F.array(*nulls).alias("x"))), [0.0] * k
    k -= count
    width = min(n - count, k + EXTRA)
    x = [f"x{j}" for j in range(width)]
    table = deg.select("node", "comp", "null", *[(F.xxhash64("node", F.lit(j)) / 2.0**63).alias(c) for j, c in enumerate(x)])
    floor = 0.5

    def multiplied(t: DataFrame, columns: list[str]) -> DataFrame:
        """The table with y0, y1 ..: half of a node's own value and half of its neighbours' weighted sum."""
        sums = scaled.join(t.select(F.col("node").alias("dst"), *columns), "dst").groupBy(F.col("src").alias("node")).agg(*[F.sum(F.col("w") * F.col(c)).alias(f"s{j}") for j, c in enumerate(columns)])
        return t.join(sums, "node").select("*", *[((F.col(c) + F.col(f"s{j}")) / 2).alias(f"y{j}") for j, c in enumerate(columns)])

    def apart(t: DataFrame, columns: list[str]) -> DataFrame:
        """Without what lies along the components' own vectors; there are fewer than ``k`` of them."""
        own = t.groupBy("comp").agg(*[F.sum(F.col("null") * F.col(c)).alias(f"o{j}") for j, c in enumerate(columns)])
        return t.join(F.broadcast(own), "comp").select("node", "comp", "null", *[(F.col(c) - F.col("null") * F.col(f"o{j}")).alias(c) for j, c in enumerate(columns)])

    table = cut(apart(table, x))
    for _ in range(rounds):
        for step in range(steps):
            shifted = [F.col(f"y{j}") * (2 / floor) - F.col(c) for j, c in enumerate(x)]
            new = shifted if step == 0 else [s * 2 - F.col(f"p{j}") for j, s in enumerate(shifted)]
            table = multiplied(table, x).select("node", "comp", "null", *[v.alias(c) for v, c in zip(new, x, strict=True)], *[F.col(c).alias(f"p{j}") for j, c in enumerate(x)])
            if step % 4 == 3:
                table = cut(table)
        table = cut(apart(table.select("node", "comp", "null", *x), x))
        xx, xy, yy = _grams(multiplied(table, x), x, [f"y{j}" for j in range(len(x))])
        # Orthonormal columns; directions that vanished are dropped.
        value, vector = np.linalg.eigh(xx)
        keep = value > value.max() * 1e-12
        basis = vector[:, keep] / np.sqrt(value[keep])
        theta, v = np.linalg.eigh(basis.T @ xy @ basis)
        theta, m = theta[::-1], basis @ v[:, ::-1]
        left = np.einsum("ij,ik,kj->j", m, yy, m) - theta**2
        new = [f"x{j}" for j in range(m.shape[1])]
        table = table.select("node", "comp", "null", *[c.alias(a) for c, a in zip(_times(x, m), new, strict=True)])
        x, floor = new, float(np.clip(theta[-1], 0.1, 0.999))
        if len(x) >= k and np.sqrt(np.maximum(left[:k], 0)).max() <= tol:
            return cut(table.select("node", F.array(*nulls, *x[:k]).alias("x"))), [0.0] * count + (2 - 2 * theta[:k]).tolist()
    raise RuntimeError(f"not converged after {rounds} rounds")


def communities(maps: DataFrame, k: int, rounds: int = 40) -> DataFrame:
    """(node, community): k-means of the rows of the eigenvectors, each scaled to length one; a community is named by its smallest node.

    The first centres are rows at right angles as far as there are any: each is the row that is least like
    those before it, by name where several are. Components that do not hang together are told apart so at any size.
    """
    size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    unit = cut(maps.select("node", F.transform("x", lambda v: F.coalesce(F.try_divide(v, size), F.lit(0.0))).alias("u")))
    width = unit.select(F.max(F.size("u"))).first()[0] or 0

    def dot(center: list[float]) -> Column:
        return sum((F.element_at("u", i + 1) * float(c) for i, c in enumerate(center)), F.lit(0.0))

    first = unit.orderBy(F.xxhash64("node"), "node").limit(1).collect()
    centers = [list(r["u"]) for r in first]
    while centers and len(centers) < k:
        like = F.greatest(*[dot(c) for c in centers]) if len(centers) > 1 else dot(centers[0])
        centers.append(list(unit.orderBy(F.round(like, 9), "node").limit(1).first()["u"]))

    def placed() -> DataFrame:
        far = F.array(*[F.struct(F.round(sum(float(v) * float(v) for v in c) - dot(c) * 2, 12).alias("d"), F.lit(j).alias("at")) for j, c in enumerate(centers)])
        return unit.select("node", "u", F.array_min(far)["at"].alias("at"))

    for _ in range(rounds if centers else 0):
        means = {r["at"]: list(r[1:]) for r in placed().groupBy("at").agg(*[F.avg(F.element_at("u", i + 1)).alias(f"m{i}") for i in range(width)]).collect()}
        new = [means.get(j, c) for j, c in enumerate(centers)]
        done = np.abs(np.array(new) - np.array(centers)).max() <= 1e-9
        centers = new
        if done:
            break
    found = placed() if centers else unit.select("node", F.lit(0).alias("at"))
    name = found.groupBy("at").agg(F.min("node").alias("community"))
    return found.join(F.broadcast(name), "at").select("node", "community")
