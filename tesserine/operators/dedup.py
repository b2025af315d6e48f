"""Near duplicates of constellations and token streams: all-slot cosine pairs, conflicts, actions, MinHash pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .lineage import cut

#: Hashes of a signature, tokens a text needs, and the prime of the permutations.
HASHES, LEAST_TOKENS, PRIME = 64, 30, 2_147_483_647
BANDS = 16


def slot_pairs(vectors: DataFrame, tau: dict[int, float], width: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(a, b, worst): pairs a < b whose cosine reaches ``tau`` in every required slot; ``worst`` is the smallest excess.

    Unit vectors at a cosine of at least tau differ by at most r = sqrt(2 - 2 tau) in every
    component, so the strictest slot's first component is cut into slabs of width r and packed
    blocks of a slab meet those of its own and of the next one; only pairs that pass leave a
    meeting. Equal vectors are one row first. A zero slot matches nothing.
    """
    slots = sorted(tau)
    strict = max(tau, key=lambda k: (tau[k], -k))
    r = math.sqrt(max(2 - 2 * tau[strict], 1e-12)) + 1e-9
    bars = np.array([tau[k] for k in slots])
    rows = vectors.groupBy(F.col(vec_col).alias("v")).agg(F.min(id_col).alias("id"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The required slots of a vector, each of length one, end to end."""
        for b in batches:
            ids, cells, out = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.array([v[k * width : (k + 1) * width] for k in slots], float) if len(v) >= (slots[-1] + 1) * width else np.zeros((1, 1))
                n = np.sqrt((x * x).sum(axis=1, keepdims=True))
                if (n > 0).all() and np.isfinite(n).all():
                    x = x / n
                    ids.append(i), cells.append(math.floor(x[slots.index(strict), 0] / r)), out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["cell", "id", "v"])

    def worst(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        p, q = p.reshape(len(p), len(slots), width), q.reshape(len(q), len(slots), width)
        return np.min([p[:, k] @ q[:, k].T - bar for k, bar in enumerate(bars)], axis=0)

    unit = rows.select(F.col("id").cast("long"), F.col("v").cast("array<double>")).mapInArrow(parts, "cell int, id long, v binary")
    return blocks.pairs(unit, worst).select("a", "b", F.col("score").alias("worst"))


def conflicts(pairs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Pairs with ``conflict``: both ends have an anchor (id, anchor) and the anchors differ, which blocks a merge."""
    a = anchors.select(F.col("id").alias("a"), F.col("anchor").alias("_x"))
    b = anchors.select(F.col("id").alias("b"), F.col("anchor").alias("_y"))
    return pairs.join(a, "a", "left").join(b, "b", "left").withColumn("conflict", F.coalesce(F.col("_x") != F.col("_y"), F.lit(False))).drop("_x", "_y")


def collapsed(pairs: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, kept): the smallest id that each id of a pair reaches; ids without pairs don't appear."""
    e = cut(pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    label = e.select(F.col("x").alias("id")).distinct().withColumn("kept", F.col("id"))
    for _ in range(rounds):
        least = e.join(label, e.y == label.id).groupBy("x").agg(F.min("kept").alias("m"))
        new = label.join(least, F.col("id") == F.col("x")).select("id", F.least("kept", "m").alias("kept"))
        # A label's own label is a short cut.
        jump = new.select(F.col("id").alias("_i"), F.col("kept").alias("_k"))
        new = cut(new.join(jump, F.col("kept") == F.col("_i"), "left").select("id", F.least("kept", F.coalesce("_k", "kept")).alias("kept")))
        if label.join(new.select("id", F.col("kept").alias("n")), "id").where("kept <> n").isEmpty():
            return new
        label = new
    raise RuntimeError(f"groups did not settle within {rounds} rounds")


def merged(rows: DataFrame, pairs: DataFrame, action: str, key: str) -> DataFrame:
    """What a dedup action leaves: ``collapse`` and ``reject`` keep the smallest id of a group, ``link`` keeps all rows with
    ``linked_to``, ``recurrence`` keeps the smallest with ``occurrences``. Pairs in conflict don't count."""
    use = pairs.where(~F.col("conflict")) if "conflict" in pairs.columns else pairs
    g = rows.join(collapsed(use).withColumnRenamed("id", "_id"), F.col(key) == F.col("_id"), "left").withColumn("kept", F.coalesce("kept", key)).drop("_id")
    if action == "link":
        return g.withColumn("linked_to", F.when(F.col("kept") != F.col(key), F.col("kept"))).drop("kept")
    if action == "recurrence":
        n = g.groupBy(F.col("kept").alias(key)).agg(F.count(F.lit(1)).alias("occurrences"))
        return rows.join(n, key)
    if action in ("collapse", "reject"):
        return g.where(F.col("kept") == F.col(key)).drop("kept")
    raise ValueError(f"unknown action {action}")


def permutations(k: int = HASHES) -> list[tuple[int, int]]:
    return [((i * 2_654_435_761 + 40_503) % PRIME, (i * 1_013_904_223 + 1) % PRIME) for i in range(1, k + 1)]


def minhash(docs: DataFrame, words: Column, id_col: str = "doc_id", k: int = HASHES, n: int = 3) -> DataFrame:
    """(id, m): k minima over the n-token shingles of each row's array of tokens; rows of fewer than ``LEAST_TOKENS`` are left out.

    Shingles are hashed once and spread out; the minima are partial aggregates, so one row a document is shuffled.
    """
    w = docs.select(F.col(id_col).alias("id"), words.alias("w")).where(F.size("w") >= LEAST_TOKENS)
    shingles = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))
    g = w.select("id", F.explode(shingles).alias("g")).select("id", F.conv(F.substring(F.md5("g"), 1, 7), 16, 10).cast("long").alias("h"))
    least = g.groupBy("id").agg(*[F.min((F.lit(a).cast("long") * F.col("h") + F.lit(b).cast("long")) % PRIME).alias(f"m{i}") for i, (a, b) in enumerate(permutations(k))])
    return least.select("id", F.array(*[f"m{i}" for i in range(k)]).alias("m"))


def minhash_pairs(docs: DataFrame, words: Column, least: float, id_col: str = "doc_id", bands: int = BANDS) -> DataFrame:
    """(a, b, similarity): classes of equal signatures, told by their smallest id, that share a band and agree in at least that share."""
    rows = HASHES // bands
    sig = minhash(docs, words, id_col).groupBy("m").agg(F.min("id").alias("id"))
    sig = cut(sig)
    keys = F.array(*[F.xxhash64(F.lit(b), F.slice("m", b * rows + 1, rows)) for b in range(bands)])
    k = sig.select("id", F.explode(keys).alias("key"))
    pairs = k.select(F.col("id").alias("a"), "key").join(k.select(F.col("id").alias("b"), "key"), "key").where("a < b").select("a", "b").distinct()
    j = pairs.join(sig.select(F.col("id").alias("a"), F.col("m").alias("x")), "a").join(sig.select(F.col("id").alias("b"), F.col("m").alias("y")), "b")
    same = F.aggregate(F.zip_with("x", "y", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, e: s + e) / HASHES
    return j.select("a", "b", same.alias("similarity")).where(F.col("similarity") >= least)
