"""Blind spots of a lens: rows that it places among neighbours which another lens finds unlike them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .lineage import running
from .search import knn_many

#: Fixed steps of severity of a plain difference.
LOW, MEDIUM, HIGH = 0.5, 0.65, 0.8


def differences(vectors: DataFrame, queries: DataFrame, a: int, b: int, width: int, k: int, id_col: str = "vec_id", vec_col: str = "embedding", query_lanes: int = 8) -> DataFrame:
    """(cx_id, own, other, delta): mean similarity of a row's k nearest others in slot ``a``, by that slot and by slot ``b``, and their difference."""
    part = lambda df, s: df.select(F.col(id_col), V.slot(F.col(vec_col), s, width).alias(vec_col))
    near = knn_many(part(vectors, a), part(queries, a), k + 1, id_col, vec_col, query_lanes).where("query_id <> cx_id")
    near = near.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "cx_id"))), 1, k).alias("g"))  # k + 1 at most
    near = near.select("query_id", F.explode("g").alias("n")).select("query_id", F.col("n.cx_id").alias("cx_id"), (-F.col("n.s")).alias("own"))
    x = part(queries, b).select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("x"))
    y = part(vectors, b).select(F.col(id_col).alias("cx_id"), F.col(vec_col).alias("y"))
    met = near.join(y, "cx_id").join(x, "query_id").withColumn("other", V.cosine(F.col("x"), F.col("y"))).where("other IS NOT NULL")
    out = met.groupBy(F.col("query_id").alias("cx_id")).agg(F.avg("own").alias("own"), F.avg("other").alias("other"))
    return out.withColumn("delta", F.col("own") - F.col("other"))


def plain(deltas: DataFrame) -> DataFrame:
    """Alerts of differences of at least a half, with their severity."""
    level = F.when(F.col("delta") >= HIGH, "high").when(F.col("delta") >= MEDIUM, "medium").otherwise("low")
    return deltas.where(F.col("delta") >= LOW).withColumn("severity", level)


def calibrated(deltas: DataFrame, reference: DataFrame, alpha: float = 0.05, least: int = 30) -> DataFrame:
    """Alerts (cx_id, delta, percentile, p_value, severity) of differences that at most a share ``alpha`` of the reference reaches.

    The percentile is the share of reference differences at or below, the p-value the share at or above; both come
    from range sums over the distinct values, so nothing is sorted in one task. Fewer than ``least`` reference rows, or
    a difference that is not finite, are an error.
    """
    if not 0 <= alpha < 1 or least < 1:
        raise ValueError("alpha in [0, 1), least from 1")
    finite = lambda c: F.when(F.isnan(c) | F.col(c).isNull() | (F.abs(F.col(c)) == float("inf")), F.raise_error(F.lit("a difference is not finite")).cast("double")).otherwise(F.col(c))
    n = reference.count()
    if n < least:
        raise ValueError(f"{n} reference differences, {least} needed")
    known = reference.select(finite("delta").alias("delta"), F.lit(1).alias("r"), F.lit(0).alias("own"))
    asked = deltas.select(finite("delta").alias("delta"), F.lit(0).alias("r"), F.lit(1).alias("own"))
    by = known.unionByName(asked).groupBy("delta").agg(F.sum("r").alias("r"), F.max("own").alias("own"))
    place = running(by, "delta", ["r"]).where("own = 1").select("delta", ((F.col("r_before") + F.col("r")) / n).alias("percentile"), ((F.lit(n) - F.col("r_before")) / n).alias("p_value"))
    level = F.when(F.col("percentile") >= 1 - alpha / 3, "high").when(F.col("percentile") >= 1 - 2 * alpha / 3, "medium").otherwise("low")
    return deltas.join(place, "delta").where(F.col("p_value") <= alpha).select("cx_id", "delta", "percentile", "p_value", level.alias("severity"))
