"""Guards, calibration, ledger and outcome prediction."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import running


def verdict(scores: DataFrame, tau: float, k: int | None = None, required: list[int] | None = None) -> DataFrame:
    """(cx_id, slot, score) -> pass: all slots at tau or above, or at least k of them; a NULL score (zero vector) fails.

    With ``required`` only those slots count, and a cx_id without a row for one of them is an error.
    """
    ok = F.coalesce(F.col("score") >= tau, F.lit(False))
    rows = scores if required is None else scores.where(F.col("slot").isin(required))
    g = rows.groupBy("cx_id").agg(F.count_if(ok).alias("passed"), F.count(F.lit(1)).alias("slots"))
    if required is not None:
        g = scores.select("cx_id").distinct().join(g, "cx_id", "left")
        missing = F.raise_error(F.concat(F.lit("missing slot of "), F.col("cx_id").cast("string"))).cast("long")
        g = g.select("cx_id", F.when(F.coalesce("slots", F.lit(0)) == len(set(required)), F.col("passed")).otherwise(missing).alias("passed"), "slots")
    return g.select("cx_id", "passed", (F.col("passed") >= (F.col("slots") if k is None else F.lit(k))).alias("pass"))


def most_accepts(n: int, target: float, alpha: float) -> int:
    """Most false accepts among n bad scores whose share is at most the target and whose binomial tail is at most alpha; -1 for none."""
    best, tail = -1, 0.0
    for k in range(n):
        tail += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(target) + (n - k) * math.log1p(-target))
        if tail > alpha + 2.220446049250313e-16 or k / n > target + 1.1920928955078125e-07:
            break
        best = k
    return best


def conformal_tau(scores: DataFrame, target_far: float, alpha: float = 0.05, min_bad: int = 50) -> DataFrame:
    """(score, bad) -> one row (tau, false_accepts, false_rejects): the smallest threshold, a bad score or the next
    number above one, at which the share of accepted bad scores and its confidence bound hold; without one, the next
    number above the largest bad score. Fewer than ``min_bad`` bad scores are an error.
    """
    if not (0 <= target_far < 1 and 0 <= alpha <= 1):
        raise ValueError("target_far must be in [0, 1), alpha in [0, 1]")
    by = scores.groupBy(F.col("score").cast("double").alias("score")).agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("g"))
    all_ = by.agg(F.sum("b"), F.sum("g")).first()
    n, good = all_[0] or 0, all_[1] or 0
    if n < min_bad:
        raise ValueError(f"{n} bad scores of at least {min_bad}")
    allowed = max(0, most_accepts(n, target_far, alpha)) if target_far else 0
    # The threshold follows the smallest score above which at most ``allowed`` bad ones lie.
    c = running(by, "score", ["b", "g"]).select("score", (F.lit(n) - F.col("b_before") - F.col("b")).alias("above"), (F.col("g_before") + F.col("g")).alias("missed"), "b")
    r = c.where((F.col("above") <= allowed) & (F.col("b") > 0)).agg(F.min("score"), F.max("above"), F.min("missed")).first()
    return scores.sparkSession.createDataFrame([(math.nextafter(r[0], math.inf), r[1], min(r[2], good))], "tau double, false_accepts long, false_rejects long")


def drift(outcomes: DataFrame, key: str, order: str, failed: str, window: int) -> DataFrame:
    """Share of failures among the last ``window`` outcomes."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(window - 1), 0)
    return outcomes.withColumn("drift", F.avg(F.col(failed).cast("double")).over(w))


def entry_hash(prev: Column, payload: Column) -> Column:
    return F.sha2(F.concat(prev, F.lit("|"), payload), 256)


def chain(entries: DataFrame, by: str) -> DataFrame:
    """(by, seq, payload) -> with prev_hash and entry_hash: one chain per ``by`` in order of seq, from a root of 64 zeros."""

    def run(pdf):
        pdf, prev, at = pdf.sort_values("seq"), [], "0" * 64
        out = []
        for x in pdf["payload"]:
            prev.append(at)
            at = hashlib.sha256(f"{at}|{x}".encode()).hexdigest()
            out.append(at)
        return pdf.assign(prev_hash=prev, entry_hash=out)

    kinds = ", ".join(f"{c} {entries.schema[c].dataType.simpleString()}" for c in entries.columns)
    return entries.groupBy(by).applyInPandas(run, f"{kinds}, prev_hash string, entry_hash string")


def verify_chain(ledger: DataFrame, by: str | None = None) -> DataFrame:
    """(seq, prev_hash, entry_hash, payload) -> rows at which the chain breaks or a sequence number is missing; with ``by`` one chain per value."""
    keys = [] if by is None else [by]
    w = Window.partitionBy(*keys).orderBy("seq")
    checked = ledger.withColumns({"before": F.lag("entry_hash").over(w), "gap": F.col("seq") - F.lag("seq").over(w)})
    broken = (F.col("before").isNotNull() & (F.col("before") != F.col("prev_hash"))) | (F.col("entry_hash") != entry_hash(F.col("prev_hash"), F.col("payload")))
    return checked.select(*keys, "seq", F.when(F.coalesce(F.col("gap"), F.lit(1)) != 1, "corrupt").when(broken, "broken").otherwise("ok").alias("state")).where("state <> 'ok'")


def merkle_level(level: DataFrame) -> DataFrame:
    """(i, h) -> the next level; an odd level repeats its last node."""
    return level.groupBy(F.floor(F.col("i") / 2).alias("i")).agg(F.min_by("h", "i").alias("l"), F.max_by("h", "i").alias("r")).select("i", F.sha2(F.concat(F.lit("node"), "l", "r"), 256).alias("h"))


def merkle_root(entries: DataFrame, n: int) -> DataFrame:
    """(i from 0, entry_hash) -> one row (i, h); the number of levels is log2 n."""
    level = entries.select("i", F.sha2(F.concat(F.lit("leaf"), "entry_hash"), 256).alias("h"))
    while n > 1:
        level, n = merkle_level(level), (n + 1) // 2
    return level


def predict_mode(outcomes: DataFrame, keys: list[str], outcome: str) -> DataFrame:
    """Most frequent outcome per keys (ties by name) with its share."""
    c = outcomes.groupBy(*keys, outcome).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys)
    r = c.withColumns({"k": F.row_number().over(w.orderBy(F.col("c").desc(), F.col(outcome))), "n": F.sum("c").over(w)})
    return r.where("k = 1").select(*keys, F.col(outcome).alias("prediction"), (F.col("c") / F.col("n")).alias("confidence"))


def as_of(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str, value: str) -> DataFrame:
    """Last ``value`` of the same key strictly before the row's time: one sort per key over the union, no range join."""
    u = left.select(F.col(key).alias("k"), F.col(lt).alias("t"), F.lit(None).cast(right.schema[value].dataType).alias("v"), F.lit(0).alias("is_right"), F.struct(*left.columns).alias("row"))
    r = right.select(F.col(key).alias("k"), F.col(rt).alias("t"), F.col(value).alias("v"), F.lit(1).alias("is_right"), F.lit(None).cast(u.schema["row"].dataType).alias("row"))
    w = Window.partitionBy("k").orderBy("t", "is_right", "v").rowsBetween(Window.unboundedPreceding, 0)
    return u.unionByName(r).withColumn("as_of", F.last("v", ignorenulls=True).over(w)).where("is_right = 0").select("row.*", "as_of")
