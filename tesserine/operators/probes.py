"""Information that features carry about a binary label, by logistic probes on held-out rows, and admission by it."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

# Seeds of the folds, share held out, least signal and most redundancy of a lens.
SEEDS, HOLDOUT = (20_260_612, 7, 101, 2_024, 99_999), 0.2
MIN_BITS, MAX_CORRELATION = 0.05, 0.6
FLOOR = 1e-6


def probe_bits(rows: DataFrame, features: str, label: str, group: str, seeds: tuple[int, ...] = SEEDS, holdout: float = HOLDOUT, strength: float = 0.01) -> DataFrame:
    """(seed, n, bits, accuracy), a row for each seed: entropy of the held-out labels less the probe's cross-entropy there, never below 0.

    A seed hashes groups to folds, so that the rows of a group are never on both sides. Features are an array of finite
    numbers; a fold whose training or held-out rows show one label only is an error.
    """
    data = cut(rows.select(array_to_vector(F.transform(features, lambda x: x.cast("double"))).alias("f"), F.col(label).cast("double").alias("y"), F.col(group).cast("string").alias("g")).where("y IS NOT NULL"))
    out = []
    for seed in seeds:
        held = F.pmod(F.xxhash64("g", F.lit(seed)), F.lit(10_000)) < int(holdout * 10_000)
        train = data.where(~held)
        if train.select("y").distinct().count() < 2:
            raise ValueError(f"seed {seed}: one label only among the training rows")
        model = LogisticRegression(featuresCol="f", labelCol="y", regParam=strength, maxIter=50).fit(train)
        p = F.least(F.greatest(F.element_at(vector_to_array("probability"), 2), F.lit(FLOOR)), F.lit(1 - FLOOR))
        loss = -(F.col("y") * F.log2(p) + (1 - F.col("y")) * F.log2(1 - p))
        n, share, ce, right = model.transform(data.where(held)).agg(F.count(F.lit(1)), F.avg("y"), F.avg(loss), F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()
        if not n or share in (0.0, 1.0):
            raise ValueError(f"seed {seed}: one label only among the held-out rows")
        entropy = -(share * math.log2(share) + (1 - share) * math.log2(1 - share))
        out.append((seed, n, max(0.0, entropy - ce), right))
    return rows.sparkSession.createDataFrame(out, "seed long, n long, bits double, accuracy double")


def reliability(probes: DataFrame) -> DataFrame:
    """(seeds, bits, sigma, low, high, unresolved): the mean over seeds, its dispersion and a 95 % interval; unresolved where the dispersion is no less than the bits."""
    r = probes.agg(F.count(F.lit(1)).alias("seeds"), F.avg("bits").alias("bits"), F.coalesce(F.stddev_samp("bits"), F.lit(0.0)).alias("sigma"))
    half = F.col("sigma") * 1.96 / F.sqrt("seeds")
    return r.withColumns({"low": F.greatest(F.col("bits") - half, F.lit(0.0)), "high": F.col("bits") + half, "unresolved": F.col("sigma") >= F.abs("bits")})


def admitted(evidence: DataFrame, least_seeds: int = 5) -> DataFrame:
    """Lenses (lens, correlation, and the columns of ``reliability``) with ``decision``: too_few_seeds, unresolved, low_signal (the interval ends below the least signal), redundant, or admitted."""
    d = F.when(F.col("seeds") < least_seeds, "too_few_seeds").when(F.col("unresolved"), "unresolved").when(F.col("high") < MIN_BITS, "low_signal")
    return evidence.withColumn("decision", d.when(F.col("correlation") > MAX_CORRELATION, "redundant").otherwise("admitted"))
