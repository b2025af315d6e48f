"""Cutting lineage and running sums without a window over all rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Unset, it is a temporary one in local mode and an error on a cluster."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Eager checkpoint in the shared folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def running(by: DataFrame, order: str, sums: list[str], parts: int = 64) -> DataFrame:
    """``by`` (one row for each value of the numeric column ``order``) with ``<c>_before``: the sum of c over smaller values.

    Values are cut into ranges at approximate quantiles; ranges are added up on at most
    ``parts`` rows, and rows within their range, so no task holds all of them.
    """
    by = cut(by)  # read three times
    bounds = sorted(set(by.approxQuantile(order, [i / parts for i in range(1, parts)], 0.25 / parts)))
    cuts = F.lit(bounds).cast("array<double>") if bounds else F.array().cast("array<double>")
    cells = by.withColumn("_range", F.size(F.filter(cuts, lambda x: x <= F.col(order).cast("double"))))
    totals = cells.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most ``parts`` rows
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = cells.join(F.broadcast(totals), "_range")
    return out.select(*by.columns, *[(F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_before") for c in sums])


def with_total(df: DataFrame, **totals) -> DataFrame:
    """Every row with aggregates over all rows (one row, broadcast)."""
    return df.crossJoin(F.broadcast(df.agg(*[v.alias(k) for k, v in totals.items()])))
