"""Model layers: records, key-value, time series, ledgered versions, exact dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPANS = {"1m": 60, "1h": 3600, "1d": 86400}


def range_scan(df: DataFrame, pk: str, start: object, end: object, limit: int) -> DataFrame:
    """Rows with start <= pk < end in order; limit 0 gives none."""
    return df.where((F.col(pk) >= start) & (F.col(pk) < end)).orderBy(pk).limit(limit)


def fk_join(left: DataFrame, right: DataFrame, fk: str, pk: str) -> DataFrame:
    """Every left row, with its referenced row where there is one."""
    if fk not in left.columns:
        raise ValueError(f"no field {fk}")
    return left.join(right, left[fk] == right[pk], "left")


def latest(points: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Last write wins per key."""
    cols = [c for c in points.columns if c not in keys]
    return points.groupBy(*keys).agg(F.max_by(F.struct(*cols), seq).alias("_v")).select(*keys, "_v.*")


def rollup(points: DataFrame, span: str) -> DataFrame:
    """(series, t, val) appended -> count, sum, min, max per series and window; every write counts, also repeated ones."""
    s = SPANS[span]
    return points.groupBy("series", (F.col("t") - F.pmod("t", F.lit(s))).alias("window_start")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("val").alias("total"), F.min("val").alias("low"), F.max("val").alias("high")
    )


def without_tombstones(df: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    return df.join(tombstones.select(key).distinct(), key, "left_anti")


def snapshot(versions: DataFrame, key: str, seq: str, at: int) -> DataFrame:
    """Latest version of each key with seq <= at."""
    return latest(versions.where(F.col(seq) <= at), [key], seq)


def exact_dedup(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Content hash -> smallest id and number of copies; partial aggregates only."""
    return docs.groupBy(F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("content_id")).agg(F.min(id_col).alias("kept_id"), F.count(F.lit(1)).alias("copies"))


def group_split(df: DataFrame, group: str, held_percent: int) -> DataFrame:
    """All rows of a group fall on one side, by a hash of the group."""
    bucket = F.conv(F.substring(F.md5(F.col(group).cast("string")), 1, 8), 16, 10).cast("long") % 100
    return df.withColumn("held_out", bucket < held_percent)
