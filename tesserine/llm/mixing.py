"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Every row gets a random key, the MD5 of its id and a seed. Within a source the
keys are cut into equal key ranges; sizes are summed per range, ranges are added
up in order, and rows are added up within their range, so no task ever holds a
whole source. A source of size S and target T takes floor(T / S) whole epochs and
cuts one more at exactly floor(T) words.

Cases: a null source is a source of its own and comes last; null and empty texts have
size 0 and are never taken; a source of size 0 has target 0; rows with the same id and
text tie and are ordered by an arbitrary but repeatable hash, equal rows share the
budget between them in some order; rows with a null id have a key
of their text and id instead, so that they spread like others; an empty table gives an empty result; very long texts are counted whole, and the
one at a source's cut keeps its text up to the end of its last word; other columns are
not read, and ``mixed_documents`` returns them unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Hex digits of the key that name its range: 4096 ranges for each source.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> with ``target``: the total shared by weight, each source capped at ``max_epochs`` of itself.

    With sources ordered by cap / weight, those below the water level take their
    cap and the others the level times their weight; the level follows from prefix
    sums, so no rounds of resharing are needed. The work is on one row per source.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1).cast("int"))
    s = sizes.select("source", "source_size", w.cast("long").alias("w"), (F.col("source_size") * max_epochs).alias("cap"))
    ratio = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.select(
        "*",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("wleft"),
    )
    # The first source, in that order, whose cap is not below the level sets the level for itself and all after it.
    level = F.when(F.col("left") * F.col("w") <= F.col("cap") * F.col("wleft"), F.struct("left", "wleft"))
    first = F.first(level, ignorenulls=True).over(ratio.rowsBetween(Window.unboundedPreceding, 0))
    share = F.col("lv.left").cast("double") / F.col("lv.wleft") * F.col("w")
    return s.select("source", "source_size", "cap", "w", first.alias("lv")).select(
        "source", "source_size", F.when(F.col("lv").isNull(), F.col("cap").cast("double")).otherwise(F.least(share, F.col("cap").cast("double"))).alias("target")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words, repeats counted) and the row's ``mix_key``."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))).alias("mix_key"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"),
    ).withColumn("rng", F.substring("mix_key", 1, RANGE_DIGITS))
    ranges = rows.groupBy("source", "rng").agg(F.sum("size").alias("rs"))
    upto = Window.partitionBy("source").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("source", "rng", F.coalesce(F.sum("rs").over(upto), F.lit(0)).alias("off"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("rs").alias("source_size")), weights, max_epochs)
    plan = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select(
        F.col("o.source").alias("ps"), F.col("rng").alias("pr"), "off", "source_size", "target"
    )
    inside = Window.partitionBy("source", "rng").orderBy("mix_key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    r = rows.withColumn("pre", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    j = r.join(plan, F.col("source").eqNullSafe(F.col("ps")) & (F.col("rng") == F.col("pr")))
    budget = F.floor("target").cast("long")
    per = F.greatest(F.col("source_size"), F.lit(1))
    cut = budget - F.floor(budget / per) * per - F.col("off") - F.col("pre")
    taken = F.floor(budget / per) * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), cut))
    return j.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "mix_key", "tie")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row once per whole epoch, and the row at the cut with its first words only."""
    names = docs.columns
    # Equal rows share one plan entry, each with an equal part of what they take together.
    plan = mix(docs, id_col, text_col, source_col, **options).groupBy(F.col("doc_id").alias("plan_id"), F.col("tie").alias("plan_tie"))
    plan = plan.agg(F.max("size").alias("size"), F.floor(F.avg("taken")).cast("long").alias("taken")).where("taken > 0")
    # One column for the whole row, so that no name of the input can clash.
    rows = docs.select(F.struct(*names).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"))
    j = rows.join(plan, F.col("id").eqNullSafe(F.col("plan_id")) & (F.col("tie") == F.col("plan_tie")))
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), F.pmod("taken", "size")
    counts = F.concat(F.array_repeat(F.col("size"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    parts = j.select("row", "size", F.explode(counts).alias("words"))
    # Words with the white space before them, so that what is kept is the text up to the last word's end.
    text = F.col("row")[text_col]
    words = F.regexp_extract_all(text, F.lit(f"[\\x20\\x09-\\x0D]*{WORD_PATTERN}"), F.lit(0))
    head = F.when(F.col("words") == F.col("size"), text).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), ""))
    return parts.select(*[(head if c == text_col else F.col("row")[c]).alias(c) for c in names])
