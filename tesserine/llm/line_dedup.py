"""Line dedup: windows of three consecutive lines, repeated windows found globally.

Main path: DataFrame expressions only. Each document emits the 128-bit hash of
every window (three lines joined by a line feed); a partial aggregate per hash
finds the first occurrence by (document, position); later occurrences mark the
three lines they cover; marked positions of a document are merged as a set and
their lines removed.

Cases: a null or empty text, or one with fewer than three lines, has no window and
stays as it is (a text counts one line more than its line feeds); a window that repeats within one document counts as a repeat, so
its later occurrences go there too; rows that share an id are told apart by a hash
of their text, and wholly equal rows count as one document that both rows show.
A document whose lines all go keeps a row with an empty text. A null id comes before all
others; very long texts are read whole; an empty table gives an empty result; other
columns are returned unchanged, but for ``n_lines`` and ``n_removed``, which are set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def repeated_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(d, t, gone): per document with repeats, the sorted distinct line positions that later windows cover."""
    base = docs.select(F.col(id_col).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    lines = base.select("d", F.xxhash64("x").alias("t"), F.split("x", "\n", -1).alias("l")).where(F.size("l") >= window)
    hashes = F.transform(
        F.sequence(F.lit(1), F.size("l") - (window - 1)),
        lambda i: F.unhex(F.md5(F.array_join(F.slice("l", i, window), "\n"))),
    )
    wins = lines.select("d", "t", F.posexplode(hashes).alias("p", "h"))
    first = (
        wins.groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "t", "p")).alias("f"))
        .where("n > 1")
        .select("h", F.col("f.d").alias("fd"), F.col("f.t").alias("ft"), F.col("f.p").alias("fp"))
    )
    later = wins.join(first, "h").where(~(F.col("d").eqNullSafe(F.col("fd")) & (F.col("t") == F.col("ft")) & (F.col("p") == F.col("fp"))))
    return (
        later.groupBy("d", "t")
        .agg(F.collect_set("p").alias("ps"))
        .select("d", "t", F.array_sort(F.array_distinct(F.flatten(F.transform("ps", lambda p: F.sequence(p, p + (window - 1)))))).alias("gone"))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The input's rows and columns with repeated lines removed from ``text_col``, plus ``n_lines`` and ``n_removed``."""
    gone = repeated_positions(docs, id_col, text_col, window)
    # The lines travel as an array in the text's place, so that they are split once and looked up in constant time.
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(
        *[docs[c].alias(f"_ld_c{i}") for i, c in enumerate(names) if c != text_col],
        docs[id_col].alias("_ld_d"),
        F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("_ld_t"),
        F.split(docs[text_col], "\n", -1).alias("_ld_l"),
    )
    joined = keyed.join(gone, F.col("_ld_d").eqNullSafe(F.col("d")) & (F.col("_ld_t") == F.col("t")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("_ld_l") - 1), F.col("gone"))
    left = F.when(F.col("gone").isNull(), F.col("_ld_l")).otherwise(F.transform(kept, lambda i: F.col("_ld_l")[i]))
    return joined.select(
        *[F.array_join(left, "\n").alias(c) if c == text_col else F.col(f"_ld_c{i}").alias(c) for i, c in enumerate(names)],
        F.coalesce(F.size("_ld_l"), F.lit(1)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_removed"),
    )
