"""Sharding by proportional stratified interleaving.

Within each source the rows are put into a seeded random order (the MD5 of seed, id
and checksum) and ranked; row r of a source with n rows gets the fraction
(2r - 1) / 2n. All rows are sorted by that fraction, so that every stretch of the
order holds the sources in their proportions, and the order is cut into shards whose
row counts differ by one at most (law ``rows``).

No task holds a source or the whole order: ranks are counted per key range of a source
and positions per cell of fractions, both from prefix sums of counts, and the number of
rows before a cell follows from the sources' sizes alone. Expressions only.

Cases: a null source is a source of its own; null text counts as no bytes; rows with a
null id are ordered by their checksum; equal rows share their places in some order;
equal texts are not kept together, since one group may be larger than a shard; very
long texts are one row like others; an empty table gives an empty result; fewer rows
than shards leave shards empty; other columns travel with their row unchanged, whatever
their names, but may not be called as the two columns that are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

SHARDS = 24
SEED = "shard"
#: Hex digits of the key that name a range of one source: 4096 ranges for each source.
RANGE_DIGITS = 3
#: Cells of the fractions 0 to 1.
CELLS = 4096
#: Bytes that each row adds to its text.
ROW_BYTES = 8


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text and a fixed share for the row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def _places(rows: DataFrame, shards: int) -> DataFrame:
    """(row, source, key) -> with shard and slot."""
    rows = cut_lineage(rows.withColumn("rng", F.substring("key", 1, RANGE_DIGITS)))
    ranges = rows.groupBy("source", "rng").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("source").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    of_source = Window.partitionBy("source")
    ranges = ranges.select(F.col("source").alias("s"), F.col("rng").alias("g"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("off"), F.sum("n").over(of_source).alias("n_source"))
    # Rows of a source of n rows whose fraction lies below cell c; at most CELLS rows are broadcast.
    sources = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("n", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("c"))
    below = F.expr(f"least(n, (2 * n * c + {CELLS - 1}) div {2 * CELLS})")
    cells = sources.groupBy("c").agg(F.sum(below).alias("before"), F.sum("n").alias("n_all"))

    within = Window.partitionBy("source", "rng").orderBy("key")
    ranked = rows.withColumn("r", F.row_number().over(within)).join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("rng") == F.col("g")))
    odd = (F.col("off") + F.col("r")) * 2 - 1
    ranked = ranked.select("row", "source", "key", "rng", (odd / (F.col("n_source") * 2)).alias("fraction"), F.expr(f"(2 * (off + r) - 1) * {CELLS} div (2 * n_source)").alias("cell"))

    order = Window.partitionBy("cell").orderBy("fraction", F.col("source").asc_nulls_last(), "key")
    placed = ranked.withColumn("k", F.row_number().over(order)).join(F.broadcast(cells), F.col("cell") == F.col("c"))
    placed = placed.withColumn("p", F.col("before") + F.col("k") - 1)
    placed = placed.withColumn("shard", F.expr(f"p * {shards} div n_all"))
    # A shard begins at the first position p with p * shards >= shard * n_all.
    return placed.select("row", F.col("shard").cast("int").alias("shard"), F.expr(f"p - (shard * n_all + {shards - 1}) div {shards}").alias("slot"))


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", check: Column | None = None, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """The rows with their shard (0 .. shards - 1) and slot in it (gapless from 0); ``check`` stands for a text that is not carried."""
    taken = {shard_col.lower(), slot_col.lower()} & {c.lower() for c in docs.columns}
    if taken:
        raise ValueError(f"the input has columns named {sorted(taken)}; name others by shard_col and slot_col")
    check = text_crc32(F.col(text_col)) if check is None else check
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string"), check.cast("string")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).alias("source"), key.alias("key"))
    placed = _places(rows, shards)
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("shard").alias(shard_col), F.col("slot").alias(slot_col))


def shard_plan(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; texts are read once and do not travel."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), text_size(F.col(text_col)).alias("size"), text_crc32(F.col(text_col)).alias("text_crc32"))
    return interleave(narrow, shards, seed, "doc_id", "text_crc32", "source", check=F.col("text_crc32")).drop("source")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, rows_per_file: int = 1_000_000, **options) -> None:
    """Folders ``shard=0`` .. of Parquet files; files follow each other by slot and are sorted by it."""
    placed = interleave(docs, shards, **options)
    shard, slot = options.get("shard_col", "shard"), options.get("slot_col", "slot")
    piece = F.floor(F.col(slot) / rows_per_file)
    placed.repartition(shard, piece).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
