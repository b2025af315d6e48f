"""Importance resampling towards a target distribution, on hashed n-gram features.

Equal texts are collapsed by grouping the full text; features are taken once per text
that is left and kept as bucket numbers (two bytes each), a text's bucket counts are
multiplied by how often it occurs, and its weight is joined back to its documents,
where the noise of each document (a Gumbel variate from the hash of its id) is added.
The documents with the highest noisy weights are drawn.

Scores are integers in a range that the bucket count bounds, so that the cut is found
on counts per score and a rank is its score's offset plus the place within one score;
nothing is sorted in one task. A frame of at most ``buckets`` gains is all that reaches
the driver and is sent to the workers.

Cases: a null text has no features and weight 0; a null id counts as the empty string
in the noise and comes last among ties; repeated rows are drawn separately and get
consecutive ranks; equal texts have equal weights; an empty target, or an empty table,
is counted as no features; very long texts are handled whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, record_batch

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = "7"
#: Letters, digits and all beyond ASCII, as UTF-8 bytes.
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """Words in UTF-8; bytes.lower changes A-Z only."""
    return _WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())


def features(w: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every word and of every two consecutive words."""
    crc = zlib.crc32
    h = [*map(crc, w), *[crc(a + b" " + b) for a, b in zip(w, w[1:])]]
    return (np.array(h, np.uint32) % np.uint32(buckets)).astype("<u2")


def _featured(texts: DataFrame, buckets: int) -> DataFrame:
    """(text, copies) -> digest, copies, n_words and the buckets of each text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list[list] = [[], [], [], []]
            for t, m in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                t = t.as_py()
                w = words(t)
                for c, v in zip(out, (hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest(), m, len(w), features(w, buckets).tobytes()), strict=True):
                    c.append(v)
            yield record_batch(["digest", "copies", "n_words", "buckets"], out, [pa.binary(), pa.int64(), pa.int64(), pa.binary()])

    return texts.mapInArrow(run, "digest binary, copies long, n_words long, buckets binary")


def _collapsed(rows: DataFrame, text_col: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(text_col), F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("copies"))


def bucket_counts(featured: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows, copies counted."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in it:
            for m, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n += m * np.bincount(np.frombuffer(x, "<u2"), minlength=buckets)
        at = np.flatnonzero(n)
        yield record_batch(["bucket", "n"], [at, n[at]], [pa.int32(), pa.int64()])

    found = featured.select("copies", "buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in the target and in the corpus."""
    k = len(corpus)
    s, t = float(corpus.sum()), float(target.sum())
    return np.floor(1000 * np.log((target + 1.0) * (s + k) / ((corpus + 1.0) * (t + k)))).astype(np.int64)


def _weighed(featured: DataFrame, gain: np.ndarray) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n, w = [], []
            for x in b.column(2).to_pylist():
                at = np.frombuffer(x, "<u2")
                n.append(len(at))
                w.append(int(gain[at].sum()) // max(1, len(at)))
            yield record_batch(["digest", "n_words", "n_features", "weight"], [b.column(0), b.column(1), n, w], [pa.binary(), pa.int64(), pa.int64(), pa.int64()])

    return featured.select("digest", "n_words", "buckets").mapInArrow(run, "digest binary, n_words long, n_features long, weight long")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Thousandths of a Gumbel variate, from the first 32 bits of a hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def importance(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per document: doc_id, digest of the text, n_words, n_features, weight, score."""
    if not 0 < buckets <= 65_536:
        raise ValueError("bucket numbers take two bytes")
    featured = cut_lineage(_featured(_collapsed(docs, text_col), buckets))
    gain = gains(bucket_counts(featured, buckets), bucket_counts(_featured(_collapsed(target, target_col), buckets), buckets))
    own = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"))
    return own.join(_weighed(featured, gain), "digest").select("doc_id", "digest", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, **options) -> DataFrame:
    """``importance`` with rank: 1, 2, 3 .. for the drawn documents, null for the others."""
    rows = importance(docs, target, **options)
    names = rows.columns
    rows = cut_lineage(rows.withColumn("eligible", F.col("n_words") >= min_words))
    scores = rows.where("eligible").groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # Distinct scores: bounded by the range of gains and of the noise, whatever the number of documents.
    above = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    scores = scores.select(F.col("score").alias("s"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"), F.expr(f"sum(n) over () * {int(percent)} div 100").alias("quota"))
    met = rows.join(F.broadcast(scores.where("before < quota")), F.col("eligible") & (F.col("score") == F.col("s")), "left")
    rest = met.where("s IS NULL").select(*names, F.lit(None).cast("long").alias("rank"))
    # Equal rows become one with a count, so that a hot id is one row of its score's window.
    same = met.where("s IS NOT NULL").groupBy(*names, "before", "quota").agg(F.count(F.lit(1)).alias("m"))
    place = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "digest").rowsBetween(Window.unboundedPreceding, -1)
    same = same.withColumn("at", F.col("before") + F.coalesce(F.sum("m").over(place), F.lit(0)))
    each = same.select(*names, "quota", F.explode(F.sequence(F.col("at") + 1, F.col("at") + F.col("m"))).alias("r"))
    return rest.unionByName(each.select(*names, F.when(F.col("r") <= F.col("quota"), F.col("r")).alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that are drawn, all columns unchanged; of rows with one id and text as many as have a rank."""
    names = docs.columns
    plan = resample(docs, target, id_col=id_col, text_col=text_col, **options).where("rank IS NOT NULL")
    plan = plan.groupBy(F.col("doc_id").alias("i"), F.col("digest").alias("d")).agg(F.count(F.lit(1)).alias("drawn"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("id", "digest").orderBy("id")))
    met = rows.join(plan, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")) & (F.col("k") <= F.col("drawn")))
    return met.select(*[F.col(f"row.`{c}`").alias(c) for c in names])
