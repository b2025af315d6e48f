"""Embeddings by sparse random indexing: weighted terms over signed hashed directions, and one step over a graph.

Vectors are rows (id, v) with all ``DIMS`` components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut, shared_path

DIMS, ENTRIES = 256, 8
#: Terms that are broadcast with their numbers of documents.
SMALL_VOCABULARY = 500_000
#: Terms of two documents or more that are broadcast, 12 bytes each; any other term is of one document.
MOST_SHARED = 8_000_000
#: Documents whose vectors are added up at once.
CHUNK = 1024


def term_weights(docs: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """(id, term, w): term frequency times 1 + ln((N + 1) / (df + 1)), rows of an id in one partition.

    Whole texts are dealt by id once, so that terms are counted where they are; a vocabulary of at most ``SMALL_VOCABULARY``
    terms is broadcast, a larger one meets the terms in a join.
    """
    tf = docs.repartition(id_col).select(F.col(id_col).alias("id"), F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = cut(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    n = docs.count()
    small = df.count() <= SMALL_VOCABULARY
    met = tf.join(F.broadcast(df) if small else df, "term").select("id", "term", (F.col("tf") * (1 + F.ln(F.lit(n + 1.0) / (F.col("df") + 1)))).alias("w"))
    return met if small else met.repartition("id")


def directions(term: Column) -> Column:
    """The ``ENTRIES`` (dim, sign) of a term: three hexadecimal digits of its MD5 each, two for the dimension and one for the sign."""
    h = F.md5(term.cast("binary"))
    one = lambda i: F.struct(
        F.conv(F.substring(h, 3 * i + 1, 2), 16, 10).cast("int").alias("dim"),
        F.when(F.conv(F.substring(h, 3 * i + 3, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0).alias("sign"),
    )
    return F.array(*[one(i) for i in range(ENTRIES)])


def _counts(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some documents' terms: MD5 (12 bytes) of each different one; and (document, term, frequency)."""
    size = np.diff(np.asarray(lists.offsets))
    coded = lists.flatten().dictionary_encode()
    h = b"".join(hashlib.md5(w.encode()).digest()[:12] for w in coded.dictionary.to_pylist())
    n = max(1, len(coded.dictionary))
    pair, tf = np.unique(np.repeat(np.arange(len(size)), size) * n + coded.indices.to_numpy(), return_counts=True)
    return np.frombuffer(h, np.uint8).reshape(-1, 12), pair // n, pair % n, tf


def _key(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h[:, :8]).view("<i8")[:, 0]


def _pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        yield from (b.slice(a, CHUNK) for a in range(0, b.num_rows, CHUNK))


def _listed(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
    """Rows of length one; those of length zero are left out."""
    size = np.sqrt((x * x).sum(axis=1))
    good = size > 0
    v = (x[good] / size[good, None]).reshape(-1)
    return pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) + 1, DIMS, dtype=np.int32)), pa.array(v))], names=["id", "v"])


def _shared(rows: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Sorted keys of the terms of two documents or more and their numbers of documents; None where they are too many."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                h, _, term, _ = _counts(b.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(_key(h)), pa.array(np.bincount(term, minlength=len(h)))], names=["term", "df"])

    df = cut(rows.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).where("df > 1"))
    if df.count() > MOST_SHARED:
        return None
    t = df.select("term", F.col("df").cast("int").alias("df")).toArrow()
    key, n = t.column("term").to_numpy(), t.column("df").to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def embedded(docs: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """(id, v): unit vectors of ``DIMS`` dimensions; documents without terms have none. They are written once to the shared folder.

    Rows of one id are one document. Terms are counted and added up batch by batch where the texts are; only the terms of two
    documents or more are broadcast. Where these are too many, terms meet their numbers of documents in a join.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), terms.alias("terms"))
    if not docs.groupBy(id_col).count().where("count > 1").isEmpty():
        rows = rows.groupBy("id").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    shared, n, path = _shared(rows), docs.count(), shared_path(spark, "embedded")
    if shared is None:
        # The rows of an id lie in one partition, so that directions are added up before anything moves.
        weights = term_weights(docs, id_col, terms)
        one = weights.select("id", "w", F.explode(directions(F.col("term"))).alias("e")).groupBy("id", F.col("e.dim").alias("dim")).agg(F.sum(F.col("w") * F.col("e.sign")).alias("x"))
        m = one.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "x"))).alias("m"))  # at most DIMS entries
        v = m.select("id", F.transform(F.sequence(F.lit(0), F.lit(DIMS - 1)), lambda d: F.coalesce(F.element_at("m", d), F.lit(0.0))).alias("v"))
        found = diffused(v, spark.createDataFrame([], f"src {dict(v.dtypes)['id']}, dst {dict(v.dtypes)['id']}"), 1.0)
    else:
        box = spark.sparkContext.broadcast(shared)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, count = box.value
            for b in _pieces(it):
                h, doc, term, tf = _counts(b.column(1))
                own = _key(h)
                df = np.ones(len(h))
                if len(key):
                    at = np.minimum(np.searchsorted(key, own), len(key) - 1)
                    df = np.where(key[at] == own, count[at], 1)
                w = tf * (1 + np.log((n + 1.0) / (df + 1)))[term]
                digits = np.stack([h >> 4, h & 15], axis=2).reshape(len(h), 24).astype(np.int64)
                x = np.zeros(b.num_rows * DIMS)
                for i in range(ENTRIES):
                    dim, sign = 16 * digits[:, 3 * i] + digits[:, 3 * i + 1], 1.0 - 2 * (digits[:, 3 * i + 2] % 2)
                    x += np.bincount(doc * DIMS + dim[term], w * sign[term], len(x))
                yield _listed(b.column(0), x.reshape(-1, DIMS))

        found = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, v array<double>")
    found.where("id IS NOT NULL").write.parquet(path)
    return spark.read.parquet(path)


def diffused(rows: DataFrame, edges: DataFrame, keep: float = 0.7) -> DataFrame:
    """One step over edges (src, dst): ``keep`` of a node's own vector and the rest of its neighbours' mean, scaled to length one again."""
    if not 0 <= keep <= 1:
        raise ValueError("keep lies in [0, 1]")
    e = edges.select("src", "dst").distinct()
    e = e.join(rows.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    n = e.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    share = e.join(n, "src").select(F.col("src"), F.col("dst").alias("id"), (F.lit(1 - keep) / F.col("n")).alias("share"))
    near = rows.join(share, "id").select(F.col("src").alias("id"), "share", "v")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by id; the last id of a batch may go on in the next one."""
        held: tuple | None = None
        for b in it:
            if not b.num_rows:
                continue
            x = np.asarray(b.column(2).flatten()).reshape(-1, DIMS) * b.column(1).to_numpy()[:, None]
            ids = b.column(0)
            if held is not None:
                ids, x = pa.concat_arrays([held[0], ids]), np.concatenate([held[1], x])
            _, code = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            ids, x = ids.take(pa.array(first)), np.add.reduceat(x, first)
            held = ids.slice(len(ids) - 1), x[-1:]
            yield _listed(ids.slice(0, len(ids) - 1), x[:-1])
        if held is not None:
            yield _listed(*held)

    # Dealt by id once; sums and lengths stay in place.
    both = rows.select("id", F.lit(float(keep)).alias("share"), "v").unionByName(near).where("id IS NOT NULL").repartition("id").sortWithinPartitions("id")
    return both.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, v array<double>")


def as_vectors(rows: DataFrame) -> DataFrame:
    """(id, v): whole vectors, for search."""
    return rows.select("id", "v")
