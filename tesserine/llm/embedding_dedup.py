"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance B = 2 - 2c. They are
rotated by a fixed orthogonal matrix and split into low-dimensional blocks; each
block gets a share of B in proportion to its dimensions. A pair within B is within
its share in at least one block, so a range join per block finds every pair: the
block's first coordinate is cut into slabs as wide as the block's radius, and a
vector meets its own slab and the next one. Slabs with many vectors are cut into
chunks, and every pair of chunks is one task, to which a vector goes as it was stored
(single precision if it was); tasks rotate. A pair that passes a block's share (and no
earlier block's, so that it is counted once) is verified by its cosine in double
precision over the original components. Tasks return link counts and a spanning
forest, never the pairs.

Equal vectors under one label form a class with a number of its own, and only one
vector of it goes on.

A slab holds a share of a label that does not shrink with the table, so that the pairs
of chunks, and the copies of a vector that are sent, grow with the number of vectors of
a label over ``CHUNK``.

Cases: null labels, null or zero vectors and vectors with null or non-finite
components link with nothing and are kept; vectors of different lengths never
link; components of any finite size are scaled by a power of two first, so that
squares neither overflow nor vanish; rows that repeat an id with different vectors are
different vectors, each with the links of its own; rows with a null id
link like others, count as vectors linked and are kept only where no id is in their component; an empty table gives an empty result; other columns are neither read nor
returned.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import cut_lineage, shuffle_width
from .components import components
from .ngram_join import _forest

COSINE = 0.93
BLOCK_DIMS = 16
#: Vectors of one chunk of a slab.
CHUNK = 6000
#: Slack for rounding in the filters; the verification has none.
SLACK = 1e-6


@functools.lru_cache(8)
def rotation(dims: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(20240229 + dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, which changes no ratio: the largest component lies between a half and one."""
    _, e = np.frexp(np.abs(v).max(axis=1))
    return np.ldexp(v, -e[:, None])


def block_edges(dims: int, width: int = BLOCK_DIMS) -> list[int]:
    return [*range(0, dims, width), dims] if dims else [0]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block_dims: int = BLOCK_DIMS, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    budget = 2 - 2 * cosine
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    sound = (
        F.col("label").isNotNull() & F.col("v").isNotNull()
        & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))), F.lit(False))
        & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    )
    base = base.withColumn("ok", F.coalesce(sound, F.lit(False)))
    # Equal vectors are one class, told by a 256-bit digest; -0.0 and 0.0 are the same component.
    digest = F.sha2(F.array_join(F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")), ","), 256)
    base = base.withColumn("cls", F.when(F.col("ok"), digest))
    single = isinstance(vectors.schema[vec_col].dataType.elementType, FloatType)
    kind = np.dtype("<f4" if single else "<f8")
    classes = base.where("ok").groupBy("label", "cls").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("members"), F.first("v").alias("v"))
    # The checkpoint fixes the numbers.
    classes = cut_lineage(classes.select("label", "cls", "rep", "members", F.col("v").cast("array<float>" if single else "array<double>").alias("v"), F.monotonically_increasing_id().alias("node")))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each vector and block: its slab."""
        for b in it:
            label, node, members, vec = (b.column(i).to_pylist() for i in range(4))
            rows: list[list] = [[] for _ in range(7)]
            for k in range(len(node)):
                v = np.array(vec[k], kind)
                y = rotated(v[None].astype(np.float64))[0]
                edges = block_edges(len(v), block_dims)
                for n, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                    radius = math.sqrt(budget * (hi - lo) / len(v)) + SLACK
                    for c, value in zip(rows, (label[k], len(v), n, math.floor(y[lo] / radius), node[k], members[k], v.tobytes()), strict=True):
                        c.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["label", "dims", "block", "slab", "node", "members", "v"])

    def rotated(v: np.ndarray) -> np.ndarray:
        v = scaled(v)
        return (v / np.sqrt((v * v).sum(axis=1))[:, None]) @ rotation(v.shape[1]).T

    cells = ["label", "dims", "block"]
    homes = cut_lineage(classes.select("label", "node", "members", "v").mapInArrow(cut, "label string, dims int, block int, slab long, node long, members long, v binary"))
    count = homes.groupBy(*cells, "slab").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("n"))
    own = count.withColumnRenamed("n", "n_own")
    before = count.select(*cells, (F.col("slab") + 1).alias("slab"), F.col("n").alias("n_before"))
    after = count.select(*cells, (F.col("slab") - 1).alias("slab"), F.col("n").alias("n_after"))
    plan = own.join(before, [*cells, "slab"], "left").join(after, [*cells, "slab"], "left")
    dealt = homes.join(plan, [*cells, "slab"]).withColumn("ch", F.pmod(F.xxhash64("node"), F.col("n_own")).cast("int"))
    # Tasks of a slab: (i, j) with i <= j of its own chunks, and (-1 - p, i) of chunk p of the slab before with its chunk i.
    inner = F.transform(F.sequence(F.lit(0), F.col("n_own") - 1), lambda k: F.struct(F.col("slab").alias("s"), F.least(k, F.col("ch")).alias("i"), F.greatest(k, F.col("ch")).alias("j")))
    none = F.array().cast("array<struct<s:bigint,i:int,j:int>>")
    host = F.when(F.col("n_before").isNull(), none).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce("n_before", F.lit(1)) - 1), lambda p: F.struct(F.col("slab").alias("s"), (F.lit(-1) - p).alias("i"), F.col("ch").alias("j"))))
    guest = F.when(F.col("n_after").isNull(), none).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce("n_after", F.lit(1)) - 1), lambda i: F.struct((F.col("slab") + 1).alias("s"), (F.lit(-1) - F.col("ch")).alias("i"), i.alias("j"))))
    tasks = max(64, 4 * shuffle_width(vectors.sparkSession))
    met = dealt.withColumn("t", F.explode(F.concat(inner, host, guest))).select(
        F.pmod(F.xxhash64(*cells, "t"), F.lit(tasks)).alias("task"), *cells, F.col("t.s").alias("s"), F.col("t.i").alias("i"), F.col("t.j").alias("j"),
        (F.col("slab") == F.col("t.s")).alias("home"), "ch", "node", "members", "v",
    )

    def verify(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("label", "dims", "block", "s", "i", "j", "home", "node")])
        lab = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        key = np.stack([lab, *(t.column(c).to_numpy() for c in ("dims", "block", "s", "i", "j"))])
        starts = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
        node, members, ch, home = (t.column(c).to_numpy(zero_copy_only=False) for c in ("node", "members", "ch", "home"))
        cv = t.column("v")
        out: tuple[list, list, list] = ([], [], [])
        for x, z in zip(starts, np.append(starts[1:], t.num_rows), strict=True):
            _, dims, block, _, i, j = key[:, x]
            if i < 0:
                side = home[x:z]  # False: guests of the slab before
            elif i == j:
                side = None
            else:
                side = ch[x:z] == j
            v = scaled(np.frombuffer(b"".join(cv.slice(x, z - x).to_pylist()), kind).reshape(-1, dims).astype(np.float64))
            y = rotated(v)
            a, b = (np.arange(z - x),) * 2 if side is None else (np.flatnonzero(~side), np.flatnonzero(side))
            if not len(a) or not len(b):
                continue
            edges = block_edges(int(dims), block_dims)
            norm = np.sqrt((v * v).sum(axis=1))
            total = np.zeros(z - x, np.int64)
            found_a, found_b = [], []
            for lo in range(0, len(a), 256):
                rows = a[lo : lo + 256]
                p, q = edges[block], edges[block + 1]
                yy = y[:, p:q]
                d2 = (yy[rows] ** 2).sum(axis=1)[:, None] + (yy[b] ** 2).sum(axis=1)[None, :] - 2 * yy[rows] @ yy[b].T
                ok = d2 <= budget * (q - p) / dims + 2 * SLACK
                if side is None:
                    ok &= rows[:, None] < b[None, :]
                r, c = np.nonzero(ok)
                r, c = rows[r], b[c]
                for s in range(0, len(r), 1 << 16):
                    ra, ca = r[s : s + (1 << 16)], c[s : s + (1 << 16)]
                    good = np.einsum("ij,ij->i", v[ra], v[ca]) / (norm[ra] * norm[ca]) >= cosine
                    ra, ca = ra[good], ca[good]
                    # The same differences in every task: a pair counts in the first block whose share it passes.
                    diff = (y[ra] - y[ca]) ** 2
                    fresh = np.ones(len(ra), bool)
                    for n in range(block + 1):
                        p, q = edges[n], edges[n + 1]
                        near = diff[:, p:q].sum(axis=1) <= budget * (q - p) / dims + SLACK
                        fresh &= near if n == block else ~near
                    ra, ca = ra[fresh], ca[fresh]
                    np.add.at(total, ra, members[x:z][ca])
                    np.add.at(total, ca, members[x:z][ra])
                    f = _forest((ra, ca), z - x)
                    found_a += [e[0] for e in f]
                    found_b += [e[1] for e in f]
            ids = node[x:z]
            for k in np.flatnonzero(total).tolist():
                out[0].append(ids[k]), out[1].append(None), out[2].append(total[k])
            for k, m in zip(found_a, found_b, strict=True):
                out[0].append(ids[k]), out[1].append(ids[m]), out[2].append(0)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["a", "b", "links"])

    found = cut_lineage(met.groupBy("task").applyInArrow(verify, "a long, b long, links long"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("l_node")).agg(F.sum("links").alias("links"))
    comp = components(found.where("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("c_node"), "component")
    known = classes.select("label", "cls", "node", "rep", "members").join(links, F.col("node") == F.col("l_node"), "left").join(comp, F.col("node") == F.col("c_node"), "left")
    # A component is told by the smallest id in it.
    name = known.where("component IS NOT NULL").groupBy(F.col("component").alias("n_component")).agg(F.min("rep").alias("smallest"))
    known = known.join(name, F.col("component") == F.col("n_component"), "left")
    known = known.select(F.col("label").alias("k_label"), F.col("cls").alias("k_cls"), F.coalesce("smallest", "rep").alias("component_id"), (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = base.join(known, (F.col("cls") == F.col("k_cls")) & (F.col("label") == F.col("k_label")), "left")
    comp_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), comp_id.eqNullSafe(F.col("vec_id")).alias("kept"))
