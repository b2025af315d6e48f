"""N-gram Jaccard join by MinHash banding with full verification.

1. Each text becomes its set of hashed word five-grams; texts with equal sets form a
   class with a number of its own, represented by one row. Only representatives go
   on, so copies are never paired with each other.
2. Signatures are cut into bands. Rows per band and the number of bands follow from
   the target recall at the threshold. Per band hash the smallest class is found
   with partial aggregates, and links to it form candidate groups (connected
   components), so a crowded band costs one edge per member and not one per pair.
3. The sets of each candidate group meet in blocks of bounded size; every pair of
   blocks is one task, which counts common n-grams by matrix products over the
   n-grams that occur twice, and compares exact Jaccard similarities. A task returns
   link counts and a spanning forest of its links, never the pairs.

Cases: texts of one to four words have their whole word string as their only n-gram;
texts without words (null, empty, white space) have none, link with nothing and are
classes of their own; rows that repeat an id with equal n-grams count as one document;
rows that repeat an id with different texts are different documents, linked as their
texts are, and each row shows what its own text has; a row with a null id is a document
of its own, with a null class and representative unless a row with an id is in its
class; an empty table gives an empty result; very long texts are compared whole; other
columns are neither read nor returned (``keep_one`` returns them unchanged).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, WORDS, WordHashes, cut_lineage, mix64, narrow, record_batch, shuffle_width
from .components import components

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: n-grams and sets of one block of a candidate group.
BLOCK_GRAMS, BLOCK_SETS = 600_000, 1500
_PRIME_BASE = np.uint64(0x9E3779B97F4A7C15)
_HASHES = WordHashes()


def bands_for(threshold: float, recall: float, rows: int = 4) -> tuple[int, int]:
    """(bands, rows): enough bands of ``rows`` rows that a pair at the threshold meets in one with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


def grams(text: str, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a whole text (lower-cased words)."""
    h = np.array([_HASHES[w] for w in WORDS.findall(text.lower())], np.uint64)
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix64(out + h[i : len(h) - n + 1 + i] + np.uint64((i + 1) * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
    return np.unique(out)


def minhash(g: np.ndarray, k: int) -> np.ndarray:
    """k minima of the set under k fixed mixes."""
    seeds = mix64(np.arange(1, k + 1, dtype=np.uint64) * GOLDEN)
    best = np.full(k, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(g), 2048):
        part = g[a : a + 2048]
        for j in range(k):
            x = (part ^ seeds[j]) * _PRIME_BASE
            best[j] = min(best[j], (x ^ (x >> np.uint64(32))).min())
    return best


def digest(g: np.ndarray) -> bytes:
    """Tells n-gram sets apart: size and two 64-bit sums."""
    x = mix64(g)
    return np.array([len(g), np.bitwise_xor.reduce(x), np.add.reduce(mix64(x + GOLDEN))], np.uint64).tobytes()


def row_key(doc_id: Column, text: Column) -> Column:
    """A hash of a row's id and text, for rows with null and repeated ids too."""
    return F.xxhash64(doc_id.cast("long"), text).alias("row")


def signatures(docs: DataFrame, n: int, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, cls, size, bands): a hash of id and text, the digest of the n-gram set, its size and one hash per band (empty without words)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cls, size, keys = [], [], []
            for t in b.column(1).to_pylist():
                g = grams(t or "", n)
                size.append(len(g))
                cls.append(digest(g))
                if len(g):
                    m = minhash(g, bands * rows).reshape(bands, rows)
                    key = np.arange(bands, dtype=np.uint64)
                    for r in range(rows):
                        key = mix64(key * GOLDEN + m[:, r])
                    keys.append(key.view(np.int64))
                else:
                    keys.append(np.zeros(0, np.int64))
            yield record_batch(["doc_id", "row", "cls", "size", "bands"], [b.column(0), b.column(2), cls, size, keys], [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())])

    texts = narrow(docs, id_col, text_col)
    return texts.select("*", row_key(F.col("doc_id"), F.col(text_col))).mapInArrow(run, "doc_id long, row long, cls binary, size long, bands array<long>")


def _forest(pairs: tuple[np.ndarray, np.ndarray], n: int) -> list[tuple[int, int]]:
    """A spanning forest of the given pairs of 0..n-1."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(pairs[0].tolist(), pairs[1].tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def link_block(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs whose exact Jaccard similarity reaches the threshold; right None: left with itself."""
    sets = left if right is None else left + right
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, gram, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[gram] > 1
    gram, owner = gram[keep], owner[keep]
    number = np.cumsum(count > 1) - 1
    gram = number[gram]
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    a, b = len(left), len(sets) - len(left) if right is not None else len(left)
    common = np.zeros((a, b), np.float32)
    total, width = int(gram[-1]) + 1 if len(gram) else 0, 2048
    for x in range(0, total, width):
        lo, hi = np.searchsorted(gram, [x, x + width])
        m = np.zeros((len(sets), min(width, total - x)), np.float32)
        m[owner[lo:hi], gram[lo:hi] - x] = 1
        common += m[:a] @ (m[:a] if right is None else m[a:]).T
    sa, sb = size[:a, None], (size[:a] if right is None else size[a:])[None, :]
    hit = common >= threshold * (sa + sb - common) - 1e-6
    if right is None:
        np.fill_diagonal(hit, False)
    return hit


def ngram_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (smallest id in its component), rep_id (of its equal sets), n_links (documents linked directly)."""
    bands, rows = bands_for(threshold, recall)
    sig = cut_lineage(signatures(docs, n, bands, rows, id_col, text_col))
    named = F.countDistinct("doc_id") + F.count(F.when(F.col("doc_id").isNull(), 1))
    classes = sig.where("size > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("row").alias("row"), named.alias("members"), F.max("size").alias("size"), F.first("bands").alias("bands"))
    # The checkpoint fixes the numbers.
    classes = cut_lineage(classes.withColumn("node", F.monotonically_increasing_id()))
    keyed = classes.select("node", F.explode("bands").alias("key"))
    least = keyed.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "a")
    edges = keyed.join(least, "key").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    group = components(edges).select("node", F.col("component").alias("grp"))
    group = cut_lineage(group.join(classes.select("node", "row", "cls", "members", "size"), "node"))
    # Blocks of bounded size: members are dealt to them by a hash of their id.
    plan = group.groupBy("grp").agg(F.sum("size").alias("g"), F.count(F.lit(1)).alias("c"))
    plan = plan.select(F.col("grp").alias("pg"), F.greatest(F.ceil(F.col("g") / BLOCK_GRAMS), F.ceil(F.col("c") / BLOCK_SETS)).cast("int").alias("nb"))
    placed = group.join(plan, F.col("grp") == F.col("pg")).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    placed = placed.select(F.col("row").alias("p_row"), "cls", "node", "grp", "members", "blk", "nb")

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "grp", "members", "blk", "nb"]
        for b in it:
            col = {c: b.column(b.schema.get_field_index(c)) for c in (*names, "x", "cls")}
            g = [grams(t or "", n) for t in col["x"].to_pylist()]
            same = np.array([digest(v) == c for v, c in zip(g, col["cls"].to_pylist(), strict=True)], bool)  # the row key is only a hash
            yield pa.RecordBatch.from_arrays([*[col[c] for c in names], pa.array([v.tobytes() for v in g], pa.binary())], names=[*names, "g"]).filter(pa.array(same))

    texts = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("t_row"), F.col(text_col).alias("x"))
    loaded = texts.join(placed, F.col("t_row") == F.col("p_row")).dropDuplicates(["t_row", "node"])
    loaded = loaded.select("x", "cls", "node", "grp", "members", "blk", "nb").mapInArrow(sets, "node long, grp long, members long, blk int, nb int, g binary")
    # One copy of a set for each block that its own block meets (itself included).
    met = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.least(j, F.col("blk")).alias("i"), F.greatest(j, F.col("blk")).alias("j")))
    # Small groups share a task; a group of several blocks spreads over as many tasks as it has pairs of blocks.
    tasks = max(64, 4 * shuffle_width(docs.sparkSession))
    dealt = loaded.withColumn("p", F.explode(met)).withColumn("task", F.pmod(F.xxhash64("grp", "p.i", "p.j"), F.lit(tasks)))
    dealt = dealt.select("task", "grp", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "blk", "node", "members", "g")

    def verify(t: pa.Table) -> pa.Table:
        t = t.sort_by([("grp", "ascending"), ("i", "ascending"), ("j", "ascending"), ("blk", "ascending"), ("node", "ascending")])
        key = np.stack([t.column(c).to_numpy() for c in ("grp", "i", "j")])
        cut = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
        ids, members, blk = (t.column(c).to_numpy() for c in ("node", "members", "blk"))
        g = t.column("g")
        out: tuple[list, list, list] = ([], [], [])
        for x, y in zip(cut, np.append(cut[1:], t.num_rows), strict=True):
            i, j = key[1, x], key[2, x]
            own = [np.frombuffer(v, np.uint64) for v in g.slice(x, y - x).to_pylist()]
            own_ids, own_m, own_b = ids[x:y], members[x:y], blk[x:y]
            k = len(own) if i == j else int((own_b == i).sum())
            if not k or k == len(own) and i != j:
                continue
            hit = link_block(own[:k], None if i == j else own[k:], threshold)
            r, c = np.nonzero(np.triu(hit) if i == j else hit)
            c = c + (0 if i == j else k)
            if i == j:
                links = hit @ own_m
            else:
                links = np.concatenate([hit @ own_m[k:], hit.T @ own_m[:k]])
            some = np.flatnonzero(links)
            for v in some.tolist():
                out[0].append(own_ids[v]), out[1].append(None), out[2].append(links[v])
            for a, b in _forest((r, c), len(own)):
                out[0].append(own_ids[a]), out[1].append(own_ids[b]), out[2].append(0)
        return pa.table([pa.array(v, pa.int64()) for v in out], names=["a", "b", "links"])

    found = cut_lineage(dealt.groupBy("task").applyInArrow(verify, "a long, b long, links long"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("l_node")).agg(F.sum("links").alias("links"))
    comp = components(found.where("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("c_node"), "component")
    known = classes.select("cls", "node", "rep", "members").join(links, F.col("node") == F.col("l_node"), "left").join(comp, F.col("node") == F.col("c_node"), "left")
    # A component is told by the smallest id in it.
    name = known.where("component IS NOT NULL").groupBy(F.col("component").alias("n_component")).agg(F.min("rep").alias("smallest"))
    known = known.join(name, F.col("component") == F.col("n_component"), "left")
    known = known.select(F.col("cls").alias("k_cls"), "rep", F.coalesce("smallest", "rep").alias("class_id"), (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    own = sig.select("doc_id", F.when(F.col("size") > 0, F.col("cls")).alias("cls"))
    out = own.join(known, own.cls == known.k_cls, "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("rep", "doc_id").alias("rep_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of each component's smallest id, all columns as they are; rows with a null id stay."""
    kept = ngram_join(docs, id_col=id_col, text_col=text_col, **options).where("doc_id IS NULL OR doc_id = class_id").select(F.col("doc_id").alias("kept_id")).distinct()
    # One column for the whole row, so that no name of the input can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"))
    return rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id"))).select("row.*")
