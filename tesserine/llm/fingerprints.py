"""Document fingerprints by locally consistent parsing.

A text is a string of code points. On each level runs of one symbol become one
symbol, deterministic coin tossing (the lowest bit in which a symbol differs from
its left neighbour, and that bit's value, three times over) gives small labels,
and local minima of the labels end phrases. A phrase's name is a hash of its
symbols, and the names are the next level's string. Whether a phrase ends somewhere
depends only on a few symbols around it, so equal substrings get the same names in
their interior wherever they stand.

The fingerprint of a text keeps, in each of ``slots`` slots, 16 bits of the
smallest name that falls into it, over all names from level ``from_level`` up (or
the top level reached, for shorter texts); as lowercase hex, 0000 for an empty
slot. The likeness of two fingerprints is the share of equal slots among those
that are not empty in both: an estimate of the Jaccard similarity of their phrases.

Cases: null text counts as empty; an empty text has an all-zero fingerprint, which
is like another empty one (1.0) and unlike any other (0.0); very long texts are
parsed in full; equal texts have equal fingerprints; of a single document the next
document is itself; rows with equal ids follow each other in order of their text, and
rows with a null id come before all others; an empty table gives an empty result;
other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, mix64, record_batch, shuffle_width

SLOTS = 64
FROM_LEVEL = 2
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_BASE = np.uint64(0x100000001B3)
#: Code points handled at a time, but for longer single texts.
CHUNK = 1 << 16
#: Code points of rows that a task holds, but for longer single texts.
RUN = 1 << 21


def _labels(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Three rounds of coin tossing; the first symbol of each text uses its lowest bit."""
    one = np.uint64(1)
    for _ in range(3):
        diff = np.empty_like(x)
        np.bitwise_xor(x[1:], x[:-1], out=diff[1:])
        diff[start] = one
        np.maximum(diff, one, out=diff)  # labels of equal neighbours stay equal
        k = np.bitwise_count((diff & (~diff + one)) - one).astype(np.uint64)
        x = (k << one) | ((x >> k) & one)
    return x


def _next_level(names: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level's names, and where each text starts among them."""
    n = len(names)
    fresh = np.empty(n, bool)
    np.not_equal(names[1:], names[:-1], out=fresh[1:])
    fresh[start] = True
    at = np.flatnonzero(fresh)
    runs = np.diff(np.append(at, n)).astype(np.uint64)
    sym = names[at]
    long = runs > 1
    sym[long] = mix64(sym[long] ^ (runs[long] * GOLDEN))
    start = np.searchsorted(at, start)
    lab = _labels(sym, start)
    m = len(sym)
    cut = np.zeros(m, bool)
    cut[1:-1] = (lab[1:-1] < lab[:-2]) & (lab[1:-1] <= lab[2:])
    after = start + 1  # no phrase of one symbol at a text's start or end
    cut[after[after < m]] = False
    cut[start[1:] - 1] = False
    cut[start] = True
    begin = np.flatnonzero(cut)
    size = np.diff(np.append(begin, m))
    place = (np.arange(m) - np.repeat(begin, size)).astype(np.uint64)
    salted = (sym ^ (sym >> np.uint64(29))) * (_BASE + (place + np.uint64(1)) * GOLDEN)
    value = np.add.reduceat(salted ^ (salted >> np.uint64(32)), begin)
    return mix64(value ^ size.astype(np.uint64)), np.searchsorted(begin, start)


def signatures(texts: list[str], slots: int = SLOTS, from_level: int = FROM_LEVEL) -> np.ndarray:
    """uint16 array of len(texts) x slots."""
    out = np.zeros((len(texts), slots), np.uint16)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    joined = "".join(texts[i] for i in full)
    names = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    size = np.array([len(texts[i]) for i in full])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    owner = np.array(full)
    best = np.full((len(texts), slots), np.iinfo(np.uint64).max, np.uint64)
    level = 0
    while len(owner):
        count = np.diff(np.append(start, len(names)))
        if level >= from_level or (count == 1).any():
            doc = np.repeat(owner, count)
            take = np.ones(len(names), bool) if level >= from_level else np.repeat(count == 1, count)
            h = mix64(names[take] + np.uint64(level * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
            flat = doc[take] * slots + (h % np.uint64(slots)).astype(np.int64)
            np.minimum.at(best.reshape(-1), flat, h)
        more = count > 1
        if not more.any():
            break
        keep = np.repeat(more, count)
        names, owner = names[keep], owner[more]
        start = np.concatenate([[0], np.cumsum(count[more])[:-1]])
        names, start = _next_level(names, start)
        level += 1
    seen = best != np.iinfo(np.uint64).max
    out[seen] = (mix64(best[seen]) % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
    return out


def chunks(texts: list[str], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    used = (a != 0) | (b != 0)
    n = used.sum(axis=1)
    return np.where(n == 0, 1.0, ((a == b) & used).sum(axis=1) / np.maximum(n, 1))


def _hex(sig: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in np.ascontiguousarray(sig.astype(">u2"))]


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _consecutive(docs: DataFrame, id_col: str, text_col: str, rows_per_part: int) -> DataFrame:
    """(part, doc_id, text, guest): parts hold consecutive ids; each also gets the first rows after its own as guests.

    Part bounds are quantiles of the ids, and the first id of each part is found; these
    lists, of one number for each ``rows_per_part`` rows, are all that reaches the driver.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = rows.count()
    parts = max(1, min(-(-n // 1000), max(8 * shuffle_width(docs.sparkSession), -(-n // rows_per_part)))) if rows_per_part > 1000 else max(1, -(-n // rows_per_part))
    bounds: list[int] = []
    if n and parts > 1:
        q = rows.where("doc_id IS NOT NULL").stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)
        bounds = sorted({int(x) for x in q})
    # A null id is the smallest; it shares its part with the smallest ids.
    low = -(1 << 63)

    def numbers(x: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids = x.column(0).fill_null(low).to_numpy(zero_copy_only=False)
        return ids, np.searchsorted(np.array(bounds, np.int64), ids, side="right").astype(np.int64)

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in it:
            yield pa.RecordBatch.from_arrays([pa.array(numbers(x)[1]), x.column(0)], names=["part", "doc_id"])

    # Only ids are read here: the smallest id of each part.
    firsts = {r[0]: r[1] for r in rows.select("doc_id").mapInArrow(part, "part long, doc_id long").groupBy("part").agg(F.min(F.coalesce("doc_id", F.lit(low)))).collect()}
    used = sorted(firsts)
    guests = {firsts[p]: used[i - 1] for i, p in enumerate(used)}  # first id -> the part before it, around the end

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.array(sorted(guests), np.int64)
        for x in it:
            ids, p = numbers(x)
            yield pa.RecordBatch.from_arrays([pa.array(p), x.column(0), x.column(1), pa.array(np.zeros(len(ids), bool))], names=["part", "doc_id", "text", "guest"])
            extra = np.flatnonzero(np.isin(ids, first))
            if len(extra):
                y = x.take(pa.array(extra))
                to = [guests[int(i)] for i in ids[extra]]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), y.column(0), y.column(1), pa.array(np.ones(len(to), bool))], names=["part", "doc_id", "text", "guest"])

    return rows.mapInArrow(deal, "part long, doc_id long, text string, guest boolean")


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, from_level: int = FROM_LEVEL, rows_per_part: int = 100_000) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to the next document's.

    Rows stream through in order of part and id, so that a task holds a run of rows and never a part.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def told(ids: list, texts: list[str], after: str) -> pa.RecordBatch:
        line = [*texts, after]
        new = [edited(t, line[i + 1]) for i, t in enumerate(texts)]
        a = np.concatenate([signatures(line[x:y], slots, from_level) for x, y in chunks(line)])
        e = np.concatenate([signatures(new[x:y], slots, from_level) for x, y in chunks(new)])
        sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]
        return record_batch(names, [ids, [len(t) for t in texts], sha, _hex(a[:-1]), _hex(e), likeness(a[:-1], e), likeness(a[:-1], a[1:])], kinds)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size = 0
        for bt in it:
            for doc_id, text, guest in zip(*(bt.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                # The first guest of a part is what follows its last row; its other guests follow nothing.
                if ids and (guest or size >= RUN):
                    yield told(ids, texts, text)
                    ids, texts, size = [], [], 0
                if not guest:
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(text) + 100

    dealt = _consecutive(docs, id_col, text_col, rows_per_part)
    return dealt.repartition("part").sortWithinPartitions("part", "guest", "doc_id", "text").mapInArrow(run, SCHEMA)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, from_level: int = FROM_LEVEL) -> DataFrame:
    """(doc_id, fingerprint) alone: one scan, no shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [t or "" for t in b.column(1).to_pylist()]
            sig = [signatures(texts[x:y], slots, from_level) for x, y in chunks(texts)]
            yield record_batch(["doc_id", "fingerprint"], [b.column(0), _hex(np.concatenate(sig)) if sig else []], [pa.int64(), pa.string()])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, fingerprint string")
