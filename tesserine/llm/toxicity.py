"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity grades 0 < 1 < ... < K share one weight vector; grade g's threshold c_g
turns the shared score s into P(grade > g) = logistic(s - c_g), and the expected
severity is the sum of these over all thresholds. Features are presence flags of lower-case
words and of their first three and four letters, hashed to 2**20 cells: an insult
weighs the same in a long document as in a short one, and inflected or coined forms
share their stem's cell. Only cells that labelled rows tie to toxicity get a weight
(:func:`select`).

``labels`` say only toxic or not; :func:`grades` sets the severity of the toxic rows
for the fit by how many toxicity-bound cells they show.
The model is fitted on a bounded sample of labelled rows (``max_fit_rows``, chosen
by hash of the id, independent of partitioning); everything else covers all rows.

Cases: null or empty text has no features and gets the model's base severity, which
is far below the cut; repeated rows give repeated results; labels that are null or
whose document is missing are not used; without both kinds of labels, or without a
feature that tells them apart, nothing is rejected (expected severity 0); a null id
stays null and is never fitted on; very long texts are read whole; an empty table gives
an empty result; other columns are not read, and ``keep_clean`` returns them unchanged.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, record_batch

CELLS = 1 << 20
MAX_FIT_ROWS = 8000
SCHEMA = "doc_id long, score double, p_grades array<double>, severity double, rejected boolean"
_LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    return set(_LETTERS.findall(unicodedata.normalize("NFC", text).lower()))


class Cells(dict):
    """Memo word -> its cells; with ``only``, those that carry a weight."""

    def __init__(self, only: np.ndarray | None = None, bound: int = 400_000) -> None:
        super().__init__()
        self.only = None if only is None else set(only.tolist())
        self.bound = bound

    def __missing__(self, word: str) -> tuple[int, ...]:
        import xxhash

        if len(self) >= self.bound:
            self.clear()
        marks = [word, *(f"{word[:n]}\t" for n in (3, 4) if len(word) > n)]
        cells = (xxhash.xxh3_64_intdigest(m.encode("utf-8", "surrogatepass")) % CELLS for m in marks)
        v = self[word] = tuple(c for c in cells if self.only is None or c in self.only)
        return v


def features(text: str, memo: Cells) -> np.ndarray:
    """Sorted distinct cells of a whole text."""
    found: set[int] = set()
    for w in words(text):
        if c := memo[w]:
            found.update(c)
    return np.array(sorted(found), np.int64)


def select(rows: list[np.ndarray], toxic: np.ndarray, z: float = 6.0) -> np.ndarray:
    """Cells that are more frequent among toxic rows, by a two-proportion z test."""
    df = [np.bincount(np.concatenate([r for r, t in zip(rows, toxic, strict=True) if t == k]), minlength=CELLS) for k in (0, 1)]
    n = [int((toxic == k).sum()) for k in (0, 1)]
    p = (df[0] + df[1] + 1) / (sum(n) + 2)
    score = (df[1] / n[1] - df[0] / n[0]) / np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]))
    return np.flatnonzero((score >= min(z, 0.5 * score.max())) & (df[1] >= 2) & (df[1] / n[1] > 8 * df[0] / n[0]))


def grades(rows: list[np.ndarray], toxic: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """0 for clean rows; 1 for toxic rows with at most the median number of bound cells, 2 above it."""
    mark = np.zeros(CELLS, bool)
    mark[bound] = True
    hits = np.array([mark[r].sum() for r in rows])
    return np.where(toxic == 1, 1 + (hits > np.median(hits[toxic == 1])), 0)


class Model:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray) -> None:
        self.weights, self.cuts = weights, cuts
        self.memo = Cells(np.flatnonzero(weights))

    def exceed(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -500, 500)))

    def score(self, texts: list[str]) -> np.ndarray:
        return np.array([self.weights[features(t, self.memo)].sum() for t in texts])


def fit(rows: list[np.ndarray], toxic: np.ndarray, epochs: int = 300, rate: float = 0.3, l2: float = 1e-3) -> Model | None:
    """None if no feature speaks for a toxic text. Full-batch AdaGrad on the cumulative-link likelihood (all thresholds of a row), classes balanced; deterministic."""
    bound = select(rows, toxic)
    if not len(bound):
        return None
    y = grades(rows, toxic, bound)
    k = int(y.max())
    rows = [np.intersect1d(r, bound, assume_unique=True) for r in rows]
    size = np.array([len(r) for r in rows])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), size)
    cells, flat = np.unique(flat, return_inverse=True)
    above = (y[:, None] > np.arange(k)[None, :]).astype(float)
    balance = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    w, cuts = np.zeros(len(cells)), np.arange(1, k + 1).astype(float)
    gw, gc = np.full(len(cells), 1e-8), np.full(k, 1e-8)
    for _ in range(epochs):
        s = np.bincount(owner, np.maximum(w, 0)[flat], len(rows))
        p = 1 / (1 + np.exp(np.clip(cuts[None, :] - s[:, None], -500, 500)))
        d = (p - above) * balance[:, None]
        g = np.bincount(flat, d.sum(axis=1)[owner], len(cells)) + l2 * w
        c = -d.sum(axis=0)
        gw += g * g
        gc += c * c
        w -= rate * g / np.sqrt(gw)
        cuts = np.maximum.accumulate(cuts - rate * c / np.sqrt(gc))  # thresholds stay in order
    weights = np.zeros(CELLS)
    weights[cells] = np.maximum(w, 0)  # bound cells never speak for a clean text
    return Model(weights, cuts)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_fit_rows: int = MAX_FIT_ROWS) -> Model | None:
    """Fit on at most ``max_fit_rows`` labelled rows, those with the smallest hashes of their ids (and, where ids repeat, of their features)."""
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(F.max(label_col).cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64("l_id"), "l_id").limit(max_fit_rows)
    # The sample of ids is bounded by max_fit_rows, so it may be broadcast.
    some = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("x")).join(F.broadcast(ids), F.col("d_id") == F.col("l_id"))

    def shrink(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Cells()
        for b in it:
            f = [features(t or "", memo).astype("<i4").tobytes() for t in b.column(1).to_pylist()]
            yield record_batch(["d_id", "f", "y"], [b.column(0), f, b.column(2)], [pa.int64(), pa.binary(), pa.int32()])

    got = some.select(F.col("d_id").cast("long"), "x", "y").mapInArrow(shrink, "d_id long, f binary, y int").orderBy(F.xxhash64("d_id"), "d_id", "f").limit(max_fit_rows).collect()
    got.sort(key=lambda r: (r[0], r[1]))
    rows, y = [np.frombuffer(r[1], "<i4").astype(np.int64) for r in got], np.array([r[2] for r in got], int)
    if len(set(y.tolist())) < 2:
        return None
    return fit(rows, y)


def score(docs: DataFrame, model: Model | None, cut: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document; ``rejected`` where P(grade > 0) is at least ``cut``. One scan, no shuffle; the model is CELLS numbers."""
    held = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.weights, model.cuts))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None if held.value is None else Model(*held.value)
        for b in it:
            texts = [t or "" for t in b.column(1).to_pylist()]
            s = np.zeros(len(texts)) if m is None else m.score(texts)
            p = np.zeros((len(texts), 1)) if m is None else m.exceed(s)
            yield record_batch(["doc_id", "score", "p_grades", "severity", "rejected"], [b.column(0), s, p.tolist(), p.sum(axis=1), p[:, 0] >= cut], [pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.float64(), pa.bool_()])

    return narrow(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, model: Model | None, cut: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns. One scan, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.weights, model.cuts))
    at = docs.columns.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None if held.value is None else Model(*held.value)
        for b in it:
            if m is None:
                yield b
                continue
            p = m.exceed(m.score([t or "" for t in b.column(at).to_pylist()]))
            yield b.filter(pa.array(p[:, 0] < cut))

    return docs.mapInArrow(run, docs.schema)
