"""Lexical retrieval packing with a sharded BM25 inverted index.

Documents become token ids plus an end id. Every whole window of a document is a
sequence of its own; what remains (less than a window) is packed in rounds:

1. Document frequencies, document count and mean length come from the whole corpus
   (one number per vocabulary entry reaches the driver).
2. A document is routed by its content: its heaviest BM25 terms, in order, are a sort
   key, so that documents that share them are neighbours in a distributed range
   sort. Along that order shards are cut by tokens; each is one inverted index over
   whole texts. A crowded term is cut further by the next terms, equal documents by
   a hash of their rows, so no shard and no partition depends on one hot key.
3. In a shard the longest unused document is the seed. All its terms are scored
   against all unused documents of the shard, which fill its window in order of
   score; the last one is cut at the window's end and its rest stays unused.
4. In all rounds but the last only documents count that reach ``near`` of the seed's
   score with itself. A seed that cannot fill its window with them waits, and the
   next round routes what is left by other terms (the smallest hashes of the heaviest
   terms). The last round takes neighbours in order of score without that bound;
   what a shard leaves goes on to the next shard of its partition, and the end of a
   partition is split into sequences whose lengths are powers of two, which need no
   padding.

A neighbour is found if it shares a shard with its seed in one of the rounds; work and
shuffle are in proportion to the input, the memory of a task is bounded by
``shard_tokens`` and ``shard_rows``.

Cases: null or empty text gives one piece with the end id alone; rows are packed as
rows, so that null and repeated ids and repeated rows keep their pieces apart and each
is packed as often as it occurs; a very long text gives its whole windows, and at most
one count per vocabulary entry goes into an index; ties of score go to the row that
comes first in the sort; an empty table gives an empty result; other columns of the
input are neither read nor returned.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, cut_lineage, mix64, narrow, record_batch, written
from .token_counts import byte_alphabet

#: Terms of a routing key, and the heaviest terms it is drawn from in a round of hashes.
KEY_TERMS, HEAVIEST = 4, 8
#: Postings that are added up at once.
AT_ONCE = 1 << 20
#: Seeds that are scored at once.
BLOCK = 128
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, round long"
#: Texts of these characters alone take the short way below: printable ASCII, line feeds and Latin-1 letters, all in composed form.
_PLAIN = re.compile(r"[\n\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
# The pre-tokenizer's pattern over lower-cased characters of that range.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^ \na-z0-9\xdf-\xf6\xf8-\xff]+")


class Memo(dict):
    """Text -> bytes, made once; emptied at its bound."""

    def __init__(self, make: Callable[[str], bytes], bound: int) -> None:
        super().__init__()
        self.make, self.bound = make, bound

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.bound:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Ids:
    """Text -> little-endian ids, through memos of chunks and their parts.

    The tokenizer drops white space and no token spans it, so the ids of a text are
    those of its chunks between white space in order. A new chunk of a plain text is
    lower-cased and cut by the pre-tokenizer's pattern, and its parts go to the
    tokenizer's model itself; chunks of other texts go through the whole tokenizer.
    """

    def __init__(self, path: str, bound: int = 500_000) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.model = self.tok.model
        self.alphabet = byte_alphabet()
        self.as_bytes = [i.to_bytes(self.type.itemsize, "little") for i in range(self.tok.get_vocab_size())]
        self.parts, self.whole = Memo(self._part, bound // 10), Memo(self._whole, bound // 10)
        self.chunks = Memo(self._chunk, bound)
        self.short_way = self._agrees()

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else "".join([self.alphabet[b] for b in part.encode()])
        return b"".join([self.as_bytes[t.id] for t in self.model.tokenize(shown)])

    def _chunk(self, chunk: str) -> bytes:
        # Letters alone are one part, and a mark after them another, as the pattern would cut them.
        if chunk.isalpha():
            return self._part(chunk)
        if chunk[:-1].isalpha() and not chunk[-1].isalnum():
            return self._part(chunk[:-1]) + self.parts[chunk[-1]]
        return b"".join(map(self.parts.__getitem__, _PARTS.findall(chunk)))

    def _whole(self, chunk: str) -> bytes:
        return np.array(self.tok.encode(chunk, add_special_tokens=False).ids, self.type).tobytes()

    def _agrees(self) -> bool:
        """Whether the short way gives this tokenizer's ids for a probe of every plain character in several settings."""
        plain = [*map(chr, range(0x21, 0x7F)), *(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))]
        probes = [x for c in plain for x in (c, f"a{c}b", f"{c}{c}1", f"\u00c9{c}'s {c}\n")]
        return all(b"".join(map(self.chunks.__getitem__, x.lower().split())) == b"".join(map(self.whole.__getitem__, x.split())) for x in probes)

    def ids(self, text: str) -> np.ndarray:
        if self.short_way and _PLAIN.fullmatch(text) and "<|" not in text:
            found = map(self.chunks.__getitem__, text.lower().split())
        else:
            found = map(self.whole.__getitem__, text.replace("\n", " ").split(" "))
        return np.frombuffer(b"".join(found), self.type)


_IDS: dict[str, Ids] = {}


def tokenizer(path: str) -> Ids:
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def postings(tails: list[bytes], extras: list[bytes], kind: np.dtype, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, term, count) of each row's whole text, by owner and term; extras hold pairs (term, count) of its whole windows."""
    ids = np.frombuffer(b"".join(tails), kind)
    size = np.array([len(t) for t in tails], np.int64) // kind.itemsize
    bits = vocabulary.bit_length()
    wide = np.uint32 if len(tails) << bits <= 1 << 32 else np.uint64
    row = np.arange(len(tails), dtype=wide) << wide(bits)
    key = np.repeat(row, size) | ids
    key.sort()
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    key, count = key[cut], np.diff(np.append(cut, len(key)))
    if any(extras):
        pairs = np.frombuffer(b"".join(extras), "<u4").reshape(-1, 2)
        size = np.array([len(e) for e in extras], np.int64) // 8
        more = np.repeat(row, size) | pairs[:, 0].astype(wide)
        key, back = np.unique(np.concatenate([key, more]), return_inverse=True)
        count = np.bincount(back, np.concatenate([count, pairs[:, 1]]), len(key)).astype(np.int64)
    return (key >> wide(bits)).astype(np.int32), (key & wide((1 << bits) - 1)).astype(np.int32), count


def heaviest(owner: np.ndarray, term: np.ndarray, impact: np.ndarray, rows: int, vocabulary: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, place, term) of each row's k terms of most impact; ties go to the smaller term."""
    tb, ob = vocabulary.bit_length(), rows.bit_length()
    # A positive float's bits are in the order of its value; row, falling impact and term make one number to sort.
    fall = (~impact.astype(np.float32).view(np.uint32) & np.uint32(0x7FFFFFFF)) >> np.uint32(max(0, tb + ob + 31 - 64))
    key = owner.astype(np.uint64) << np.uint64(64 - ob) | fall.astype(np.uint64) << np.uint64(tb) | term.astype(np.uint64)
    key.sort()
    own = (key >> np.uint64(64 - ob)).astype(np.int64) if ob else np.zeros(len(key), np.int64)
    place = np.arange(len(key)) - np.searchsorted(own, np.arange(rows))[own]
    keep = place < k
    return own[keep], place[keep], (key[keep] & np.uint64((1 << tb) - 1)).astype(np.int64)


class Scale:
    """Corpus statistics: inverse document frequencies, mean length and the two BM25 parameters."""

    def __init__(self, idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75) -> None:
        self.idf, self.mean, self.k1, self.b = idf, max(mean, 1.0), k1, b

    def impact(self, owner: np.ndarray, term: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        norm = self.k1 * (1 - self.b + self.b * length / self.mean)
        return self.idf[term] * count * (self.k1 + 1) / (count + norm[owner])


class Index:
    """Inverted index of one shard: 32-bit postings by term, and a table of the terms that most of its rows have."""

    def __init__(self, owner: np.ndarray, term: np.ndarray, impact: np.ndarray, n: int, often: float = 1 / 16) -> None:
        self.n = n
        df = np.bincount(term, minlength=1)
        common = np.flatnonzero(df > max(often * n, 8))
        self.column = np.full(len(df), -1, np.int32)
        self.column[common] = np.arange(len(common))
        at = self.column[term]
        self.table = np.zeros((len(common), n), np.float32)
        self.table[at[at >= 0], owner[at >= 0]] = impact[at >= 0]
        self.of = term.astype(np.int32)
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
        rare = at < 0
        order = np.argsort(term[rare], kind="stable")
        self.doc, self.weight = owner[rare][order].astype(np.int32), impact[rare][order].astype(np.float32)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(term[rare], minlength=len(df)))])

    def search(self, seeds: np.ndarray) -> np.ndarray:
        """Scores of all rows (columns) for all terms of each seed (rows)."""
        scores = (self.table[:, seeds] > 0).astype(np.float32).T @ self.table
        length = self.begin[seeds + 1] - self.begin[seeds]
        t, q = self.of[_ranges(self.begin[seeds], length)], np.repeat(np.arange(len(seeds)), length)
        t, q = t[self.column[t] < 0], q[self.column[t] < 0]
        size = self.start[t + 1] - self.start[t]
        upto, a = np.cumsum(size), 0
        while a < len(t):  # so many postings at once; a posting list is shorter than that
            z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + AT_ONCE, side="right")))
            x = _ranges(self.start[t[a:z]], size[a:z])
            first = int(q[a])
            scores[first : q[z - 1] + 1] += np.bincount(
                np.repeat((q[a:z] - first) * self.n, size[a:z]) + self.doc[x], self.weight[x], (int(q[z - 1]) + 1 - first) * self.n
            ).reshape(-1, self.n)
            a = z
        return scores


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def fill_windows(index: Index, left: np.ndarray, window: int, near: float | None) -> list[list[tuple[int, int]]]:
    """Full windows as lists of (row, length); ``left`` (unused tokens of each row) is updated.

    The longest unused row is the seed. With ``near`` only rows that reach that share of the
    seed's score with itself follow it; without, all rows by score, and those that share
    nothing with it last.
    """
    out: list[list[tuple[int, int]]] = []
    seeds, block = np.argsort(-left, kind="stable"), BLOCK if near is not None else 8
    while len(seeds := seeds[left[seeds] > 0]) and left.sum() >= window:
        some, seeds = seeds[:block], seeds[block:]
        scores = index.search(some)
        if near is None:
            bound = np.zeros(len(some))
            full = np.ones(len(some), bool)
        else:
            bound = near * scores[np.arange(len(some)), some]
            full = (scores >= bound[:, None]) @ left >= window  # others have too few neighbours now, and later still fewer
        for q in np.flatnonzero(full).tolist():
            seed, score = int(some[q]), scores[q]
            if not left[seed]:
                continue
            found = np.flatnonzero((left > 0) & (score >= bound[q]))
            found = found[found != seed]
            if len(found) > window:  # no window holds more rows
                found = np.sort(found[np.argpartition(-score[found], window)[:window]])
            found = found[np.argsort(-score[found], kind="stable")]
            upto = np.cumsum(left[found]) + left[seed]
            if (upto[-1] if len(found) else left[seed]) < window:
                continue
            k = int(np.searchsorted(upto, window))
            rows = [(seed, int(left[seed])), *((i, int(left[i])) for i in found[:k].tolist())]
            if (rest := window - sum(n for _, n in rows)) > 0:
                rows.append((int(found[k]), rest))
            for i, n in rows:
                left[i] -= n
            out.append(rows)
    return out


def split_rest(left: np.ndarray, window: int) -> list[list[tuple[int, int]]]:
    """What is left (less than a window) as sequences whose lengths are powers of two; ``left`` is updated."""
    out, rest = [], int(left.sum())
    todo = np.flatnonzero(left).tolist()
    for bit in range(window.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            rows, filled = [], 0
            while filled < 1 << bit:
                n = min(int(left[todo[0]]), (1 << bit) - filled)
                rows.append((todo[0], n))
                left[todo[0]] -= n
                filled += n
                if not left[todo[0]]:
                    todo.pop(0)
            out.append(rows)
    return out


class Shard:
    """Rows in the order of the sort, until a bound of tokens."""

    def __init__(self, kind: np.dtype, scale: Scale, window: int) -> None:
        self.kind, self.scale, self.window = kind, scale, window
        self.rows: list[tuple] = []
        self.weight = 0

    def add(self, doc_id: int | None, n: int, tail: bytes, extra: bytes, left: int) -> None:
        self.rows.append((doc_id, n, tail, extra, left))
        self.weight += len(tail) // self.kind.itemsize + len(extra) // 8

    def pack(self, near: float | None, end: bool) -> tuple[list[list[tuple]], list[tuple]]:
        """(sequences as lists of pieces (doc_id, start, length, crc, n), rows that are left); the shard is empty afterwards."""
        rows, self.rows, self.weight = self.rows, [], 0
        left = np.array([r[4] for r in rows], np.int64)
        tails, extras = [r[2] for r in rows], [r[3] for r in rows]
        windows = []
        if near is not None or left.sum() >= self.window:
            owner, term, count = postings(tails, extras, self.kind, len(self.scale.idf))
            impact = self.scale.impact(owner, term, count, np.array([r[1] for r in rows], float))
            windows = fill_windows(Index(owner, term, impact, len(rows)), left, self.window, near)
        if end:
            windows += split_rest(left, self.window)
        at = np.array([r[4] for r in rows], np.int64)  # tokens not yet cut off
        out = []
        for w in windows:
            cut = []
            for i, n in w:
                doc_id, size, tail = rows[i][:3]
                ids = np.frombuffer(tail, self.kind)
                a = len(ids) - int(at[i])
                cut.append((doc_id, size - int(at[i]), n, crc(ids[a : a + n]), size))
                at[i] -= n
            out.append(cut)
        return out, [(*rows[i][:4], int(left[i])) for i in np.flatnonzero(left).tolist()]


def portions(bt: pa.RecordBatch, kind: np.dtype, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` tokens in the column ``tail`` (or one row)."""
    size = np.cumsum(pc.binary_length(bt.column(bt.schema.get_field_index("tail"))).to_numpy(zero_copy_only=False)) // kind.itemsize
    a = 0
    while a < bt.num_rows:
        z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + limit, side="right")))
        yield bt.slice(a, z - a)
        a = z


def _batch(names: list[str], rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    return record_batch(names, list(zip(*rows, strict=True)) if rows else [[]] * len(names), types)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = 4096, shard_tokens: int = 1 << 19, shard_rows: int = 4096, rounds: int = 3, near: float = 0.2, k1: float = 1.2, b: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; see SCHEMA, whose ``round`` is 0 for whole windows. ``window`` is a power of two."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    spark = docs.sparkSession

    tok = tokenizer(tokenizer_path)
    kind, vocabulary = tok.type, max(tok.tok.get_vocab_size(), end_id + 1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Encoded rows, and one row of ``n`` -1 whose ``extra`` holds pairs (term, documents of this task that have it)."""
        tok = tokenizer(tokenizer_path)
        fields, types = ["doc_id", "n", "tail", "extra", "crcs"], [pa.int64(), pa.int64(), *[pa.binary()] * 3]
        df, rows, tokens = np.zeros(vocabulary, np.int64), 0, 0
        for bt in batches:
            cols: tuple[list, ...] = ([], [], [], [])
            for t in bt.column(1).to_pylist():
                ids = np.append(tok.ids(t or ""), np.array([end_id], tok.type))
                whole = len(ids) // window * window
                crcs = np.array([crc(ids[i : i + window]) for i in range(0, whole, window)], "<u4")
                extra = np.stack(np.unique(ids[:whole].astype("<u4"), return_counts=True), axis=1).astype("<u4") if whole else crcs
                for c, v in zip(cols, (len(ids), ids[whole:].tobytes(), extra.tobytes(), crcs.tobytes()), strict=True):
                    c.append(v)
            done = record_batch(fields, [bt.column(0), *cols], types)
            for some in portions(done, kind):
                df += np.bincount(postings(some.column(2).to_pylist(), some.column(3).to_pylist(), kind, vocabulary)[1], minlength=vocabulary)
            rows, tokens = rows + len(cols[0]), tokens + sum(cols[0])
            yield done
        t = np.flatnonzero(df)
        pairs = np.stack([np.append(t, [vocabulary, vocabulary + 1]), np.append(df[t], [rows, tokens])], axis=1)
        yield record_batch(fields, [[None], [-1], [b""], [pairs.astype("<i8").tobytes()], [b""]], types)

    both = written(narrow(docs, id_col, text_col).mapInArrow(encode, "doc_id long, n long, tail binary, extra binary, crcs binary"), "packing")
    encoded = both.where("n >= 0")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _IDS.clear()  # the memos of the stage before are not needed in this worker any more
        df = np.zeros(vocabulary + 2, np.int64)
        for bt in batches:
            for x in bt.column(0).to_pylist():
                t, c = np.frombuffer(x, "<i8").reshape(-1, 2).T
                df[t] += c
        t = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(df[t])], names=["t", "c"])

    # At most one row per vocabulary entry, and two more.
    seen = dict(both.where("n < 0").select("extra").mapInArrow(count, "t long, c long").groupBy("t").agg(F.sum("c")).collect())
    total, tokens = seen.pop(vocabulary, 0), seen.pop(vocabulary + 1, 0)
    df = np.zeros(vocabulary)
    df[list(seen)] = list(seen.values())
    held = spark.sparkContext.broadcast(Scale(np.log((total - df + 0.5) / (df + 0.5) + 1), tokens / max(total, 1), k1, b))

    def route(hashed: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bt in (x for y in batches for x in portions(y, kind)):
                owner, term, count = postings(bt.column(2).to_pylist(), bt.column(3).to_pylist(), kind, vocabulary)
                impact = held.value.impact(owner, term, count, bt.column(1).to_numpy().astype(float))
                own, place, t = heaviest(owner, term, impact, bt.num_rows, vocabulary, HEAVIEST if hashed else KEY_TERMS)
                if hashed:
                    order = np.lexsort((mix64(t.astype(np.uint64) * GOLDEN + np.uint64(hashed)), own))
                    t = t[order]  # the places stay
                keys = np.zeros((bt.num_rows, KEY_TERMS), np.int64)
                keys[own[place < KEY_TERMS], place[place < KEY_TERMS]] = t[place < KEY_TERMS] + 1
                key = [pa.array(keys[:, i].astype(np.int32)) for i in range(KEY_TERMS)]
                yield pa.RecordBatch.from_arrays([*bt.columns, *key], names=[*bt.schema.names, *(f"k{i}" for i in range(KEY_TERMS))])

        return run

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [*[pa.int64()] * len(names), pa.binary(), pa.binary(), pa.int64()]

    def shards(number: int, share: float | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sequence = number << 58 | TaskContext.get().partitionId() << 34
            shard = Shard(kind, held.value, window)

            def close(end: bool) -> pa.RecordBatch:
                nonlocal sequence
                out: list[tuple] = []
                done, rest = shard.pack(share, end and share is None)
                for cut in done:
                    offset = 0
                    for doc_id, start, length, value, n in cut:
                        out.append((doc_id, start, length, value, n, sequence, offset, number, None, None, None))
                        offset += length
                    sequence += 1
                for doc_id, n, tail, extra, left in rest:
                    if share is None:
                        shard.rows.append((doc_id, n, tail, extra, left))
                    else:
                        out.append((doc_id, None, None, None, n, None, None, None, tail, extra, left))
                return _batch([*names, "tail", "extra", "left"], out, kinds)

            for bt in batches:
                whole: list[tuple] = []
                for doc_id, n, tail, extra, left, crcs in zip(*(bt.column(bt.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "n", "tail", "extra", "left", "crcs")), strict=True):
                    for i, value in enumerate(np.frombuffer(crcs or b"", "<u4").tolist()):
                        whole.append((doc_id, i * window, window, value, n, sequence, 0, 0, None, None, None))
                        sequence += 1
                    if left:
                        shard.add(doc_id, n, tail, extra, left)
                    if shard.weight >= shard_tokens or len(shard.rows) >= shard_rows + window:
                        yield close(False)
                yield _batch([*names, "tail", "extra", "left"], whole, kinds)
            yield close(True)

        return run

    routed = "doc_id long, n long, tail binary, extra binary, crcs binary, left long"
    keyed = routed + "".join(f", k{i} int" for i in range(KEY_TERMS))
    told = SCHEMA + ", tail binary, extra binary, left long"
    rest = encoded.withColumn("left", (F.length("tail") / kind.itemsize).cast("long"))
    out: DataFrame | None = None
    for number in range(1, rounds + 1):
        final = number == rounds
        order = [*(f"k{i}" for i in range(KEY_TERMS)), F.xxhash64("doc_id", "tail", "n")]
        # By order and not by hash: a key that a third of all rows share is cut by the hash that ends the order.
        keys = rest.mapInArrow(route(0 if number % 2 else number), keyed)
        # A range partition looks at its input twice; the first round routes all tokens, so its keys are kept.
        keys = cut_lineage(keys) if number == 1 else keys
        ranged = keys.repartitionByRange(*order).sortWithinPartitions(*order, "doc_id", "left")
        got = ranged.mapInArrow(shards(number, None if final else near), told)
        got = got if final else cut_lineage(got)
        pieces = got.where("length IS NOT NULL").select(*names)
        out = pieces if out is None else out.unionByName(pieces)
        rest = got.where("length IS NULL").select("doc_id", F.col("doc_tokens").alias("n"), "tail", "extra", F.lit(None).cast("binary").alias("crcs"), "left")
    return out
