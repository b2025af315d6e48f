"""Suffix-array dedup by difference-cover blockwise sorting.

A byte goes if a ``span``-byte string that covers it also starts in a document with
a smaller id. All documents' suffixes would not fit any budget, so they are dealt
into blocks that can be decided alone:

* The minimum of the hashes of the k-grams in a window of ``span`` bytes depends on
  the window only. Windows of a text with the same minimum, next to each other, form
  a piece; equal windows anywhere have the same minimum, so a block holds all pieces
  of some minima. Minima that occur in one document only are left out first.
* Equal pieces are one in their group of documents, with the smallest id that has
  them, and one in their block. Where a minimum still has different pieces, the
  suffixes that start at their windows are sorted, one suffix bucket (by leading
  bytes) at a time. Suffixes tied in their first eight bytes are ordered by the
  precomputed ranks of a difference-cover sample: for every two positions some
  shift below the period puts both into the sample. Neighbours in that order that
  share ``span`` bytes are the same string; its smallest document keeps it.

Texts cross the network once, by group of documents; blocks exchange hashes, bit
masks and the pieces that may repeat. Every step handles one group or one block.

Cases: null text counts as empty; texts shorter than ``span`` bytes lose nothing;
equal ids (repeated rows) are not smaller than each other, so neither loses bytes to
the other; a null id counts as the smallest; matches never cross documents, and
strings are judged on the input, not on what is left; an empty table gives an empty
result; very long texts are judged whole; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, shuffle_width

SPAN = 50
GRAM = 26
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
# The period of the cover and residues whose differences give every residue.
PERIOD, COVER = 7, (0, 1, 3)
_U = np.uint64
_BASE = 0x2545F4914F6CDD1D
_LOWEST = -(1 << 63)
DOCS_PER_GROUP = 1000
CHUNK = 1 << 18


def _shift_table() -> np.ndarray:
    """[r1, r2] -> the smallest shift that puts both residues into the cover."""
    inside = [r in COVER for r in range(PERIOD)]
    return np.array([[next(d for d in range(PERIOD) if inside[(a + d) % PERIOD] and inside[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])


SHIFT = _shift_table()
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        n2 = max(n, CHUNK + (1 << 17))
        up, down = np.full(n2, _BASE, _U), np.full(n2, pow(_BASE, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        _POWERS["p"], _POWERS["q"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def minima(data: np.ndarray, span: int = SPAN, gram: int = GRAM) -> np.ndarray:
    """For every window of ``span`` bytes the smallest hash of its k-grams."""
    n = len(data)
    if n < span:
        return np.zeros(0, _U)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[:n], out=total[1:])
    h = mix64((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    width, have = span - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h


class Pieces:
    """The pieces of the texts of one group: their minimum, text, first window and number of windows."""

    def __init__(self, texts: list[bytes], span: int, gram: int) -> None:
        self.texts, self.span = texts, span
        parts: list[tuple[np.ndarray, ...]] = []
        a = 0
        while a < len(texts):
            z, size = a, 0
            while z < len(texts) and (z == a or size + len(texts[z]) <= CHUNK):
                size += len(texts[z])
                z += 1
            data = np.frombuffer(b"".join(texts[a:z]), np.uint8)
            m = minima(data, span, gram)
            length = np.array([len(t) for t in texts[a:z]])
            begin = np.concatenate([[0], np.cumsum(length)[:-1]])
            windows = np.maximum(length - span + 1, 0)
            some = np.flatnonzero(windows)
            if len(some):
                owner = np.repeat(some, windows[some])
                first = np.cumsum(windows[some]) - windows[some]
                inside = np.arange(len(owner)) - np.repeat(first, windows[some])
                h = m[begin[owner] + inside]
                head = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))
                at = np.flatnonzero(head)
                parts.append((h[at], owner[at] + a, inside[at], np.diff(np.append(at, len(h)))))
            a = z
        none = (np.zeros(0, _U), *(np.zeros(0, np.int64),) * 3)
        self.h, self.doc, self.start, self.windows = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else none

    def content(self, i: int) -> bytes:
        s = int(self.start[i])
        return self.texts[int(self.doc[i])][s : s + int(self.windows[i]) + self.span - 1]

    def by_block(self, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct minima in order of block and value, where each block starts, and which occur in several documents."""
        order = np.lexsort((self.doc, self.h, self.h % _U(blocks)))
        h, d = self.h[order], self.doc[order]
        fresh = np.append(True, h[1:] != h[:-1])[: len(h)]
        at = np.flatnonzero(fresh)
        several = np.zeros(len(at), bool)
        if len(at):
            several = np.maximum.reduceat(d, at) != np.minimum.reduceat(d, at)
        return h[at], np.searchsorted((h[at] % _U(blocks)).astype(np.int64), np.arange(blocks + 1)), several


def _six(h: np.ndarray) -> bytes:
    return np.ascontiguousarray((h >> _U(16)).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(b: bytes) -> np.ndarray:
    x = np.zeros((len(b) // 6, 8), np.uint8)
    x[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return x.reshape(-1).view("<u8")


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one big-endian number; the text is continued with zeros."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(_U)
    out = np.zeros(len(text), _U)
    for i in range(8):
        out = (out << _U(8)) | padded[i : i + len(text)]
    return out


def sample_ranks(word: np.ndarray, depth: int) -> np.ndarray:
    """Dense rank, to ``depth`` bytes (or a few more), of the suffix at every position of the difference cover; 0 elsewhere."""
    n = len(word)
    at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    far = np.concatenate([word, np.zeros(depth, _U)])
    keys = [far[at + o] for o in range(0, depth, 8)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(at), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    rank = np.zeros(n + PERIOD, np.int64)
    rank[at[order]] = np.cumsum(new) + 1
    return rank


def sort_suffixes(word: np.ndarray, starts: np.ndarray, depth: int = SPAN, bucket_size: int = 1 << 20) -> Iterator[np.ndarray]:
    """The suffixes at ``starts`` in order to at least ``depth`` bytes, one bucket of leading bytes at a time."""
    rank = sample_ranks(word, depth)
    lead = (word[starts] >> _U(48)).astype(np.int64)
    load = np.cumsum(np.bincount(lead, minlength=1 << 16))
    bucket = ((load - 1).clip(0) // bucket_size)[lead]
    order = np.argsort(bucket, kind="stable")
    for b in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        s = starts[b]
        _, tie = np.unique(word[s], return_inverse=True)
        count = np.bincount(tie)
        place = np.zeros(len(s), np.int64)
        # Ties: an element's place is the number of elements of its tie that come before it, class by class of residues.
        tied = np.flatnonzero(count[tie] > 1)
        residue = s[tied] % PERIOD
        group = [tied[residue == r] for r in range(PERIOD)]
        big = int(rank.max()) + 1
        for r1 in range(PERIOD):
            if not len(group[r1]):
                continue
            for r2 in range(PERIOD):
                if not len(group[r2]):
                    continue
                d = SHIFT[r1, r2]
                mine = tie[group[r1]] * big + rank[s[group[r1]] + d]
                if r1 == r2:
                    o = np.argsort(mine, kind="stable")
                    t = tie[group[r1]][o]
                    before = np.empty(len(o), np.int64)
                    before[o] = np.arange(len(o)) - np.searchsorted(t, t)
                else:
                    theirs = np.sort(tie[group[r2]] * big + rank[s[group[r2]] + d])
                    low = np.searchsorted(theirs, tie[group[r1]] * big)
                    before = np.searchsorted(theirs, mine, side="right" if r2 < r1 else "left") - low
                place[group[r1]] += before
        yield b[np.lexsort((place, tie))]


def repeated_windows(contents: list[bytes], docs: np.ndarray, span: int = SPAN) -> list[np.ndarray | None]:
    """For each piece which of its windows also start in a piece of a smaller document; None for none of them."""
    size = np.array([len(c) for c in contents])
    windows = size - span + 1
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(contents)), windows)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[owner]
    word = words_at(np.frombuffer(b"".join(contents), np.uint8))
    gone = np.zeros(len(starts), bool)
    probes = [*range(0, span - 8, 8), span - 8]
    for order in sort_suffixes(word, starts, span):
        s = starts[order]
        new = np.zeros(len(s), bool)
        new[0] = True
        for o in probes:
            w = word[s + o]
            new[1:] |= w[1:] != w[:-1]
        at = np.flatnonzero(new)
        d = docs[owner[order]]
        least = np.repeat(np.minimum.reduceat(d, at), np.diff(np.append(at, len(s))))
        gone[order] = d > least
    end = np.cumsum(windows)
    some = np.logical_or.reduceat(gone, end - windows)
    return [gone[e - w : e] if s else None for e, w, s in zip(end.tolist(), windows.tolist(), some.tolist(), strict=True)]


def _table(schema: str, rows: list[list]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(rows, fields, strict=True)], names=[n for n, _ in fields])


def dedup_spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM, docs_per_group: int = DOCS_PER_GROUP, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per document; see SCHEMA (with ``kept binary`` after it if ``keep_text``)."""
    groups = max(1, -(-docs.count() // docs_per_group))
    blocks = max(16, 2 * shuffle_width(docs.sparkSession))
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)), F.lit(groups)).alias("grp"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("doc_id"), F.col(id_col).isNull().alias("no_id"),
        F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"),
    )
    by_group = rows.groupBy("grp")

    def load(t: pa.Table) -> tuple[pa.Table, np.ndarray, Pieces]:
        t = t.take(pa.array(np.lexsort((np.array([hash_of(x) for x in t.column("text").to_pylist()], _U), t.column("doc_id").to_numpy())))) if t.num_rows else t
        return t, t.column("doc_id").to_numpy(), Pieces(t.column("text").to_pylist(), span, gram)

    def hash_of(x: bytes) -> int:
        import xxhash

        return xxhash.xxh3_64_intdigest(x)

    s_a = "block int, grp long, items binary, several binary"

    def offer(t: pa.Table) -> pa.Table:
        _, _, p = load(t)
        h, at, several = p.by_block(blocks)
        g = t.column("grp")[0].as_py()
        used = [b for b in range(blocks) if at[b] < at[b + 1]]
        return _table(s_a, [used, [g] * len(used), [_six(h[at[b] : at[b + 1]]) for b in used], [np.packbits(several[at[b] : at[b + 1]]).tobytes() for b in used]])

    s_b = "grp long, block int, mask binary"

    def screen(t: pa.Table) -> pa.Table:
        items = [_from_six(x) for x in t.column("items").to_pylist()]
        size = [len(x) for x in items]
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(t.column("several").to_pylist(), size, strict=True)]).astype(bool)
        _, back, count = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
        hit = count > 1
        np.logical_or.at(hit, back[several], True)
        masks = np.split(hit[back], np.cumsum(size)[:-1])
        return _table(s_b, [t.column("grp").to_pylist(), t.column("block").to_pylist(), [np.packbits(m).tobytes() for m in masks]])

    s_c = "block int, grp long, h binary, doc binary, shared binary, ref binary, size binary, data binary"

    def send(t: pa.Table, reply: pa.Table) -> pa.Table:
        if not t.num_rows or not reply.num_rows:
            return _table(s_c, [[]] * 8)
        _, ids, p = load(t)
        h, at, _ = p.by_block(blocks)
        hot = np.zeros(len(h), bool)
        for b, m in zip(reply.column("block").to_pylist(), reply.column("mask").to_pylist(), strict=True):
            hot[at[b] : at[b + 1]] = np.unpackbits(np.frombuffer(m, np.uint8), count=int(at[b + 1] - at[b]))
        order = np.sort(h[hot])
        pos = np.minimum(np.searchsorted(order, p.h), max(len(order) - 1, 0))
        some = np.flatnonzero(order[pos] == p.h) if len(order) else np.zeros(0, np.int64)
        some = some[np.argsort((p.h[some] % _U(blocks)), kind="stable")]  # within a block by document, which is by id
        first: dict[bytes, int] = {}
        shared: set[int] = set()
        for i in some.tolist():
            j = first.setdefault(p.content(i), i)
            if ids[p.doc[i]] > ids[p.doc[j]]:
                shared.add(j)
        mine = np.fromiter(first.values(), np.int64, len(first))
        content = list(first)
        block = (p.h[mine] % _U(blocks)).astype(np.int64)
        cut = np.searchsorted(block, np.arange(blocks + 1))
        out: list[list] = [[] for _ in range(8)]
        g = t.column("grp")[0].as_py()
        for b in range(blocks):
            x, z = cut[b], cut[b + 1]
            if x < z:
                m = mine[x:z]
                row = (b, g, p.h[m].astype("<u4").tobytes(), ids[p.doc[m]].astype("<i8").tobytes(), bytes(i in shared for i in m.tolist()), m.astype("<u4").tobytes(), np.array([len(c) for c in content[x:z]], "<u4").tobytes(), b"".join(content[x:z]))
                for c, v in zip(out, row, strict=True):
                    c.append(v)
        return _table(s_c, out)

    s_d = "grp long, ref binary, code binary, windows binary, mask binary"

    def decide(t: pa.Table) -> pa.Table:
        get = lambda c, k: np.concatenate([np.frombuffer(x, k) for x in t.column(c).to_pylist()])
        h, doc, shared, ref, size = get("h", "<u4"), get("doc", "<i8"), get("shared", np.uint8), get("ref", "<u4"), get("size", "<u4").astype(np.int64)
        source = np.repeat(np.arange(t.num_rows), [len(x) // 4 for x in t.column("h").to_pylist()])
        data = b"".join(t.column("data").to_pylist())
        end = np.cumsum(size)
        contents = [data[e - n : e] for e, n in zip(end.tolist(), size.tolist(), strict=True)]
        # Classes of equal pieces, and the smallest document of each.
        number: dict[bytes, int] = {}
        cls = np.array([number.setdefault(k, len(number)) for k in contents], np.int64)
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, cls, doc)
        keys = list(number)
        heads = np.zeros(len(keys), np.uint32)
        heads[cls] = h  # a piece's text determines its minimum; minima with the same low bits only share a sort
        _, back, count = np.unique(heads, return_inverse=True, return_counts=True)
        open_ = np.flatnonzero(count[back] > 1)  # minima with different pieces
        masks: dict[int, np.ndarray] = {}
        if len(open_):
            for c, m in zip(open_.tolist(), repeated_windows([keys[c] for c in open_.tolist()], least[open_], span), strict=True):
                if m is not None:
                    masks[c] = m
        code = np.where(doc > least[cls], 1, 0)
        has = np.isin(cls, np.fromiter(masks, np.int64, len(masks)))
        code[(code == 0) & has] = 2
        tell = np.flatnonzero((code > 0) | (shared > 0))
        out: list[list] = [[] for _ in range(5)]
        for s in np.split(tell, np.flatnonzero(np.diff(source[tell])) + 1):
            if len(s):
                bits = [masks[int(cls[i])] for i in s[code[s] == 2]]
                row = (t.column("grp")[int(source[s[0]])].as_py(), ref[s].tobytes(), code[s].astype(np.uint8).tobytes(), np.array([len(b) for b in bits], "<i8").tobytes(), np.packbits(np.concatenate(bits)).tobytes() if bits else b"")
                for c, v in zip(out, row, strict=True):
                    c.append(v)
        return _table(s_d, out)

    schema = SCHEMA + ", kept binary" * keep_text

    def finish(t: pa.Table, reply: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _table(schema, [[]] * (5 + keep_text))
        t, ids, p = load(t)
        texts = p.texts
        length = np.array([len(x) for x in texts])
        base = np.cumsum(length + 1) - length - 1
        whole: list[int] = []
        single: list[np.ndarray] = []

        told: dict[bytes, tuple[int, int, np.ndarray | None]] = {}
        for r, c, n, m in zip(*(reply.column(x).to_pylist() for x in ("ref", "code", "windows", "mask")), strict=True):
            n = np.frombuffer(n, "<i8")
            bits = iter(np.split(np.unpackbits(np.frombuffer(m, np.uint8), count=int(n.sum())).astype(bool), np.cumsum(n)[:-1]) if len(n) else [])
            for i, k in zip(np.frombuffer(r, "<u4").tolist(), c, strict=True):
                told[p.content(i)] = (k, int(ids[p.doc[i]]), next(bits) if k == 2 else None)
        if told:
            refs = np.concatenate([np.frombuffer(r, "<u4") for r in reply.column("ref").to_pylist()]).astype(np.int64)
            order = np.unique(p.h[refs])
            at = np.minimum(np.searchsorted(order, p.h), len(order) - 1)
            for i in np.flatnonzero(order[at] == p.h).tolist():
                if (known := told.get(p.content(i))) is not None:
                    k, least, bits = known
                    if k == 1 or ids[p.doc[i]] > least:
                        whole.append(i)
                    elif k == 2:
                        single.append(np.flatnonzero(bits) + int(base[p.doc[i]] + p.start[i]))
        # +1 where a covered stretch of bytes begins, -1 after its end.
        at = np.array(whole, np.int64)
        begin = base[p.doc[at]] + p.start[at]
        last = begin + p.windows[at] + span - 1
        one = np.concatenate(single) if single else np.zeros(0, np.int64)
        room = int(length.sum()) + len(texts) + 1
        depth = np.bincount(np.concatenate([begin, one]), minlength=room) - np.bincount(np.concatenate([last, one + span]), minlength=room)
        covered = np.cumsum(depth) > 0
        touched = np.zeros(len(texts), bool)
        touched[np.searchsorted(base, np.concatenate([begin, one]), side="right") - 1] = True
        out: list[list] = [[] for _ in range(5 + keep_text)]
        for d, (x, i, none) in enumerate(zip(texts, ids.tolist(), t.column("no_id").to_pylist(), strict=True)):
            spans = removed = 0
            kept = x
            if touched[d]:
                gone = covered[base[d] : base[d] + len(x)]
                spans = int((gone & ~np.append(False, gone[:-1])).sum())
                removed = int(gone.sum())
                kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
            row = (None if none else i, len(x), removed, spans, hashlib.sha256(kept).hexdigest(), kept)
            for c, v in zip(out, row, strict=False):
                c.append(v)
        return _table(schema, out)

    offers = by_group.applyInArrow(offer, s_a)
    replies = offers.groupBy("block").applyInArrow(screen, s_b)
    pieces = by_group.cogroup(replies.groupBy("grp")).applyInArrow(send, s_c)
    verdicts = pieces.groupBy("block").applyInArrow(decide, s_d)
    return by_group.cogroup(verdicts.groupBy("grp")).applyInArrow(finish, schema)
