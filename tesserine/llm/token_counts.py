"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into pieces by the pre-tokenizer's pattern; each distinct piece is
merged once per worker: the lowest-rank adjacent pair is popped from a heap, its
two cells of a linked list become one, and the two new neighbour pairs are
pushed. The count of a piece is its bytes minus its merges; no identifiers exist.

Cases: null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated
results; a special string inside a text is one token, as in the library's default;
a null id stays null; very long texts are counted whole; an empty table gives an empty
result; other columns are neither read nor returned.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import narrow, record_batch

# The characters with Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The pre-tokenizer's pattern of the byte-level vocabulary.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
#: Chunks that no piece crosses: an optional space with a run of non-space, or white space as the pattern cuts it.
CHUNKS = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_alphabet() -> list[str]:
    """Byte -> its printable stand-in: printable Latin-1 bytes stand for themselves, the others for 256, 257, ..."""
    out, spare = [], 256
    for b in range(256):
        printable = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        out.append(chr(b if printable else spare))
        spare += not printable
    return out


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left when no adjacent pair has a rank; ties of rank go to the leftmost pair."""
    n = len(symbols)
    if n < 2:
        return n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if j >= n or symbols[i] != pair[0] or symbols[j] != pair[1]:
            continue
        symbols[i], symbols[j] = pair[0] + pair[1], ""
        k = after[i] = after[j]
        merges += 1
        if k < n:
            before[k] = i
            new = (symbols[i], symbols[k])
            if new in ranks:
                heapq.heappush(heap, (ranks[new], i, new))
        h = before[i]
        if h >= 0:
            new = (symbols[h], symbols[i])
            if new in ranks:
                heapq.heappush(heap, (ranks[new], h, new))
    return n - merges


class Counter:
    """Counts the tokens of texts; memos of chunks and pieces are emptied at their bounds."""

    def __init__(self, path: str, bound: int = 600_000) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = spec["model"]["merges"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(merges)}
        self.alphabet = byte_alphabet()
        self.pieces = regex.compile(PIECES)
        special = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(special)) if special else None
        count = self.count_chunk

        class Memo(dict):
            def __missing__(self, chunk: str) -> int:
                if len(self) >= bound:
                    self.clear()
                value = self[chunk] = count(chunk)
                return value

        self.memo = Memo()

    def count_chunk(self, chunk: str) -> int:
        alphabet, ranks = self.alphabet, self.ranks
        return sum(merge_count([alphabet[b] for b in p.encode("utf-8")], ranks) for p in self.pieces.findall(chunk))

    def count(self, text: str) -> int:
        get = self.memo.__getitem__
        if self.special is None or not self.special.search(text):
            return sum(map(get, CHUNKS.findall(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(get, CHUNKS.findall(p))) for p in parts)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: bytes, tokens, and whether the tokens exceed ``limit``. One scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer_path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [c.count(t) for t in texts]
            size = [len(t) if t.isascii() else len(t.encode("utf-8")) for t in texts]
            yield record_batch(
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                [b.column(0), size, n, [x > limit for x in n]],
                [pa.int64(), pa.int64(), pa.int64(), pa.bool_()],
            )

    return narrow(docs, id_col, text_col).mapInArrow(run, SCHEMA)
