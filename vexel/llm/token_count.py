"""Token counts by byte-pair merging on a heap and a linked list.

A text is split by the vocabulary's pattern, a part into its bytes.  Adjacent pairs that the
vocabulary can merge wait in a heap by rank, then place; the lowest is popped and merged in
the linked list of symbols until none is left.  A part's count is its bytes less its merges;
no identifiers are made.

The usual pattern is split by arrays of character classes, a slice of texts at a time; any
other by its expression.  Parts recur, so a worker keeps counts by a part's 64-bit hash in
a table of fixed size, whose entries may be overwritten; the results do not depend on it.

Defined results: null and empty texts have 0 tokens; every row is counted, repeated or not;
a null id stays null, and ids keep their type; equal ranks merge from the left.  Extra columns
are ignored, whatever their names; of columns whose names differ in case, the exact one is taken.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm.common import Rows, form, lean, read, span_hash, text_slices

#: The rank file, unless the session names another in spark.vexel.vocabulary.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of a worker's table of counts, a power of two.
MEMO = 1 << 21

_U = np.uint64
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


def vocabulary_of(spark: SparkSession) -> str:
    return spark.conf.get("spark.vexel.vocabulary", VOCABULARY)


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def count_merged(part: bytes, ranks: dict[bytes, int]) -> int:
    """Symbols that are left of part when no adjacent pair can be merged."""
    n = len(part)
    if n < 2:
        return n
    get = ranks.get
    # Symbols are spans of part: end[i] is the end of the one that begins at i; rank[i] is that of the pair that begins at i.
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    rank = [get(part[i : i + 2], -1) for i in range(n - 1)]
    heap = [(r << 32) + i for i, r in enumerate(rank) if r >= 0]
    rank.append(-1)
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    left = n
    while heap:
        top = pop(heap)
        i = top & 0xFFFFFFFF
        # A pair whose symbols have changed since it was pushed has another rank.
        if rank[i] != top >> 32:
            continue
        j = end[i]
        k = end[i] = end[j]
        rank[j] = -1
        left -= 1
        if k < n:
            before[k] = i
            r = rank[i] = get(part[i : end[k]], -1)
            if r >= 0:
                push(heap, (r << 32) + i)
        else:
            rank[i] = -1
        h = before[i]
        if h >= 0:
            r = rank[h] = get(part[h:k], -1)
            if r >= 0:
                push(heap, (r << 32) + h)
    return left


def character_classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(len(text), dtype=np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[m.start() : m.end()] = kind
    return np.concatenate([out[:0xD800], np.zeros(0x800, np.uint8), out[0xD800:]])


def split(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts that PATTERN finds in the rows of a slice."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes[:128][np.minimum(data, 127)]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        a, b, c, d = (padded[lead + i] & m for i, m in enumerate((0xFF, 0x3F, 0x3F, 0x3F)))
        point = np.where(a < 0xE0, (a & 0x1F) << 6 | b, np.where(a < 0xF0, (a & 0x0F) << 12 | b << 6 | c, (a & 0x07) << 18 | b << 12 | c << 6 | d))
        k = classes[point]
        for i, least in enumerate((0xC0, 0xC0, 0xE0, 0xF0)):
            some = a >= least
            kind[lead[some] + i] = k[some]
    row_at = np.zeros(n + 1, dtype=bool)
    row_at[offsets] = True
    new = row_at[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(new)
    stop = np.append(start[1:], n)
    what = kind[start]
    begins, ends_row = row_at[start], row_at[stop]
    blank = what == _SPACE
    # The last character of each run of white space, and whether the next part takes it.
    whole = np.flatnonzero((data & 0xC0) != 0x80)
    final = whole[np.searchsorted(whole, stop) - 1]
    taken = blank & ~ends_row & (data[final] == 32)
    first_a, first_b = start.copy(), np.where(blank & ~ends_row, final, stop)
    # A space's own part, or none; other runs have theirs in the first place.
    own = blank & ~ends_row & ~taken
    second_a, second_b = final, np.where(own, stop, final)
    given = np.zeros(len(start), dtype=bool)
    given[1:] = taken[:-1]
    first_a[given] -= 1
    # 's 't 're 've 'm 'll 'd: an apostrophe by itself, before letters.
    lone = np.flatnonzero((what[:-1] == _OTHER) & (stop[:-1] - start[:-1] == 1) & (data[start[:-1]] == 39) & ~given[:-1] & ~begins[1:] & (what[1:] == _LETTER)) if len(start) > 1 else np.zeros(0, np.int64)
    if len(lone):
        x = data[stop[lone]]
        y = np.where(stop[lone] + 1 < stop[lone + 1], data[np.minimum(stop[lone] + 1, n - 1)], 0)
        size = np.where(np.isin(x, list(b"stmd")), 1, np.where(((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108), 2, 0))
        first_b[lone] += size
        first_a[lone + 1] += size
    a = np.column_stack([first_a, second_a]).ravel()
    b = np.column_stack([first_b, second_b]).ravel()
    some = b > a
    return a[some], b[some]


class Counter:
    """Token counts of texts, with a table of counts by part that is kept between calls."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, classes: np.ndarray | None):
        self.ranks, self.classes = ranks, classes
        self.find = regex.compile(pattern).finditer
        self.keys, self.counts = np.zeros(MEMO, dtype=_U), np.zeros(MEMO, dtype=np.int32)

    def _parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.classes is not None:
            return split(data, offsets, self.classes)
        spans = []
        for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
            text = data[a:b].tobytes().decode()
            byte = np.zeros(len(text) + 1, dtype=np.int64)
            np.cumsum([len(c.encode()) for c in text], out=byte[1:])
            spans += [(a + byte[m.start()], a + byte[m.end()]) for m in self.find(text) if m.end() > m.start()]
        found = np.array(spans, dtype=np.int64).reshape(-1, 2)
        return found[:, 0].copy(), found[:, 1].copy()

    def slice_counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each row."""
        a, b = self._parts(data, offsets)
        key = span_hash(data, a, b)
        key[key == 0] = 1
        out = np.empty(len(key), dtype=np.int64)
        mask = _U(len(self.keys) - 1)
        one, two = (key & mask).astype(np.int64), (key >> _U(32) & mask).astype(np.int64)
        hit = self.keys[one] == key
        out[hit] = self.counts[one[hit]]
        rest = np.flatnonzero(~hit)
        there = self.keys[two[rest]] == key[rest]
        out[rest[there]] = self.counts[two[rest[there]]]
        rest = rest[~there]
        if len(rest):
            distinct, at, back = np.unique(key[rest], return_index=True, return_inverse=True)
            at = rest[at]
            raw, ranks = data.tobytes(), self.ranks
            counts = np.array([count_merged(raw[i:j], ranks) for i, j in zip(a[at].tolist(), b[at].tolist())], dtype=np.int64)
            out[rest] = counts[back]
            place = np.where(self.keys[one[at]] == 0, one[at], two[at])
            self.keys[place], self.counts[place] = distinct, counts
        total = np.zeros(len(out) + 1, dtype=np.int64)
        np.cumsum(out, out=total[1:])
        at = np.searchsorted(a, offsets)
        return total[at[1:]] - total[at[:-1]]

    def column(self, text: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        parts = [self.slice_counts(data, offsets) for _, data, offsets in text_slices(text)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


_ready: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens and key (a hash of id and text) of every document. The vocabulary, of a fixed size, is read by the driver and broadcast."""
    rows = Rows(docs)
    vocabulary = vocabulary or vocabulary_of(rows.spark)
    held = rows.spark.sparkContext.broadcast((load_ranks(vocabulary), character_classes() if pattern == PATTERN else None))
    name = f"{vocabulary} {pattern}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ready:
            _ready.clear()
            ranks, classes = held.value
            _ready[name] = Counter(ranks, pattern, classes)
        counter = _ready[name]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter.column(batch.column(1))), batch.column(2)], ["doc_id", "n_tokens", "key"])

    chosen = rows.df.select(rows["doc_id"].alias("doc_id"), rows["text"].alias("text"), F.xxhash64(rows["doc_id"], rows["text"]).alias("key"))
    return chosen.mapInArrow(lean(run), form(doc_id=rows.kind("doc_id"), n_tokens="long", key="long"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(read(spark, sf_dir, "documents")).select("doc_id", "n_tokens")
