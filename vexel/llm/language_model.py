"""Language-model scoring: an interpolated modified Kneser-Ney model of word trigrams.

Words are runs of ASCII letters and digits and of characters beyond ASCII, in their case; a
text begins behind two start marks and ends with an end mark, which is an event like a word.
All documents are counted, nothing is pruned, and what is stored grows with the corpus.

Counting.  A worker counts the distinct trigrams of a few megabytes of text and sends them in
compressed blocks, one for each bucket.  The bucket follows from the middle word, so that it holds
all of a context (two words) and all of the continuations of a bigram; a middle word which is more than
its share of the corpus is spread over several buckets by the outer words, and its bigrams
are added up in a second exchange.  The number of buckets follows from the bytes of text.
The text is read PASSES times, each time for another share of the buckets, so that no more than
that share of the blocks is on disk at once.

Storing.  A bucket's counts become arrays sorted by hash in the shared folder: trigrams with
their counts, contexts with the sums that discounts need, bigrams with their left neighbours,
words with theirs.  Of a 64-bit hash 32 bits are searched; entries that would be alike in these,
and large counts, stand in a second array with the whole hash.  Files are put in place
by renaming, so that a second attempt of a task does no harm.

Scoring.  Workers memory-map the arrays (a folder that is no mounted file system is copied
file by file to the executor's own Spark folder first) and look up the distinct trigrams of a slice of text.

Defined results: a null text, an empty one or one without words has 0 words and a null perplexity, and
is not counted; perplexity is per event, the end mark included; discounts that counts of counts cannot give are
0.5, 1 and 1.5; all rows are counted and scored, repeated or not; ties do not matter; a word that was never seen has
the share of one more word; a null id stays null, and ids keep their type; an empty table gives no rows.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm.common import Rows, cut, form, lean, mix, read, scratch, text_slices, words

#: Bytes of text for a bucket; words of a block; buckets of trigrams for a bucket of words; times that the text is read to count.
BUCKET_BYTES, FLUSH, WORD_BUCKETS, PASSES = 8 << 20, 1_500_000, 8, 3

_U = np.uint64
BEGIN, END = _U(0x1D8E4E27C47D124F), _U(0xEB44ACCAB455D165)
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95), _U(0x2545F4914F6CDD1D)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _M1 + b * _M2)


def triple_hash(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(a * _M1 + b * _M2 + c * _M3)


def sequence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a slice's texts between marks; the places of events in it; the row of each event; words by row."""
    _, _, token, first = words(data, offsets)
    count = np.diff(first)
    rows = np.flatnonzero(count)
    n = count[rows]
    start = np.cumsum(n + 3) - (n + 3)
    out = np.full(int((n + 3).sum()), BEGIN, dtype=_U)
    out[np.arange(len(token)) + 3 * np.repeat(np.arange(len(rows)), n) + 2] = token
    out[start + n + 2] = END
    event = np.ones(len(out), dtype=bool)
    event[start] = event[start + 1] = False
    return out, np.flatnonzero(event), np.repeat(rows, n + 1), count


class Spread:
    """The bucket of a word; frequent words have several, among which another word chooses."""

    def __init__(self, buckets: int, frequent: np.ndarray, several: np.ndarray):
        self.buckets, self.frequent, self.several = buckets, frequent, several

    def is_frequent(self, word: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return np.zeros(len(word), dtype=bool)
        return self.frequent[np.minimum(np.searchsorted(self.frequent, word), len(self.frequent) - 1)] == word

    def bucket(self, word: np.ndarray, other: np.ndarray) -> np.ndarray:
        out = mix(word)
        hot = np.flatnonzero(self.is_frequent(word))
        if len(hot):
            out[hot] = mix(out[hot] + mix(other[hot]) % self.several[np.searchsorted(self.frequent, word[hot])])
        return (out % _U(self.buckets)).astype(np.int32)


def _block(arrays: list[np.ndarray], count: np.ndarray) -> bytes:
    """Compressed: the words of the arrays as numbers of a small vocabulary, and the counts."""
    vocabulary, ids = np.unique(np.concatenate(arrays), return_inverse=True)
    ids = ids.astype(np.uint16 if len(vocabulary) < 1 << 16 else np.uint32)
    raw = np.array([len(vocabulary), len(count)], dtype=np.int64).tobytes() + vocabulary.tobytes() + ids.tobytes() + count.astype(np.uint32).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unblock(raw: bytes, n: int) -> list[np.ndarray]:
    """The n word arrays of a block, and the counts."""
    data = np.frombuffer(pa.Codec("zstd").decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True), dtype=np.uint8)
    v, m = data[:16].view(np.int64).tolist()
    vocabulary = data[16 : 16 + 8 * v].view(_U)
    kind = np.uint16 if v < 1 << 16 else np.uint32
    at = 16 + 8 * v
    ids = np.frombuffer(data[at : at + n * m * kind().itemsize].tobytes(), dtype=kind).reshape(n, m)
    counts = np.frombuffer(data[at + n * m * kind().itemsize :].tobytes(), dtype=np.uint32)
    return [*vocabulary[ids], counts]


def _events(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes between marks, and the places of events, of about `most` words at a time."""
    held, size = [], 0
    for batch in batches:
        for _, data, offsets in text_slices(batch.column(0)):
            token, at, _, _ = sequence(data, offsets)
            held.append((token, at))
            size += len(token)
            if size >= most:
                yield _joined(held)
                held, size = [], 0
    if size:
        yield _joined(held)


def _joined(held: list) -> tuple[np.ndarray, np.ndarray]:
    base = np.cumsum([0, *[len(t) for t, _ in held]])
    return np.concatenate([t for t, _ in held]), np.concatenate([a + b for (_, a), b in zip(held, base)])


def _frequent(buckets: int, most: int):
    """(w, n) of words that are more than a quarter of a bucket's share of a block of text; and the words of the block, as (null, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, at in _events(batches, most):
            word, n = np.unique(token[at - 1], return_counts=True)
            some = n * 4 * buckets >= len(at)
            yield pa.RecordBatch.from_arrays([pa.array([*word[some].view(np.int64).tolist(), None], pa.int64()), pa.array([*n[some].tolist(), len(at)], pa.int64())], ["w", "n"])

    return run


def _trigrams(spread: Spread, most: int, share: int = 0, shares: int = 1):
    """(bucket, block) of the distinct trigrams, of the buckets whose number leaves `share` when divided by `shares`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, at in _events(batches, most):
            if shares > 1:
                at = at[spread.bucket(token[at - 1], token[at - 2]) % shares == share]
                if not len(at):
                    continue
            vocabulary, ids = np.unique(token, return_inverse=True)
            v = np.int64(len(vocabulary))
            ids = ids.astype(np.int64)
            # By the middle word, then the first: neighbours are alike, which the compression likes.
            code, count = np.unique((ids[at - 1] * v + ids[at - 2]) * v + ids[at], return_counts=True)
            c = vocabulary[code % v]
            a, b = vocabulary[code // v % v], vocabulary[code // v // v]
            bucket = spread.bucket(b, a)
            order = np.argsort(bucket, kind="stable")
            there, begin = np.unique(bucket[order], return_index=True)
            blocks = [_block([a[o], b[o], c[o]], count[o]) for o in np.split(order, begin[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(blocks, pa.binary())], ["bucket", "block"])

    return run


def _local(folder: str) -> str | None:
    u = urlparse(folder)
    return u.path if u.scheme in ("", "file") else None


def _put(folder: str, name: str, payload: bytes) -> None:
    """Writes a file of the model under its own name, whole or not at all."""
    path = _local(folder)
    attempt = f".{name}-{uuid.uuid4().hex}"
    if path is not None:
        Path(path).mkdir(parents=True, exist_ok=True)
        Path(path, attempt).write_bytes(payload)
        os.replace(f"{path}/{attempt}", f"{path}/{name}")
        return
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(folder)
    fs.create_dir(at)
    with fs.open_output_stream(f"{at}/{attempt}") as f:
        f.write(payload)
    fs.move(f"{at}/{attempt}", f"{at}/{name}")


def store(key: np.ndarray, value: np.ndarray) -> bytes:
    """Distinct hashes and rows of counts, as a file for Table."""
    order = np.argsort(key)
    key, value = key[order], value[order].reshape(len(key), value.shape[1] if value.ndim > 1 else 1)
    head = (key >> _U(32)).astype(np.uint32)
    apart = (value >= 255).any(axis=1)
    twin = head[1:] == head[:-1]
    apart[1:] |= twin
    apart[:-1] |= twin
    short = np.where(apart[:, None], 255, value).astype(np.uint8)
    once = np.append(True, ~twin) if len(head) else np.zeros(0, bool)
    head, short = head[once], short[once]
    return b"".join(x.tobytes() for x in (np.array([len(head), value.shape[1], int(apart.sum()), 0], dtype=np.int64), key[apart], value[apart].astype(np.int64), head, short))


class Table:
    """A stored file: hashes to rows of counts."""

    def __init__(self, raw: np.ndarray):
        n, k, m, _ = raw[:32].view(np.int64).tolist()
        at = 32
        self.whole = raw[at : at + 8 * m].view(_U)
        at += 8 * m
        self.large = raw[at : at + 8 * m * k].view(np.int64).reshape(m, k)
        at += 8 * m * k
        self.head = raw[at : at + 4 * n].view(np.uint32)
        self.short = raw[at + 4 * n : at + 4 * n + n * k].reshape(n, k)

    def get(self, key: np.ndarray) -> np.ndarray:
        """Rows of counts; zeros for what is not there."""
        out = np.zeros((len(key), self.short.shape[1]), dtype=np.int64)
        if not len(self.head):
            return out
        head = (key >> _U(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(self.head, head), len(self.head) - 1)
        hit = np.flatnonzero(self.head[at] == head)
        out[hit] = self.short[at[hit]]
        apart = hit[out[hit, 0] == 255]
        if len(apart):
            at = np.minimum(np.searchsorted(self.whole, key[apart]), len(self.whole) - 1)
            out[apart] = np.where((self.whole[at] == key[apart])[:, None], self.large[at], 0)
        return out


_RESULT = "kind string, bucket int, block binary, stats array<long>"


def _result(kinds: list[str], buckets: list[int], blocks: list[bytes | None], stats: list[list[int] | None]) -> pa.Table:
    return pa.table({"kind": pa.array(kinds, pa.string()), "bucket": pa.array(buckets, pa.int32()), "block": pa.array(blocks, pa.binary()), "stats": pa.array(stats, pa.list_(pa.int64()))})


def _added(keys: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct key, and the sums of counts."""
    order = np.argsort(keys)
    new = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(keys) else np.zeros(0, np.int64)
    return order[new], np.add.reduceat(count[order], new) if len(new) else count[:0]


def _classes(count: np.ndarray) -> list[int]:
    """Counts of counts from 1 to 4."""
    return [int((count == i).sum()) for i in (1, 2, 3, 4)]


def _contexts(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries with counts: the first place of each context; its sum, and how many entries it has with counts 1, 2, and 3 or more."""
    order = np.argsort(key)
    new = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    c = count[order]
    return order[new], np.column_stack([np.add.reduceat(x.astype(np.int64), new) for x in (c, c == 1, c == 2, c >= 3)])


def _word_blocks(word: np.ndarray, count: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    at, total = _added(word, count)
    word = word[at]
    bucket = (mix(word) % _U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    there, begin = np.unique(bucket[order], return_index=True)
    return [(int(b), _block([word[o]], total[o])) for b, o in zip(there, np.split(order, begin[1:]))] if len(order) else []


def _count_bucket(folder: str, spread: Spread, word_buckets: int):
    """Stores a bucket of trigrams; gives on the words that follow, and the bigrams of frequent words."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        parts = [_unblock(x.as_py(), 3) for x in table.column("block")]
        a, b, c, count = (np.concatenate([p[i] for p in parts]) for i in range(4))
        del parts
        trigram = triple_hash(a, b, c)
        at, count = _added(trigram, count.astype(np.int64))
        trigram, a, b, c = trigram[at], a[at], b[at], c[at]
        _put(folder, f"T-{bucket}", store(trigram, count))
        context = pair_hash(a, b)
        at, sums = _contexts(context, count)
        # Contexts that were seen once need no entry, but those that look like one that has.
        some, head = sums[:, 0] > 1, context[at] >> _U(32)
        some |= np.isin(head, head[some])
        _put(folder, f"C-{bucket}", store(context[at[some]], sums[some]))
        bigram = pair_hash(b, c)
        at, lefts = _added(bigram, np.ones(len(bigram), np.int64))
        bigram, b, c = bigram[at], b[at], c[at]
        hot = spread.is_frequent(b)
        out = [("trigrams", bucket, None, _classes(count))]
        if hot.any():
            to = spread.bucket(b[hot], c[hot])
            order = np.argsort(to, kind="stable")
            there, begin = np.unique(to[order], return_index=True)
            out += [("bigrams of frequent words", int(t), _block([b[hot][o], c[hot][o]], lefts[hot][o]), None) for t, o in zip(there, np.split(order, begin[1:]))]
        bigram, b, c, lefts = bigram[~hot], b[~hot], c[~hot], lefts[~hot]
        _put(folder, f"P-{bucket}", store(bigram, lefts))
        if len(b):
            at, sums = _contexts(b, lefts)
            _put(folder, f"D-{bucket}", store(mix(b[at]), sums))
        out.append(("bigrams", bucket, None, _classes(lefts)))
        out += [("words", w, block, None) for w, block in _word_blocks(c, np.ones(len(c), np.int64), word_buckets)]
        return _result(*map(list, zip(*out)))

    return run


def _count_frequent(folder: str, word_buckets: int):
    """Adds up and stores a bucket of the bigrams of frequent words."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        parts = [_unblock(x.as_py(), 2) for x in table.column("block")]
        b, c, count = (np.concatenate([p[i] for p in parts]) for i in range(3))
        bigram = pair_hash(b, c)
        at, lefts = _added(bigram, count.astype(np.int64))
        b, c = b[at], c[at]
        _put(folder, f"Q-{bucket}", store(bigram[at], lefts))
        at, sums = _contexts(b, lefts)
        word = b[at]
        out = [("bigrams", bucket, None, _classes(lefts))]
        out += [("context", int(h), None, [int(w), *s]) for h, w, s in zip((mix(word) % _U(word_buckets)).tolist(), word.view(np.int64).tolist(), sums.tolist())]
        out += [("words", w, block, None) for w, block in _word_blocks(c, np.ones(len(c), np.int64), word_buckets)]
        return _result(*map(list, zip(*out)))

    return run


def _count_words(folder: str):
    """Adds up and stores a bucket of words, and the contexts that frequent words are."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        parts = [_unblock(x.as_py(), 1) for x in table.column("block") if x.is_valid]
        word, count = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, _U) for i in range(2))
        at, lefts = _added(word, count.astype(np.int64))
        _put(folder, f"U-{bucket}", store(mix(word[at]), lefts))
        sums = np.array([x.as_py() for x in table.column("stats") if x.is_valid], dtype=np.int64).reshape(-1, 5)
        if len(sums):
            _put(folder, f"H-{bucket}", store(mix(sums[:, 0].copy().view(_U)), sums[:, 1:]))
        return _result(["words"], [bucket], [None], [[*_classes(lefts), len(lefts), int(lefts.sum()), int((lefts >= 3).sum())]])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """For counts of 1, 2, and 3 or more."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _sums(df: DataFrame, kind: str, n: int) -> list[int]:
    r = df.where(F.col("kind") == kind).agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(n)]).first()
    return [int(x) for x in r]


def train(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, flush: int = FLUSH) -> dict:
    """Counts docs and stores the model; returns what Model needs besides the files."""
    rows = Rows(docs)
    spark = rows.spark
    texts = rows.df.select(rows["text"].alias("text"))
    folder = scratch(spark, "lm")
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    words_in = max(1, -(-buckets // WORD_BUCKETS))
    frequent, several = np.zeros(0, _U), np.zeros(0, _U)
    if buckets > 1:
        seen = {r.w: r.n for r in texts.mapInArrow(lean(_frequent(buckets, flush)), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
        total = seen.pop(None, 0)
        seen = sorted((w % (1 << 64), k) for w, n in seen.items() if (k := -(-n * 2 * buckets // total)) > 1)
        frequent, several = np.array([w for w, _ in seen], dtype=_U), np.array([k for _, k in seen], dtype=_U)
    spread = Spread(buckets, frequent, several)
    # Buckets are light to move and heavy to count: a number of tasks that is given is not coalesced at run time.
    spot = lambda df, n: df.repartition(min(n, 20_000), "bucket").groupBy("bucket")
    counted = None
    shares = min(PASSES, buckets)
    for share in range(shares):
        blocks = texts.mapInArrow(lean(_trigrams(spread, flush, share, shares)), "bucket int, block binary")
        part = cut(spot(blocks, -(-buckets // shares)).applyInArrow(_count_bucket(folder, spread, words_in), _RESULT))
        counted = part if counted is None else counted.union(part)
    if len(frequent):
        more = cut(spot(counted.where("kind = 'bigrams of frequent words'").select("bucket", "block"), buckets).applyInArrow(_count_frequent(folder, words_in), _RESULT))
        contexts = more.where("kind = 'context'").groupBy("bucket", F.col("stats")[0].alias("w")).agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(1, 5)])
        counted = counted.union(more.where("kind <> 'context'"))
        ends = counted.where("kind = 'words'").select("bucket", "block", F.lit(None).cast("array<long>").alias("stats")).union(contexts.select("bucket", F.lit(None).cast("binary").alias("block"), F.array("w", *[f"s{i}" for i in range(1, 5)]).alias("stats")))
    else:
        ends = counted.where("kind = 'words'").select("bucket", "block", F.lit(None).cast("array<long>").alias("stats"))
    last = cut(spot(ends, words_in).applyInArrow(_count_words(folder), _RESULT))
    n1, n2, n3, n4, vocabulary, total, many = _sums(last, "words", 7)
    return {
        "folder": folder, "spread": spread, "word_buckets": words_in, "vocabulary": vocabulary, "total": total, "classes": (n1, n2, many),
        "discounts": [discounts(n1, n2, n3, n4), discounts(*_sums(counted, "bigrams", 4)), discounts(*_sums(counted, "trigrams", 4))],
    }


class Model:
    """The stored arrays, memory-mapped."""

    def __init__(self, folder: str, spread: Spread, word_buckets: int, vocabulary: int, total: int, classes: tuple, discounts: list):
        self.folder, self.spread, self.word_buckets = folder, spread, word_buckets
        self.vocabulary, self.total, self.classes = vocabulary, max(total, 1), classes
        self.discounts = [np.array([0.0, *d]) for d in discounts]
        self.tables: dict[str, Table | None] = {}

    def _open(self, name: str) -> Table | None:
        if name not in self.tables:
            path = _local(self.folder)
            if path is None:
                path = self._fetched(name)
            there = path is not None and os.path.exists(f"{path}/{name}")
            self.tables[name] = Table(np.memmap(f"{path}/{name}", dtype=np.uint8, mode="r")) if there else None
        return self.tables[name]

    def _fetched(self, name: str) -> str:
        """The folder of Spark on this executor, with a copy of the file if there is one."""
        from pyarrow.fs import FileSystem, FileType
        from pyspark import SparkFiles

        fs, at = FileSystem.from_uri(self.folder)
        here = f"{SparkFiles.getRootDirectory()}/{os.path.basename(at)}"
        if not os.path.exists(f"{here}/{name}") and fs.get_file_info(f"{at}/{name}").type == FileType.File:
            with fs.open_input_file(f"{at}/{name}") as f:
                _put(here, name, f.readall())
        return here

    def get(self, level: str, bucket: np.ndarray, key: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(key), width), dtype=np.int64)
        order = np.argsort(bucket, kind="stable")
        there, begin = np.unique(bucket[order], return_index=True)
        for b, o in zip(there.tolist(), np.split(order, begin[1:])):
            if (table := self._open(f"{level}-{b}")) is not None:
                out[o] = table.get(key[o])
        return out

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Left neighbours of bigrams."""
        bucket, key = self.spread.bucket(a, b), pair_hash(a, b)
        hot = self.spread.is_frequent(a)
        out = np.empty(len(a), dtype=np.int64)
        for level, some in (("P", ~hot), ("Q", hot)):
            out[some] = self.get(level, bucket[some], key[some], 1)[:, 0]
        return out

    def _mixed(self, order: int, count: np.ndarray, total: np.ndarray, classes: np.ndarray, lower: np.ndarray) -> np.ndarray:
        d = self.discounts[order]
        seen = np.maximum(total, 1)
        p = np.maximum(count - d[np.minimum(count, 3)], 0) / seen + (classes * d[1:]).sum(axis=1) / seen * lower
        return np.where(total > 0, p, lower)

    def probability(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Of the words c behind a and b."""
        words_in = _U(self.word_buckets)
        one = self.get("U", (mix(c) % words_in).astype(np.int32), mix(c), 1)[:, 0]
        p = self._mixed(0, one, np.full(len(c), self.total), np.tile(self.classes, (len(c), 1)), np.full(len(c), 1 / (self.vocabulary + 1)))
        hot = self.spread.is_frequent(b)
        sums = np.zeros((len(b), 4), dtype=np.int64)
        sums[~hot] = self.get("D", self.spread.bucket(b[~hot], b[~hot]), mix(b[~hot]), 4)
        sums[hot] = self.get("H", (mix(b[hot]) % words_in).astype(np.int32), mix(b[hot]), 4)
        p = self._mixed(1, self._pairs(b, c), sums[:, 0], sums[:, 1:], p)
        bucket = self.spread.bucket(b, a)
        three = self.get("T", bucket, triple_hash(a, b, c), 1)[:, 0]
        sums = self.get("C", bucket, pair_hash(a, b), 4)
        # A context without an entry was seen once, if its words were seen together; then what followed is the one trigram.
        bare = np.flatnonzero(sums[:, 0] == 0)
        once = three[bare] > 0
        rest = bare[~once]
        once[~once] = (self._pairs(a[rest], b[rest]) > 0) | ((a[rest] == BEGIN) & (b[rest] == BEGIN))
        sums[bare[once], :2] = 1
        return self._mixed(2, three, sums[:, 0], sums[:, 1:], p)


_ready: dict[str, Model] = {}


def perplexity(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_words and perplexity of docs under a stored model."""
    rows = Rows(docs)
    held = rows.spark.sparkContext.broadcast(model)
    folder = model["folder"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if folder not in _ready:
            _ready.clear()
            _ready[folder] = Model(**held.value)
        ready = _ready[folder]
        for batch in batches:
            size, value = [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, data, offsets in text_slices(batch.column(1), limit=2 << 20):
                token, at, row, count = sequence(data, offsets)
                a, b, c = token[at - 2], token[at - 1], token[at]
                _, first, back = np.unique(triple_hash(a, b, c), return_index=True, return_inverse=True)
                log = np.log(ready.probability(a[first], b[first], c[first]))[back] if len(at) else np.zeros(0)
                total = np.bincount(row, weights=log, minlength=len(count)) if len(row) else np.zeros(len(count))
                size.append(count)
                value.append(np.exp(-total / (count + 1)))
            n = np.concatenate(size).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(np.concatenate(value), mask=n == 0)], ["doc_id", "n_words", "perplexity"])

    return rows.df.select(rows["doc_id"].alias("doc_id"), rows["text"].alias("text")).mapInArrow(lean(run), form(doc_id=rows.kind("doc_id"), n_words="long", perplexity="double"))


def score(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Trains on docs and scores them."""
    return perplexity(docs, train(docs, bucket_bytes))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of all documents under the model of all documents, to 4 decimals."""
    return score(read(spark, sf_dir, "documents")).withColumn("perplexity", F.round("perplexity", 4))


def _sql() -> str:
    out = [
        r"t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[^0-9A-Za-z\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS w FROM documents)",
        "l AS (SELECT doc_id, list_concat(['<s>', '<s>'], w, ['</s>']) AS a, len(w) AS n FROM t WHERE len(w) > 0)",
        "u AS (SELECT doc_id, a[i] AS x, a[i + 1] AS y, a[i + 2] AS z FROM l, unnest(range(1, n + 2)) AS r(i))",
        "c3 AS (SELECT x, y, z, count(*) AS a FROM u GROUP BY ALL)",
        "c2 AS (SELECT y, z, count(*) AS a FROM c3 GROUP BY ALL)",
        "c1 AS (SELECT z, count(*) AS a FROM c2 GROUP BY ALL)",
    ]
    for n, context, key in ((1, "", "z"), (2, "y", "y, z"), (3, "x, y", "x, y, z")):
        out.append(f"m{n} AS (SELECT count(*) FILTER (a = 1) AS n1, count(*) FILTER (a = 2) AS n2, count(*) FILTER (a = 3) AS n3, count(*) FILTER (a = 4) AS n4 FROM c{n})")
        d = ", ".join(f"CASE WHEN n1 > 0 AND n2 > 0 AND n3 > 0 THEN least(greatest({k}.0::DOUBLE - {k + 1} * (n1::DOUBLE / (n1 + 2 * n2)) * n{k + 1} / n{k}, 0), {k}) ELSE {k / 2} END AS d{k}" for k in (1, 2, 3))
        out.append(f"d{n} AS (SELECT {d} FROM m{n})")
        weight = "sum(a)::DOUBLE AS tot, (any_value(d1) * count(*) FILTER (a = 1) + any_value(d2) * count(*) FILTER (a = 2) + any_value(d3) * count(*) FILTER (a >= 3)) / sum(a)::DOUBLE AS w"
        out.append(f"w{n} AS (SELECT {context + ', ' if context else ''}{weight} FROM c{n}, d{n}{' GROUP BY ' + context if context else ''})")
        lower = {1: "", 2: "JOIN p1 USING (z)", 3: "JOIN p2 USING (y, z)"}[n]
        base = "1.0::DOUBLE / ((SELECT count(*) FROM c1) + 1)" if n == 1 else f"p{n - 1}.p"
        join = f"JOIN w{n} USING ({context})" if context else f"CROSS JOIN w{n}"
        out.append(f"p{n} AS (SELECT {key}, greatest(a - CASE a WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END, 0) / tot + w * {base} AS p FROM c{n} CROSS JOIN d{n} {join} {lower})")
    out.append("s AS (SELECT doc_id, sum(ln(p)) AS s FROM u JOIN p3 USING (x, y, z) GROUP BY doc_id)")
    return "WITH " + ",\n".join(out) + "\nSELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, round(exp(-s.s / (len(t.w) + 1)), 4) AS perplexity FROM t LEFT JOIN s USING (doc_id)"


SQL = _sql()
