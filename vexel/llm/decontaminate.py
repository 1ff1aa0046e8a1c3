"""Benchmark decontamination by pigeonhole edit matching.

A document leaks an item when some part of it is within the item's error budget, a share RATE
of the item's length in edits.  Both sides are reduced to lower-case words, joined by single
spaces; lengths and edits are counted in bytes of UTF-8.  An item with budget k is cut into
k + 1 pieces; a part within the budget holds at least one of them unchanged, so exact piece
hits (one Aho-Corasick pass over each text) find all candidates, and Myers' bit-parallel
distance over the neighbourhood of the hits verifies them.  The distance reported is thus the
least over all parts of the document.

An item too short for any edit has the budget 0; it must stand in the document as whole words,
since a few letters stand inside some word of most texts.

Items are broadcast when their texts are within BROADCAST_BYTES; a larger benchmark is reduced
and written to the shared folder in shards within it, without passing through the driver, and
each shard has a pass of its own over the documents.

Defined results: null items, and those without words, match nothing;
null and empty texts leak nothing; repeated rows are judged each, and a repeated
item counts for each row's item_id; of equal distances there is only the least number to
report, so ties do not show; ids keep their type.  Extra columns, whatever their names, are
kept in the stage and ignored in the query.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm.common import WORD, Rows, lean, read, scratch, text_slices, trim

RATE = 0.05
BROADCAST_BYTES = 32_000_000

_SQUEEZE = np.where(WORD, np.arange(256), 32).astype(np.uint8)


def reduce_slice(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with each run of bytes outside words as one space, each row between line feeds; and where the rows begin in it (one more entry than rows)."""
    n = len(data)
    flat = _SQUEEZE[data]
    keep = np.ones(n, dtype=bool)
    if n:
        blank = flat == 32
        keep[1:] = ~(blank[1:] & blank[:-1])
        # A row's first byte is kept for counting; blanks at its ends go with strip below.
        keep[offsets[:-1][np.diff(offsets) > 0]] = True
    kept = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(keep, out=kept[1:])
    at = kept[offsets] + np.arange(len(offsets))
    out = np.full(int(kept[-1]) + len(offsets), 10, dtype=np.uint8)
    place = np.ones(len(out), dtype=bool)
    place[at] = False
    out[place] = flat[keep]
    return out, at


def reduce_text(text: str | None) -> bytes:
    """An item's text, reduced as the documents are."""
    data = np.frombuffer(pc.utf8_lower(pa.scalar(text or "")).as_py().encode(), dtype=np.uint8)
    return bytes(reduce_slice(data, np.array([0, len(data)]))[0]).strip()


def pieces(item: bytes, budget: int) -> list[tuple[int, bytes]]:
    """budget + 1 pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item: bytes, text: bytes) -> int:
    """Least edit distance between item and any part of text, bit-parallel over the item."""
    m = len(item)
    masks: dict[int, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        up = mh | (full & ~(xv | ph))
        down = ph & xv
    return best


class Matcher:
    """Items of a shard, as (number, reduced text), ready to be searched for."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float):
        self.items = dict(items)
        self.budget = {i: int(rate * len(t)) for i, t in items}
        table = defaultdict(list)
        for i, t in items:
            for at, piece in pieces(t, self.budget[i]):
                table[piece].append((i, at))
        self.machine = ahocorasick.Automaton()
        for piece, uses in table.items():
            self.machine.add_word(piece.decode("latin-1"), (len(piece), uses))
        if table:
            self.machine.make_automaton()

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, distance) of all leaks in a slice."""
        if not self.items or not len(data):
            return []
        flat, at = reduce_slice(data, offsets)
        raw = flat.tobytes()
        spans: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        hits = [(end, value) for end, value in self.machine.iter(raw.decode("latin-1"))]
        if not hits:
            return []
        rows = np.searchsorted(at, [end for end, _ in hits], "right") - 1
        for (end, (size, uses)), row in zip(hits, rows.tolist()):
            for i, offset in uses:
                begin, k = end - size + 1 - offset, self.budget[i]
                spans[row, i].append((max(int(at[row]) + 1, begin - k), min(int(at[row + 1]), begin + len(self.items[i]) + k)))
        found = []
        for (row, i), ranges in spans.items():
            item, k = self.items[i], self.budget[i]
            if not k:
                # Whole words; a row stands between line feeds.
                if any(raw[a - 1] in b"\n " and (b == len(raw) or raw[b] in b"\n ") and raw[a:b] == item for a, b in ranges):
                    found.append((row, i, 0))
                continue
            ranges.sort()
            best, lo, hi = k + 1, *ranges[0]
            for a, b in [*ranges[1:], (1 << 62, 1 << 62)]:
                if a <= hi:
                    hi = max(hi, b)
                    continue
                part = raw[lo:hi]
                best = min(best, 0 if item in part else myers(item, part))
                lo, hi = a, b
            if best <= k:
                found.append((row, i, best))
        return sorted(found)


_ready: dict = {}


def _matcher(held, rate: float) -> Matcher:
    """The matcher of a shard, built once for each worker."""
    name, items, path, shard = held.value
    if (name, rate) not in _ready:
        _ready.clear()
        if path is not None:
            import pyarrow.dataset as ds

            there = ds.dataset(path, partitioning="hive").to_table(columns=["n", "item"], filter=ds.field("shard") == shard)
            items = list(zip(there.column("n").to_pylist(), there.column("item").to_pylist()))
        _ready[name, rate] = Matcher(items, rate)
    return _ready[name, rate]


def _reduce(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([reduce_text(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())], [*batch.schema.names[:-1], "item"])


def _shards(benchmark: DataFrame, most: int) -> tuple[list, DataFrame]:
    """Broadcasts of the shards, each within `most` bytes or one item, and the table of the items' numbers n and ids."""
    rows = Rows(benchmark)
    spark = rows.spark
    items = rows.df.select(rows["item_id"].alias("item_id"), F.xxhash64(rows["text"]).alias("n"), rows["text"].alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ids = items.where("text is not null").select("n", "item_id")
    if total <= most:
        texts = {r.n: reduce_text(r.text) for r in items.where("text is not null").select("n", "text").collect()}
        return [spark.sparkContext.broadcast((uuid.uuid4().hex, [(n, t) for n, t in texts.items() if t], None, 0))], ids
    shards = -(-int(total) * 2 // most)
    folder = scratch(spark, "benchmark")
    reduced = items.select("n", "text").mapInArrow(lean(_reduce), "n long, item binary").where("length(item) > 0").dropDuplicates(["n"])
    reduced.withColumn("shard", F.pmod("n", F.lit(shards)).cast("int")).repartition("shard").write.partitionBy("shard").parquet(folder)
    path = folder.removeprefix("file://") if folder.startswith("file://") else folder
    return [spark.sparkContext.broadcast((uuid.uuid4().hex, [], path, s)) for s in range(shards)], ids


def _found(held, rate: float) -> Column:
    @F.arrow_udf("array<struct<n: bigint, distance: int>>")
    def found(text: pa.Array) -> pa.Array:
        matcher = _matcher(held, rate)
        out: list = [[] for _ in range(len(text))]
        for at, data, offsets in text_slices(text, lower=True, limit=1 << 21):
            for row, i, distance in matcher.search(data, offsets):
                out[at + row].append({"n": i, "distance": distance})
        trim()
        return pa.array(out, pa.list_(pa.struct([("n", pa.int64()), ("distance", pa.int32())])))

    return found


def _clean(held, rate: float) -> Column:
    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        matcher = _matcher(held, rate)
        ok = np.ones(len(text), dtype=bool)
        for at, data, offsets in text_slices(text, lower=True, limit=1 << 21):
            ok[[at + row for row, _, _ in matcher.search(data, offsets)]] = False
        trim()
        return pa.array(ok)

    return clean


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each row of docs and item that it leaks: doc_id, item_id, distance."""
    rows = Rows(docs)
    shards, ids = _shards(benchmark, broadcast_bytes)
    parts = [rows.df.select(rows["doc_id"].alias("doc_id"), F.explode(_found(held, rate)(rows["text"])).alias("x")).select("doc_id", "x.n", "x.distance") for held in shards]
    found = reduce(DataFrame.unionByName, parts)
    return found.join(F.broadcast(ids) if len(shards) == 1 else ids, "n").select("doc_id", "item_id", "distance")


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs that leak no item. Texts are not shuffled."""
    rows = Rows(docs)
    out = rows.df
    for held in _shards(benchmark, broadcast_bytes)[0]:
        out = out.where(_clean(held, rate)(rows["text"]))
    return rows.back(out)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, distance for every document and benchmark item that it leaks."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that leak no item of the benchmark."""
    return without_leaks(docs, read(spark, sf_dir, "benchmark"))
