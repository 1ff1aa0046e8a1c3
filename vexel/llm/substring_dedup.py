"""Substring dedup by seed and extend: the longest repeats of LEAST words or more across documents.

Words are lower-case runs of ASCII letters, digits and characters beyond ASCII.  Seeds are
winnowed anchors: of every WINDOW neighbouring runs of GRAM words the one with the least
hash, ties all kept, so that two texts which share LEAST = GRAM + WINDOW - 1 words in a row
share an anchor there.  Each text meets on every shared anchor the group's first text (the
least key) as its partner, and the match is extended both ways on that partner's own words,
compared byte by byte.  Where it ends inside, the anchor with the words up to the one that
differs is a new, longer seed: texts that go on together beyond their partner share that
seed and meet on it in the next round, until no seed is shared.  So every match of two texts
is found, each with its own partner, and no group is ever paired with itself: a passage in many texts
costs a pair for each text and round, and groups fall apart a word at a time.

Runs of one repeated word have no anchors of their own, for these would be all alike.  Such a
run of LEAST words or more is matched by its length with the longest of another text.

A repeat is reported unless a longer one of the same document holds it; a repeat is one match
with one partner, and matches with different partners are not joined.

Where the partner holds a seed more than once, as in repeated lines, one place is taken by a hash,
so that each round halves, by chance, the repetitions that are left; and the seed's texts meet the
first text after the partner as well.

Only the neighbourhoods of shared anchors leave the text's place, and those of a round are among
those of the round before; once they are few enough to be named by a broadcast, the rest is not moved again.  Texts that are equal are
one text; each of their documents is a repeat from end to end.

Defined results: null and empty texts, and those of fewer than LEAST words, have none; rows with equal
id and text are one document and are no repeat of each other, but each is reported; a passage repeated only within
one document is none; a null id is reported as null, and ids keep their type; ties of hashes do not matter (seeds of
equal hash and other words meet, differ, and get a second hash).  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vexel.llm.common import _BYTES, Rows, cut, lean, mix, read, text_slices, window_hash, words

LEAST, GRAM = 50, 26
#: Hashes of shared anchors are broadcast up to so many; beyond, they are joined.
BROADCAST_ANCHORS = 4_000_000
#: The neighbourhoods that a round needs are picked by a broadcast of up to so many numbers; beyond, all are joined.
BROADCAST_REGIONS = 1_000_000


def _slide(x: np.ndarray, w: int, of) -> np.ndarray:
    """of (minimum or maximum) over every w neighbours of x; len(x) - w + 1 of them."""
    have, out = 1, x
    while have * 2 <= w:
        out = of(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = of(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1])
    return out


def monotone(token: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of one word, of at least that many, within rows."""
    if not len(token):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(token), dtype=bool)
    new[1:] = token[1:] != token[:-1]
    new[first[first < len(token)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(token))
    some = end - start >= least
    return start[some], end[some]


_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def anchors(token: np.ndarray, first: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in token, and hashes, of the anchors of all rows; first: index of each row's first token."""
    n, w = len(token), least - gram + 1
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = window_hash(token, gram)
    for a, b in zip(*monotone(token, first, gram)):
        grams[a : b - gram + 1] = _NONE
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    low = _slide(grams, w, np.minimum)
    low = np.where(row[: len(low)] == row[least - 1 :], low, 0)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero((_slide(padded, w, np.maximum) == grams) & (grams != 0) & (grams != _NONE))
    return at, grams[at]


def _seeds(least: int, gram: int):
    """(h, k) of the anchors of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_slices(batch.column(1), lower=True):
                _, _, token, first = words(data, offsets)
                place, value = anchors(token, first, least, gram)
                row = np.searchsorted(first, place, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), batch.column(0).take(pa.array(row + at))], ["h", "k"])

    return run


def _regions(least: int, gram: int, held):
    """Of (k, text, hashes): the neighbourhoods of shared anchors, as (k, start, words, h, p): the first word's number, the words, and the anchors with their places in it; one row (k, n) of each text of LEAST words; and one (k, start, h = [word], p = [length]) of each run of one word. held: the shared hashes for all texts, or None if `hashes` has each text's."""
    reach = least - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = held.value if held is not None else None
        for batch in batches:
            for at, data, offsets in text_slices(batch.column(1), lower=True):
                starts, ends, token, first = words(data, offsets)
                count = np.diff(first)
                long = np.flatnonzero(count >= least)
                if not len(long):
                    continue
                none = pa.nulls(len(long), pa.list_(pa.int64())), pa.nulls(len(long), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(long + at)), pa.array(count[long].astype(np.int32)), pa.nulls(len(long), pa.binary()), *none], ["k", "start", "words", "h", "p"])
                begin, end = monotone(token, first, least)
                row = np.searchsorted(first, begin, "right") - 1
                ones = pa.array(np.arange(len(begin) + 1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(row + at)), pa.array((begin - first[row]).astype(np.int32)), pa.nulls(len(begin), pa.binary()),
                    pa.ListArray.from_arrays(ones, pa.array(token[begin].view(np.int64))), pa.ListArray.from_arrays(ones, pa.array((end - begin).astype(np.int32))),
                ], ["k", "start", "words", "h", "p"])
                place, value = anchors(token, first, least, gram)
                row = np.searchsorted(first, place, "right") - 1
                if hot is not None:
                    some = hot[np.minimum(np.searchsorted(hot, value), len(hot) - 1)] == value if len(hot) else np.zeros(len(value), bool)
                else:
                    each = [np.sort(np.array(batch.column(2)[at + r].as_py() or [], dtype=np.int64).view(np.uint64)) for r in range(len(offsets) - 1)]
                    some = np.array([len(e := each[r]) > 0 and e[min(np.searchsorted(e, v), len(e) - 1)] == v for r, v in zip(row, value)], dtype=bool)
                place, value, row = place[some], value[some], row[some]
                if not len(place):
                    continue
                low, high = np.maximum(place - reach, first[row]), np.minimum(place + gram + reach, first[row + 1])
                # A neighbourhood that ends within a run of one word takes the whole run.
                begin, end = monotone(token, first, gram)
                if len(begin):
                    at_low, at_high = (np.maximum(np.searchsorted(begin, x, "right") - 1, 0) for x in (low, high))
                    low = np.where((begin[at_low] < low) & (low < end[at_low]), begin[at_low], low)
                    high = np.where((begin[at_high] < high) & (high < end[at_high]), end[at_high], high)
                new = np.ones(len(place), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (low[1:] > high[:-1])
                begin = np.flatnonzero(new)
                a, b = low[begin], high[np.append(begin[1:], len(place)) - 1]
                size = ends - starts
                texts = []
                for i, j in zip(a.tolist(), b.tolist()):
                    # Words between single spaces: each is taken with the byte behind it, which becomes the space.
                    s, n = starts[i:j], size[i:j] + 1
                    ahead = np.cumsum(n)
                    flat = np.arange(ahead[-1]) + np.repeat(s - (ahead - n), n)
                    part = data[np.minimum(flat, len(data) - 1)]
                    part[ahead - 1] = 32
                    texts.append(part[:-1].tobytes())
                region = np.cumsum(new) - 1
                cuts = pa.array(np.append(begin, len(place)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(row[begin] + at)), pa.array((a - first[row[begin]]).astype(np.int32)), pa.array(texts, pa.binary()),
                    pa.ListArray.from_arrays(cuts, pa.array(value.view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array((place - a[region]).astype(np.int32))),
                ], ["k", "start", "words", "h", "p"])

    return run


class _Words:
    """The words of a region, by number."""

    def __init__(self, raw: bytes):
        self.raw, self.data = raw, np.frombuffer(raw, dtype=np.uint8)
        self.spaces = np.flatnonzero(self.data == 32)
        self.n = len(self.spaces) + 1

    def start(self, word: int) -> int:
        return int(self.spaces[word - 1]) + 1 if word else 0

    def end(self, word: int) -> int:
        """Where the words before this one end."""
        return int(self.spaces[word - 1]) if word < self.n else len(self.data)


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many bytes a and b begin with in common."""
    n, at, step = min(len(a), len(b)), 0, 256
    while at < n:
        to = min(n, at + step)
        differ = a[at:to] != b[at:to]
        if differ.any():
            return at + int(differ.argmax())
        at, step = to, step * 4
    return n


def extend(d: _Words, r: _Words, x: int, y: int, diagonal: int) -> tuple[int, int]:
    """The longest match of d's and r's words around d's words x to y - 1, of which word i stands beside r's word i + diagonal. Less than x to y if these differ."""
    s, t = d.start(x), r.start(x + diagonal)
    n = _same(d.data[s:], r.data[t:])
    e, f = s + n, t + n
    # The last word counts if it ends on both sides.
    whole = (e == len(d.data) or d.data[e] == 32) and (f == len(r.data) or r.data[f] == 32)
    high = int(np.searchsorted(d.spaces, e)) + (1 if whole else 0)
    n = _same(d.data[:s][::-1], r.data[:t][::-1])
    e, f = s - n, t - n
    whole = (e == 0 or d.data[e - 1] == 32) and (f == 0 or r.data[f - 1] == 32)
    low = int(np.searchsorted(d.spaces, e)) + (0 if whole else 1)
    return low, high


def _key(w: _Words, x: int, y: int) -> int:
    """A hash of words x to y - 1, other than that of anchors."""
    return int(mix(_BYTES.spans(w.data, 1, np.array([w.start(x)]), np.array([w.end(y)])) ^ np.uint64(y - x))[0].astype(np.int64))


def _extend_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (k, g, words, rg, theirs, seeds, second): matches as (k, g, rg, x, y, tx, null), and the new seeds as (k, g, null, x, y, null, h)."""
    for batch in batches:
        out: list[list] = [[], [], [], [], [], [], []]
        partner: tuple[bytes, _Words] | None = None
        for k, g, mine, rg, theirs, seeds, again in zip(*[batch.column(n).to_pylist() for n in ("k", "g", "words", "rg", "theirs", "seeds", "second")]):
            d = _Words(mine)
            if partner is None or partner[0] is not theirs and partner[0] != theirs:
                partner = theirs, _Words(theirs)
            r = partner[1]
            known: dict[int, list[tuple[int, int]]] = {}
            new: set[tuple[int, int]] = set()
            for seed in seeds:
                x, y, diagonal = seed["x"], seed["y"], seed["d"]
                spans = known.setdefault(diagonal, [])
                span = next((s for s in spans if s[0] <= x and y <= s[1]), None)
                if span is None:
                    span = extend(d, r, x, y, diagonal)
                    if not (span[0] <= x and y <= span[1]):
                        # Another seed with the same hash: once more under the second one.
                        if not again:
                            new.add((x, y))
                        continue
                    spans.append(span)
                    for c, v in zip(out, (k, g, rg, span[0], span[1], span[0] + diagonal, None)):
                        c.append(v)
                if span[0] > 0:
                    new.add((span[0] - 1, y))
                if span[1] < d.n:
                    new.add((x, span[1] + 1))
            for x, y in new:
                for c, v in zip(out, (k, g, None, x, y, None, _key(d, x, y))):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["k", "g", "rg", "x", "y", "tx", "h"])


def repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, broadcast_anchors: int = BROADCAST_ANCHORS) -> DataFrame:
    """One row for each repeat in a document that is in no longer one: doc_id, start_word, end_word (exclusive)."""
    rows = Rows(docs)
    keyed = rows.df.select(F.xxhash64(rows["text"]).alias("k"), rows["text"].alias("text"), rows["doc_id"].alias("doc_id"))
    seeds = keyed.select("k", "text").mapInArrow(lean(_seeds(least, gram)), "h long, k long")
    shared = lambda df, by: df.groupBy("h").agg(F.min(by).alias("least"), F.max("k").alias("most"))
    hot = cut(shared(seeds, "k").where("least <> most").select("h"))
    if hot.count() <= broadcast_anchors:
        held = rows.spark.sparkContext.broadcast(np.sort(np.array(hot.toArrow().column("h").to_numpy(), dtype=np.int64).view(np.uint64)))
        texts = keyed.select("k", "text", F.lit(None).cast("array<long>").alias("hashes"))
    else:
        held = None
        each = seeds.join(hot, "h").groupBy("k").agg(F.collect_set("h").alias("hashes"))
        texts = keyed.select("k", "text").join(each, "k", "left")
    found = texts.mapInArrow(lean(_regions(least, gram, held)), "k long, start int, words binary, h array<long>, p array<int>")
    found = cut(found.withColumn("g", F.xxhash64("k", "start")).dropDuplicates(["k", "start", "words", "h"]))
    regions = found.where("words is not null").select("g", "k", "start", "words")
    elements = cut(found.where("words is not null").select(F.explode(F.arrays_zip("h", "p")).alias("s"), "k", "g").select("s.h", "k", "g", F.col("s.p").alias("x"), (F.col("s.p") + gram).alias("y")))
    matches = None
    second = False
    live, most = regions, BROADCAST_REGIONS
    while True:
        first = elements.groupBy("h").agg(F.min(F.struct("k", F.xxhash64("g", "x").alias("o"), "g", "x")).alias("r"), F.max("k").alias("most")).where("r.k <> most").select("h", "r")
        near = elements.join(first, "h")
        # Where the partner's text holds the seed more than once, all meet the first other text too, so that each of its places is matched with another text.
        again = near.groupBy("h").agg(F.count_if(F.col("k") == F.col("r.k")).alias("own"), F.min(F.when(F.col("k") != F.col("r.k"), F.struct("k", F.xxhash64("g", "x").alias("o"), "g", "x"))).alias("r2")).where("own > 1").select("h", "r2")
        both = near.select("g", "x", "y", "r").union(near.drop("r").join(again, "h").select("g", "x", "y", "r2"))
        meet = both.where("g <> r.g or x <> r.x").select("g", F.col("r.g").alias("rg"), F.struct("x", "y", (F.col("r.x") - F.col("x")).alias("d")).alias("seed"))
        pairs = cut(meet.groupBy("g", "rg").agg(F.collect_set("seed").alias("seeds")))
        n = pairs.count()
        if not n:
            break
        if 2 * n <= most:
            live = live.join(F.broadcast(pairs.select(F.explode(F.array("g", "rg")).alias("g")).distinct()), "g", "left_semi")
            if second:
                # Written again only when a quarter is left, so that all of these together stay small.
                live, most = cut(live), n // 2
        near = pairs.join(live.select("k", "g", "words"), "g").join(live.select(F.col("g").alias("rg"), F.col("words").alias("theirs")), "rg").withColumn("second", F.lit(second))
        out = cut(near.select("k", "g", "words", "rg", "theirs", "seeds", "second").mapInArrow(lean(_extend_all), "k long, g long, rg long, x int, y int, tx int, h long"))
        span = out.where("h is null").select("g", "rg", "x", "y", "tx")
        matches = span if matches is None else matches.union(span)
        elements = out.where("h is not null").select("h", "k", "g", "x", "y").distinct()
        second = True
    # Runs of one word: the longest of another text, which is the longest of all or, for that text itself, of the others.
    alike = found.where("words is null and h is not null").select("k", "start", F.col("h")[0].alias("w"), F.col("p")[0].alias("n"))
    most = alike.groupBy("w", "k").agg(F.max("n").alias("m"))
    top = most.groupBy("w").agg(F.max(F.struct("m", "k")).alias("t"))
    other = most.join(top, "w").where("k <> t.k").groupBy("w").agg(F.max("m").alias("o"))
    alike = alike.join(top, "w").join(other, "w").withColumn("l", F.least("n", F.expr("if(k = t.k, o, t.m)")))
    alike = alike.select("k", "l", F.explode(F.expr("transform(sequence(0, n - l), i -> start + i)")).alias("x")).select("k", "x", (F.col("x") + F.col("l")).alias("y"))
    whole = found.where("words is null and h is null").groupBy("k").agg(F.max("start").alias("n"))
    ids = keyed.groupBy("k").agg(F.min(F.xxhash64("doc_id")).alias("a"), F.max(F.xxhash64("doc_id")).alias("b"))
    copies = whole.join(ids.where("a <> b"), "k").select("k", F.lit(0).alias("x"), F.col("n").alias("y"))
    spans = copies.union(alike)
    if matches is not None:
        at = regions.select("g", "k", "start")
        both = matches.join(at, "g").join(at.toDF("rg", "rk", "rstart"), "rg").where(f"k <> rk and y - x >= {least}")
        both = both.select(F.explode(F.array(F.struct("k", (F.col("start") + F.col("x")).alias("x"), (F.col("start") + F.col("y")).alias("y")), F.struct(F.col("rk").alias("k"), (F.col("rstart") + F.col("tx")).alias("x"), (F.col("rstart") + F.col("tx") + F.col("y") - F.col("x")).alias("y")))).alias("s")).select("s.*")
        spans = spans.union(both)
    # Of a text's spans, those in no longer one.
    before = Window.partitionBy("k").orderBy("x", F.col("y").desc()).rowsBetween(Window.unboundedPreceding, -1)
    longest = cut(spans.distinct().withColumn("far", F.max("y").over(before)).where("far is null or y > far").select("k", "x", "y"))
    return keyed.select("k", "doc_id").join(longest, "k").select("doc_id", F.col("x").cast("long").alias("start_word"), F.col("y").cast("long").alias("end_word"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest repeats of all documents."""
    return repeats(read(spark, sf_dir, "documents"))


#: All pairs of equal windows, joined along each pair of documents and diagonal; then those in no longer one.
SQL = rf"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^0-9a-z\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CAST(p AS BIGINT) AS p, array_to_string(w[p + 1 : p + {LEAST}], ' ') AS g FROM t, unnest(generate_series(0, len(w) - {LEAST})) AS u(p) WHERE len(w) >= {LEAST}),
m AS (SELECT a.doc_id AS doc_id, a.p AS p, b.doc_id AS other, b.p - a.p AS diagonal FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id),
i AS (SELECT doc_id, p, other, diagonal, p - row_number() OVER (PARTITION BY doc_id, other, diagonal ORDER BY p) AS island FROM m),
r AS (SELECT DISTINCT doc_id, min(p) AS x, max(p) + {LEAST} AS y FROM i GROUP BY doc_id, other, diagonal, island),
l AS (SELECT *, max(y) OVER (PARTITION BY doc_id ORDER BY x, y DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM r)
SELECT doc_id, x AS start_word, y AS end_word FROM l WHERE far IS NULL OR y > far
"""
