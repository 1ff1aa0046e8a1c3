"""MinHash near-duplicate groups by an LSH forest.

Each document has a signature of TREES x DEPTH minima over hashed word shingles, 16 bits of
each.  A tree is a sorted order of the documents by one run of DEPTH minima.  The length of
the common prefix of neighbours is computed along the order; every document walks outwards on
both sides, always to the side with the longer common prefix, until it has met REACH others
or no minimum is shared.  So the walk ends at another depth in every region: in a dense one it
stays among documents that agree in many minima, in a sparse one it goes on to those that share
the first minimum only.  A document that REACH nearer ones crowd out in one tree has 15 more.
Each entry of an order carries BITS bits of every minimum, in which two signatures agree at least as
often as in the minima themselves.  So pairs that met by chance, whose number grows faster than
the table, are dropped where they meet, and none that the signatures would have let through.

Pairs whose signatures agree in THRESHOLD + MARGIN of the minima or more are near, those below
THRESHOLD - MARGIN are not (MARGIN is 3.4 standard errors at the threshold), and all between
are decided by the exact Jaccard similarity of their texts' shingles.  Near pairs are grouped into
connected components.  Documents of equal signatures are one class with one representative,
so that thousands of copies cost thousands of rows and not their pairs.

Defined results: a null or empty text, or one without words, is in no group; texts shorter
than the shingle form one shingle; rows with equal id and text are one document, which counts
as a group of its own when it is repeated; ties in a sorted order fall by a hash of key and
tree; ids keep their type, and of a group the least id stays (null last).  Extra columns are
ignored in the query and kept in the stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vexel.llm.common import Rows, cut, lean, read, small, text_slices, window_hash, words

TREES, DEPTH, SHINGLE, THRESHOLD, MARGIN, REACH = 16, 8, 3, 0.55, 0.15, 6
#: Keys of documents whose texts are compared are broadcast up to so many; beyond, they are joined by shuffle.
BROADCAST_KEYS = 1_000_000
#: Low bits of a minimum in a sketch; four minima are a byte.
BITS = 2


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows and where each row's begin (one more entry than rows); short rows have one shingle."""
    _, _, token, first = words(data, offsets)
    count = np.diff(first)
    out = window_hash(token, k)
    rows = np.repeat(np.arange(len(count)), count)
    whole = rows[: len(out)] == rows[k - 1 :][: len(out)] if len(out) else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < k))
    parts, owner = [out[whole]], [rows[: len(out)][whole]]
    for r in short:
        parts.append(np.atleast_1d(window_hash(token[first[r] : first[r + 1]], int(count[r]))))
        owner.append(np.array([r]))
    values, owner = np.concatenate(parts), np.concatenate(owner)
    if len(short):
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    return values, np.searchsorted(owner, np.arange(len(count) + 1))


def signatures(data: np.ndarray, offsets: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have shingles, and the low 16 bits of their n minima."""
    values, first = shingles(data, offsets, k)
    some = np.flatnonzero(np.diff(first))
    out = np.empty((len(some), n), dtype=np.uint16)
    if len(some):
        a, b = _multipliers(n)
        at = first[some]
        for j in range(n):
            out[:, j] = np.minimum.reduceat(((values * a[j] + b[j]) >> np.uint64(32)).astype(np.uint32), at) & 0xFFFF
    return some, out


def _sign(k: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for at, data, offsets in text_slices(batch.column(1), lower=True):
                some, sig = signatures(data, offsets, k, n)
                if len(some):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(some + at)), _fixed(sig.view(np.uint8))], ["key", "sig"])

    return run


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a binary column of that width."""
    at = column.offset * width
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[at : at + len(column) * width].reshape(-1, width)


def _labels(column: pa.Array, depth: int) -> np.ndarray:
    """Rows x depth minima of a binary column of that width."""
    return _bytes(column, 2 * depth).view(np.uint16)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    ends = (np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])


def sketch(sig: np.ndarray) -> np.ndarray:
    """Rows of packed low bits of the minima."""
    low = np.zeros((len(sig), -(-sig.shape[1] // 4) * 4), dtype=np.uint8)
    low[:, : sig.shape[1]] = sig & ((1 << BITS) - 1)
    return low[:, 0::4] | low[:, 1::4] << 2 | low[:, 2::4] << 4 | low[:, 3::4] << 6


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many minima are different in the sketches, row by row; never more than in the signatures."""
    d = x ^ y
    return np.bitwise_count((d | d >> 1) & 0x55).sum(axis=1, dtype=np.int64)


def _spread(trees: int, depth: int):
    """Of (key, sig): the entries of all orders, as (tree, label, key, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _labels(batch.column(1), trees * depth)
            brief = _fixed(sketch(sig))
            for tree in range(trees):
                label = _fixed(np.ascontiguousarray(sig[:, tree * depth : (tree + 1) * depth]).view(np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), tree, np.int32)), label, batch.column(0), brief], ["tree", "label", "key", "sketch"])

    return run


def nearest(prefix: np.ndarray, reach: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that rows low to high - 1 of a sorted order choose: of both sides, the `reach` rows with the longest common prefixes, nearer ones first. prefix: the common prefix of each row and the next."""
    n = len(prefix) + 1
    right, left = np.zeros((reach + 1, n), np.int8), np.zeros((reach + 1, n), np.int8)
    right[0] = left[0] = 127
    for j in range(1, reach + 1):
        if j < n:
            right[j, : n - j] = np.minimum(right[j - 1, : n - j], prefix[j - 1 :])
            left[j, j:] = np.minimum(left[j - 1, j:], prefix[: n - j])
    a, b = [], []
    rows = np.arange(low, high)
    for mine, other, sign in ((right, left, 1), (left, right, -1)):
        for j in range(1, reach + 1):
            own = mine[j, low:high]
            ahead = sum(((other[i, low:high] > own) | ((other[i, low:high] == own) & (i < j + (sign > 0)))).astype(np.int8) for i in range(1, reach + 1))
            chosen = rows[(own > 0) & (j + ahead <= reach)]
            a.append(chosen)
            b.append(chosen + sign * j)
    return np.concatenate(a), np.concatenate(b)


def _neighbours(reach: int, depth: int, n: int, least: float):
    """Of the sorted rows (tree, label, key, sketch) of a partition: the pairs that its rows choose and whose sketches agree in that share of n minima or more; and the rows at the partition's ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "tree", "label"]

        def pairs(table: pa.RecordBatch, low: int, high: int) -> pa.RecordBatch:
            tree, key, label = table.column(0).to_numpy(), table.column(2).to_numpy(), _labels(table.column(1), depth)
            same = (label[1:] == label[:-1]) & (tree[1:] == tree[:-1])[:, None]
            a, b = nearest(np.cumprod(same, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int8), reach, low, high)
            brief = _bytes(table.column(3), -(-n // 4))
            near = (n - differing(brief[a], brief[b])) / n >= least
            a, b = a[near], b[near]
            return pa.RecordBatch.from_arrays([pa.array(key[a]), pa.array(key[b]), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary())], names)

        head: list[pa.RecordBatch] = []
        held = 0
        kept, done = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if held < reach:
                head.append(batch.slice(0, reach - held))
                held += head[-1].num_rows
            table = batch if kept is None else pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
            ready = table.num_rows - reach
            if ready > done:
                yield pairs(table, done, ready)
                done = ready
            first = max(0, done - reach)
            kept, done = table.slice(first), done - first
        if kept is not None:
            if kept.num_rows > done:
                yield pairs(kept, done, kept.num_rows)
            for part in [*head, kept.slice(max(0, kept.num_rows - reach))]:
                yield pa.RecordBatch.from_arrays([part.column(2), pa.nulls(part.num_rows, pa.int64()), part.column(0), part.column(1)], names)

    return run


def _forest_pairs(reps: DataFrame, trees: int, depth: int, reach: int, least: float = THRESHOLD - MARGIN) -> DataFrame:
    """Distinct pairs a < b of keys that are neighbours in some tree; of those whose signatures agree in less than that share of the minima, hardly any. reps: key, sig."""
    labels = reps.select("key", "sig").mapInArrow(lean(_spread(trees, depth)), "tree int, label binary, key long, sketch binary").withColumn("tie", F.hash("key", "tree"))
    order = ["tree", "label", "tie", "key"]
    ordered = labels.repartitionByRange(*order).sortWithinPartitions(*order)
    met = cut(ordered.select("tree", "label", "key", "sketch").mapInArrow(lean(_neighbours(reach, depth, trees * depth, least)), "a long, b long, tree int, label binary"))
    inner = met.where("b is not null").select("a", "b")
    # Across the ends of partitions, a few rows for each, all that share the first minimum within reach meet.
    ends = met.where("b is null").select("tree", "label", F.col("a").alias("key")).distinct()
    w = Window.partitionBy("tree", F.expr("substring(label, 1, 2)")).orderBy("label", F.hash("key", "tree"), "key")
    across = ends.select("key", F.array(*[F.lag("key", i).over(w) for i in range(1, reach + 1)]).alias("past")).select(F.col("key").alias("a"), F.explode("past").alias("b")).where("b is not null")
    return inner.union(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _agree(n: int, least: float):
    """Of (a, b, sa, sb): the share of equal minima, where it is at least that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                share = (_labels(batch.column(2), n) == _labels(batch.column(3), n)).mean(axis=1)
                some = pa.array(np.flatnonzero(share >= least))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array(share).take(some)], ["a", "b", "share"])

    return run


def _exact(k: int, least: float):
    """Of (a, b, ta, tb): the pairs whose texts have that Jaccard similarity of shingles, at least."""

    def sets(column: pa.Array) -> list[np.ndarray]:
        out = []
        for _, data, offsets in text_slices(column, lower=True):
            values, first = shingles(data, offsets, k)
            out += [np.unique(values[i:j]) for i, j in zip(first, first[1:])]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, dtype=bool)
            for i, (u, v) in enumerate(zip(sets(batch.column(2)), sets(batch.column(3)))):
                both = len(np.intersect1d(u, v, assume_unique=True))
                near[i] = both >= least * (len(u) + len(v) - both)
            some = pa.array(np.flatnonzero(near))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some)], ["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the least node. By large and small stars, each round written to the shared folder; rounds grow with the logarithm of the largest component."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u").select(F.col("v").alias("x"), "m", "u")
        edges = cut(near.select(F.col("u"), F.col("m").alias("v")).union(near.select(F.col("x").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.coalesce(F.expr("sum(cast(hash(u, v) as decimal(20, 0)))"), F.lit(0))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = now


def near_duplicates(docs: DataFrame, trees: int = TREES, depth: int = DEPTH, shingle: int = SHINGLE, threshold: float = THRESHOLD, margin: float = MARGIN, reach: int = REACH, broadcast_keys: int = BROADCAST_KEYS) -> tuple[Rows, Column, DataFrame]:
    """docs under safe names, a document's key, and the documents that are in a group of at least two: key, doc_id, root (the key of the member that stays), group_id, group_size, links (different texts that were met and are near), rows (how often the row is there)."""
    rows = Rows(docs)
    n = trees * depth
    key = F.xxhash64(rows["doc_id"], rows["text"])
    keyed = rows.df.select(key.alias("key"), rows["doc_id"].alias("id"), rows["text"].alias("text"))
    sig = cut(keyed.select("key", "text").mapInArrow(lean(_sign(shingle, n)), "key long, sig binary").withColumn("same", F.xxhash64("sig")))
    # Equal signatures are one class, which its least key stands for.
    same = cut(sig.groupBy("same").agg(F.min("key").alias("rep"), F.max("key").alias("last")))
    reps = cut(sig.join(same.select("same", F.col("rep").alias("key")), ["same", "key"], "left_semi").select("key", "sig").dropDuplicates(["key"]))
    pairs = _forest_pairs(reps, trees, depth, reach, threshold - margin)
    met = pairs.join(reps.select(F.col("key").alias("a"), F.col("sig").alias("sa")), "a").join(reps.select(F.col("key").alias("b"), F.col("sig").alias("sb")), "b")
    met = cut(met.select("a", "b", "sa", "sb").mapInArrow(lean(_agree(n, threshold - margin)), "a long, b long, share double"))
    close = met.where(F.col("share") < threshold + margin).select("a", "b")
    wanted = cut(close.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    texts = cut(keyed.select("key", "text").join(small(wanted, broadcast_keys), "key", "left_semi").dropDuplicates(["key"]))
    exact = close.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
    exact = exact.select("a", "b", "ta", "tb").mapInArrow(lean(_exact(shingle, threshold)), "a long, b long")
    near = cut(met.where(F.col("share") >= threshold + margin).select("a", "b").union(exact))
    groups = components(near)
    links = near.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    # The class of each document, its root, and how often each document is there.
    ids = keyed.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("rows"))
    classes = same.join(groups.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left")
    classes = classes.select("same", F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), (F.col("root").isNotNull() | (F.col("rep") != F.col("last"))).alias("many"))
    members = sig.select("key", "same").distinct().join(classes, "same").join(ids, "key").where("many or rows > 1").select("key", "id", "rows", "root", "links")
    stays = members.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "key")).alias("s"), F.sum("rows").alias("group_size"))
    found = members.join(stays, "root").select("key", F.col("id").alias("doc_id"), F.col("s.key").alias("root"), F.col("s.id").alias("group_id"), "group_size", "links", "rows")
    return rows, key, found


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: doc_id, group_id (the id that stays), group_size, links, for each document in a group of two or more."""
    return near_duplicates(read(spark, sf_dir, "documents"))[2].select("doc_id", "group_id", "group_size", "links")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the members of near-duplicate groups that do not stay; of repeated rows one stays."""
    rows, key, found = near_duplicates(docs)
    found = cut(found.select(F.col("key").alias("__vx_key"), F.when(F.col("key") == F.col("root"), F.col("rows")).otherwise(F.lit(0)).alias("__vx_n")))
    keyed = rows.df.withColumn("__vx_key", key).join(small(found, BROADCAST_KEYS), "__vx_key", "left").where("__vx_n is null or __vx_n > 0")
    once = keyed.where("__vx_n is null or __vx_n = 1")
    return rows.back(once).union(rows.back(keyed.where("__vx_n > 1").dropDuplicates(["__vx_key"])))
