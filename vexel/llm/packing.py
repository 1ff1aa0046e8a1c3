"""Packing of documents into windows of equal capacity by Karmarkar-Karp multiway differencing.

A document's size is its number of tokens, counted as in token_count.  Sizes beyond the capacity
are cut, at token positions, into full windows and a rest.  The rests of all documents are put
in order of size, all over the cluster, and dealt out to cells like cards, forth and back, so
that cells have nearly the same sizes and the same sum; what one cell has too much, it gets
too little in the next turn.  A cell has about WINDOWS windows, however many documents those
take, and CELL_ROWS rests at most; the number of cells follows from the sums.

In a cell with m windows every rest starts as a partial partition (its size and m - 1 empty
windows); the two partitions with the largest imbalance are merged again and again, largest
windows against smallest, until one is left.  If its largest window exceeds the capacity, m rises and
the cell is packed anew: m doubles its step while it fails and halves it after, down to the
least m met that holds.

Defined results: a null or empty text has size 0 and joins a window without filling it; a
cell of such texts has one window; null ids are packed like others, and ids keep their type;
repeated rows are packed each; equal sizes are taken in the order of a hash of id and text;
an empty table gives no windows.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.llm.common import cut, form, lean, read
from vexel.llm.token_count import count_tokens

CAPACITY, WINDOWS, CELL_ROWS = 4096, 128, 16384

def differencing(sizes: list[int], m: int) -> list[list[int]]:
    """Indices of sizes in m windows of nearly equal sums. Partitions hold their non-empty windows only, by falling sum."""
    if not sizes:
        return [[] for _ in range(m)]
    # A partition: imbalance, order, sums (falling, less than m of them if the rest are 0), members.
    heap = [(-s, i, [s], [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, sa, ma = heapq.heappop(heap)
        _, _, sb, mb = heapq.heappop(heap)
        if len(sa) + len(sb) <= m:
            sums, members = sa + sb, ma + mb
        else:
            # The largest of one meet the smallest of the other.
            over = len(sa) + len(sb) - m
            sums, members = list(sa), list(ma)
            la = len(sa)
            sums += sb[: len(sb) - over]
            members += mb[: len(sb) - over]
            for j in range(over):
                # b's j-th smallest joins a's windows from the smallest upwards only as far as they must.
                i, k = la - over + j, len(sb) - 1 - j
                sums[i] += sb[k]
                members[i] = members[i] + mb[k]
        order = sorted(range(len(sums)), key=lambda i: -sums[i])
        sums, members = [sums[i] for i in order], [members[i] for i in order]
        tick += 1
        heapq.heappush(heap, (-(sums[0] - (sums[-1] if len(sums) == m else 0)), tick, sums, members))
    _, _, _, members = heap[0]
    return members + [[] for _ in range(m - len(members))]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of indices; no window's sum exceeds capacity (no size does)."""
    worst = lambda w: max(sum(sizes[i] for i in x) for x in w)
    m = max(1, -(-sum(sizes) // capacity))
    held = differencing(sizes, m)
    if worst(held) <= capacity:
        return held
    step, low = 1, m
    while True:
        high = low + step
        held = differencing(sizes, high)
        if worst(held) <= capacity:
            break
        low, step = high, step * 2
    while high - low > 1:
        mid = (low + high) // 2
        tried = differencing(sizes, mid)
        if worst(tried) <= capacity:
            high, held = mid, tried
        else:
            low = mid
    return held


def _pack_cell(capacity: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("i", "ascending")])
        sizes = table.column("size").to_pylist()
        names, order, totals = [], [], []
        for window, members in enumerate(w for w in pack(sizes, capacity) if w):
            total = sum(sizes[i] for i in members)
            order += sorted(members)
            names += [f"{key[0].as_py()}-{window}"] * len(members)
            totals += [total] * len(members)
        took = table.take(pa.array(order, pa.int64()))
        return pa.table({"window_id": pa.array(names, pa.string()), "doc_id": took.column("doc_id"), "start": took.column("start"), "tokens": took.column("size"), "window_tokens": pa.array(totals, pa.int64())})

    return run


def _ranked(first: dict[int, int]):
    """Rows of a partition in order, with their place i among all rows; first: the place of each partition's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = first.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + batch.num_rows))], [*batch.schema.names, "i"])
            at += batch.num_rows

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, windows: int = WINDOWS, cell_rows: int = CELL_ROWS, vocabulary: str | None = None) -> DataFrame:
    """One row for each piece of a document in a window: window_id, doc_id, start and tokens (in tokens of the document), window_tokens (the window's sum).

    Texts are read once, where they are; only ids and sizes are shuffled.
    """
    kind = docs.schema[[c.lower() for c in docs.columns].index("doc_id")].dataType
    sized = cut(count_tokens(docs, vocabulary).withColumn("size", F.col("n_tokens") % capacity))
    ordered = cut(sized.repartitionByRange(F.col("size").desc(), "key").sortWithinPartitions(F.col("size").desc(), "key"))
    parts = ordered.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum("size").alias("s")).collect()
    first, count = {}, 0
    for r in sorted(parts):
        first[r.p], count = count, count + r.n
    cells = max(1, -(-sum(r.s for r in parts) // (capacity * windows)), -(-count // cell_rows))
    placed = ordered.mapInArrow(lean(_ranked(first)), T.StructType([*ordered.schema.fields, T.StructField("i", T.LongType())]))
    out = form(window_id="string", doc_id=kind, start="long", tokens="long", window_tokens="long")
    full = placed.where(F.col("n_tokens") >= capacity).select("doc_id", "i", F.explode(F.sequence(F.lit(0), F.floor(F.col("n_tokens") / capacity) - 1)).alias("j"))
    full = full.select(F.concat_ws("+", "i", "j").alias("window_id"), "doc_id", (F.col("j") * capacity).alias("start"), F.lit(capacity).cast("long").alias("tokens"), F.lit(capacity).cast("long").alias("window_tokens"))
    rest = placed.where((F.col("size") > 0) | (F.col("n_tokens") == 0)).withColumn("start", F.col("n_tokens") - F.col("size"))
    turn = F.col("i") % (2 * cells)
    dealt = rest.withColumn("cell", F.when(turn < cells, turn).otherwise(2 * cells - 1 - turn))
    # Cells are light to move and heavy to pack: a number that is given is not coalesced at run time.
    tasks = min(cells, 20_000, max(docs.sparkSession.sparkContext.defaultParallelism, cells // 16))
    packed = dealt.repartition(tasks, "cell").groupBy("cell").applyInArrow(_pack_cell(capacity), out)
    return packed.unionByName(full)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of all documents."""
    return pack_documents(read(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The windows of docs."""
    return pack_documents(docs)
