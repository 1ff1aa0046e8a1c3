"""Line dedup by a log-template tree of fixed depth.

Tokens of a line are its parts between white space; one that holds a digit is a variable.
The tree routes a line by its number of tokens and its LEAD leading tokens to a leaf.  In a
leaf, lines join the template that shares at least SIMILAR of their tokens, and tokens that
differ become variables, or else they found a template.  A template is recurring when it
stands in MIN_DOCS unrelated documents or more, and these are at least SPREAD of all its documents;
all lines of recurring templates are dropped.  A document counts once, however often the template
stands in it, and so do documents of equal text.

Documents are unrelated when the least hashes of their word triples differ, so that copies
of one document, whose lines recur together, count about once and are left to document dedup.

Defined results: blank lines and null texts have no template and stay; a document from which
lines are dropped and in which nothing but blank lines is left goes; where it is kept, the lines
that remain are joined by line feeds and n_chars (if there is such a column) is the new
length.  Lines of a leaf are taken in the order of their hashes, so ties and repeated rows
do not matter.  An empty table stays empty.  Extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm.common import SPACE, Rows, cut, lean, mix, read, runs, span_hash, text_slices, token_span_hash, trim, window_hash

LEAD, SIMILAR, MIN_DOCS, SPREAD = 3, 0.7, 10, 0.5
#: Dropped lines' hashes are broadcast up to so many; beyond, they are joined.
BROADCAST_LINES = 4_000_000
#: And so are the leaves that recur.
BROADCAST_LEAVES = 1_000_000

_U = np.uint64
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_VARIABLE = _U(0x5BD1E995C0FFEE11)
_LINE = np.zeros(256, dtype=bool)
_LINE[:] = True
_LINE[10] = False


class Lines:
    """Lines of the rows of a slice that have tokens."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lead: int):
        self.starts, self.ends = runs(data, offsets, _LINE)
        tok_start, tok_end = runs(data, offsets, ~SPACE)
        first = np.searchsorted(tok_start, self.starts)
        last = np.searchsorted(tok_start, self.ends)
        some = last > first
        self.starts, self.ends, first, last = self.starts[some], self.ends[some], first[some], last[some]
        self.row = np.searchsorted(offsets, self.starts, "right") - 1
        token = span_hash(data, tok_start, tok_end)
        raw = token.copy()
        digits = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(_DIGIT[data], out=digits[1:])
        token[digits[tok_end] > digits[tok_start]] = _VARIABLE
        self.token, self.first, self.last, self.tok_start, self.tok_end = token, first, last, tok_start, tok_end
        n = last - first
        leaf = mix(n.astype(_U))
        for i in range(lead):
            at = np.minimum(first + i, len(token) - 1)
            leaf = mix(leaf * _U(0x100000001B3) ^ np.where(i < n, token[at] if len(token) else _U(0), _U(0)))
        self.leaf = leaf
        # Hash of the whole line, by tokens.
        self.hash = token_span_hash(token, first, last)
        # The least hash of the rows' word triples.
        rows = len(offsets) - 1
        of = np.searchsorted(tok_start, offsets)
        count = np.diff(of)
        triple = window_hash(raw, 3)
        owner = np.repeat(np.arange(rows), count)
        self.sign = np.zeros(rows, dtype=_U)
        if len(triple):
            whole = owner[: len(triple)] == owner[2:][: len(triple)]
            value, who = triple[whole], owner[: len(triple)][whole]
            has, at = np.unique(who, return_index=True)
            if len(has):
                self.sign[has] = np.minimum.reduceat(value, at)
        for r in np.flatnonzero((count > 0) & (count < 3)):
            self.sign[r] = window_hash(raw[of[r] : of[r + 1]], int(count[r]))[0]


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _leaves(lead: int):
    """Distinct (leaf, sign) of each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0)):
                x = Lines(data, offsets, lead)
                if len(x.leaf):
                    yield pa.RecordBatch.from_arrays([_i64(x.leaf), _i64(x.sign[x.row])], ["leaf", "sign"])

    return run


def _lines(lead: int, hot: np.ndarray | None):
    """(leaf, line, sign, doc, text) of the lines in the leaves hot (sorted), or of all lines; doc is the hash of the document's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0)):
                x = Lines(data, offsets, lead)
                if hot is None:
                    at = np.arange(len(x.leaf))
                else:
                    at = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, x.leaf), len(hot) - 1)] == x.leaf) if len(hot) else np.zeros(0, np.int64)
                if len(at):
                    doc = span_hash(data, offsets[:-1], offsets[1:])
                    yield pa.RecordBatch.from_arrays([_i64(x.leaf[at]), _i64(x.hash[at]), _i64(x.sign[x.row[at]]), _i64(doc[x.row[at]]), pa.array([data[s:e].tobytes() for s, e in zip(x.starts[at], x.ends[at])], pa.binary())], ["leaf", "line", "sign", "doc", "text"])

    return run


def templates(token_rows: np.ndarray, similar: float) -> np.ndarray:
    """Template number of each row (rows of a leaf, in order): the most similar template, the earliest of equals, or a new one."""
    n, width = token_rows.shape
    kept = np.empty((16, width), dtype=_U)
    fixed = np.empty((16, width), dtype=bool)
    count = 0
    out = np.empty(n, dtype=np.int64)
    for i in range(n):
        row = token_rows[i]
        if count:
            score = ((kept[:count] == row) & fixed[:count]).sum(axis=1)
            best = int(score.argmax())
            if score[best] >= similar * width:
                fixed[best] &= kept[best] == row
                out[i] = best
                continue
        if count == len(kept):
            kept, fixed = np.concatenate([kept, kept]), np.concatenate([fixed, fixed])
        kept[count], fixed[count] = row, True
        out[i] = count
        count += 1
    return out


def _cluster(similar: float):
    def run(key: tuple[pa.Scalar, ...], batch: pa.Table) -> pa.Table:
        order = np.argsort(batch.column("line").to_numpy().view(_U), kind="stable")
        batch = batch.take(pa.array(order))
        text = batch.column("text").combine_chunks().cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        x = Lines(data, offsets - offsets[0], 1)
        rows = x.token.reshape(len(text), -1)
        return pa.table({"leaf": batch.column("leaf"), "line": batch.column("line"), "template": pa.array(templates(rows, similar))})

    return run


def _sorted(column: pa.ChunkedArray) -> np.ndarray:
    return np.sort(np.array(column.to_numpy(), dtype=np.int64).view(_U))


def recurring_lines(docs: DataFrame, lead: int = LEAD, similar: float = SIMILAR, min_docs: int = MIN_DOCS, spread: float = SPREAD, broadcast_leaves: int = BROADCAST_LEAVES) -> DataFrame:
    """Hashes `line` of the distinct lines whose templates recur.

    The first pass over the texts counts leaves; only lines in leaves that recur are looked at in the second.
    """
    rows = Rows(docs)
    texts = rows.df.select(rows["text"].alias("text"))
    leaves = texts.mapInArrow(lean(_leaves(lead)), "leaf long, sign long")
    hot = cut(leaves.groupBy("leaf", "sign").count().groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf"))
    form = "leaf long, line long, sign long, doc long, text binary"
    if hot.count() <= broadcast_leaves:
        lines = texts.mapInArrow(lean(_lines(lead, _sorted(hot.toArrow().column("leaf")))), form)
    else:
        lines = texts.mapInArrow(lean(_lines(lead, None)), form).join(hot, "leaf", "left_semi")
    seen = cut(lines.groupBy("leaf", "line", "sign", "doc").agg(F.first("text").alias("text")))
    distinct = seen.groupBy("leaf", "line").agg(F.first("text").alias("text"))
    named = distinct.groupBy("leaf").applyInArrow(_cluster(similar), "leaf long, line long, template long")
    spans = seen.select("leaf", "line", "sign", "doc").join(named, ["leaf", "line"]).select("leaf", "template", "sign", "doc").distinct()
    good = spans.groupBy("leaf", "template", "sign").agg(F.count("*").alias("n")).groupBy("leaf", "template").agg(F.count("*").alias("docs"), F.sum("n").alias("all")).where((F.col("docs") >= min_docs) & (F.col("docs") >= spread * F.col("all")))
    return named.join(good, ["leaf", "template"], "left_semi").select("line").distinct()


def strip_lines(text: pa.Array, drop: np.ndarray | list, lead: int = LEAD) -> pa.Array:
    """The texts without lines whose hash is in drop (a sorted array for all rows, or a list with one for each row); null where nothing is left."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    out = text.to_pylist()
    for at, data, offsets in text_slices(text):
        x = Lines(data, offsets, lead)
        if isinstance(drop, list):
            gone = np.array([len(d := drop[at + r]) > 0 and d[min(np.searchsorted(d, h), len(d) - 1)] == h for r, h in zip(x.row, x.hash)], dtype=bool)
        else:
            gone = drop[np.minimum(np.searchsorted(drop, x.hash), len(drop) - 1)] == x.hash if len(drop) else np.zeros(len(x.hash), bool)
        first = np.searchsorted(x.row, np.arange(len(offsets)))
        for r in np.unique(x.row[gone]):
            lo, hi = first[r], first[r + 1]
            if gone[lo:hi].all():
                out[at + r] = None
                continue
            dropped = set(x.starts[lo:hi][gone[lo:hi]].tolist())
            parts, pos = [], int(offsets[r])
            for part in data[offsets[r] : offsets[r + 1]].tobytes().split(b"\n"):
                if pos not in dropped:
                    parts.append(part)
                pos += len(part) + 1
            out[at + r] = b"\n".join(parts).decode()
    return pa.array(out, pa.string())


def _hashes(lead: int):
    """(key, line) of all lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_slices(batch.column(1)):
                x = Lines(data, offsets, lead)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(x.row + at)), _i64(x.hash)], ["__vx_key", "line"])

    return run


def drop_recurring(docs: DataFrame, lead: int = LEAD, similar: float = SIMILAR, min_docs: int = MIN_DOCS, spread: float = SPREAD, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """docs without the lines of recurring templates."""
    lines = cut(recurring_lines(docs, lead, similar, min_docs, spread))
    rows = Rows(docs)
    text = rows["text"]
    # As functions that are not called again for a filter on what they return.
    if lines.count() <= broadcast_lines:
        drop = _sorted(lines.toArrow().column("line"))

        def strip(text: pa.Array) -> pa.Array:
            out = strip_lines(text, drop, lead)
            trim()
            return out

        new = rows.df.withColumn("__vx_new", F.arrow_udf(strip, "string").asNondeterministic()(text))
    else:
        keyed = rows.df.withColumn("__vx_key", F.xxhash64(text))
        each = keyed.select("__vx_key", text).mapInArrow(lean(_hashes(lead)), "__vx_key long, line long").join(lines, "line").groupBy("__vx_key").agg(F.collect_set("line").alias("__vx_drop"))

        def strip_each(text: pa.Array, drop: pa.Array) -> pa.Array:
            out = strip_lines(text, [np.sort(np.array(d or [], dtype=np.int64).view(_U)) for d in drop.to_pylist()], lead)
            trim()
            return out

        new = keyed.join(each, "__vx_key", "left").withColumn("__vx_new", F.arrow_udf(strip_each, "string").asNondeterministic()(text, F.col("__vx_drop")))
    new = new.where(text.isNull() | F.col("__vx_new").isNotNull())
    put = {rows.inner_name("text"): F.col("__vx_new")}
    if "n_chars" in rows:
        put[rows.inner_name("n_chars")] = F.when(F.col("__vx_new").eqNullSafe(text), rows["n_chars"]).otherwise(F.length("__vx_new").cast(rows.kind("n_chars")))
    return rows.back(new.select(*[put.get(c, F.col(c)).alias(c) for c in rows.inner]))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that are left, without the lines of recurring templates."""
    return drop_recurring(read(spark, sf_dir, "documents"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the lines of recurring templates."""
    return drop_recurring(docs)
