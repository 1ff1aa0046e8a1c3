"""Shared pieces: tables under safe names, shared-folder checkpoints and vectorised kernels over Arrow text columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BASE2 = 0xD1342543DE82EF95
_INV2 = pow(_BASE2, -1, 1 << 64)
#: Text is worked through in slices of about so many bytes, which keeps arrays in cache.
SLICE_BYTES = 1 << 19
#: Hashes of longer spans are put together from blocks of so many values, so that tables of powers stay small.
BLOCK = 1 << 16
#: Rows with texts go to Python in Arrow batches of about so many bytes, unless the session says otherwise.
BATCH_BYTES = "4m"

#: ASCII letters and digits, and all bytes of characters beyond ASCII, make up words.
WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class Rows:
    """A table under positional names, so that dots, cases and clashes in the names of its columns cannot matter."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.inner = [f"__vx_c{i}" for i in range(len(self.names))]
        self.kinds = [f.dataType for f in df.schema.fields]
        self.df = df.toDF(*self.inner)
        self.spark = df.sparkSession
        if self.spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
            self.spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def _at(self, name: str) -> int:
        """The column of that name; if there is none, the first of that name in another case."""
        same = [i for i, n in enumerate(self.names) if n == name] or [i for i, n in enumerate(self.names) if n.lower() == name.lower()]
        if not same:
            raise ValueError(f"no column {name!r} among {self.names}")
        return same[0]

    def __contains__(self, name: str) -> bool:
        return any(n.lower() == name.lower() for n in self.names)

    def __getitem__(self, name: str) -> Column:
        return F.col(self.inner[self._at(name)])

    def inner_name(self, name: str) -> str:
        return self.inner[self._at(name)]

    def kind(self, name: str) -> T.DataType:
        return self.kinds[self._at(name)]

    def back(self, df: DataFrame) -> DataFrame:
        """df's columns of the table, under their own names."""
        return df.select(*self.inner).toDF(*self.names)


def form(**kinds: T.DataType | str) -> T.StructType:
    """A schema from names and types."""
    named = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "binary": T.BinaryType()}
    return T.StructType([T.StructField(n, named[k] if isinstance(k, str) else k) for n, k in kinds.items()])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one only where that is unset and Spark is local."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = sc._jsc.sc().getCheckpointDir().getOrElse(None) if sc._jsc.sc().getCheckpointDir().isDefined() else None
        if not named:
            named = "file://" + tempfile.mkdtemp(prefix="vexel-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder's name in the shared folder; the folder is deleted when the driver ends."""
    name = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return name


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, so that a lost executor costs no recomputation. The shuffle files that made it go at once."""
    spark = df.sparkSession
    shared_dir(spark)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small(df: DataFrame, most: int) -> DataFrame:
    """df, which cut() gave, marked for broadcast if it has no more rows than that; else it is joined by shuffle."""
    return F.broadcast(df) if df.count() <= most else df


_libc: list = []


def trim() -> None:
    """Gives freed memory back to the system, so that idle workers hold little."""
    pa.default_memory_pool().release_unused()
    if not _libc:
        try:
            _libc.append(ctypes.CDLL(None).malloc_trim)
        except (OSError, AttributeError):
            _libc.append(lambda _: 0)
    _libc[0](0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run over the batches of a partition, with Arrow's memory from the system's allocator and freed memory given back."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())

        def each() -> Iterator[pa.RecordBatch]:
            for i, batch in enumerate(batches):
                yield batch
                del batch
                if i % 8 == 7:
                    trim()

        yield from run(each())
        trim()

    return over


def mix(x: np.ndarray) -> np.ndarray:
    """The bijective finaliser of splitmix64."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Powers:
    """base**i and its inverse modulo 2**64."""

    def __init__(self, base: int, inverse: int):
        self.base, self.inverse = base, inverse
        self.up = self.down = np.ones(1, dtype=_U)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(1, dtype=_U)
        while len(out) < n:
            out = np.concatenate([out, out * _U(pow(base, len(out), 1 << 64))])
        return out

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = self._powers(self.base, n), self._powers(self.inverse, n)
        return self.up, self.down

    def spans(self, values: np.ndarray, plus: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For sorted spans that do not overlap, the sum of (value + plus) * base**i, i counted from the span's start; block by block."""
        up, down = self.get(BLOCK + 1)
        out = np.zeros(len(starts), dtype=_U)
        i = 0
        while i < len(starts):
            low = int(starts[i])
            j = int(np.searchsorted(ends, low + BLOCK, "right"))
            if j > i:
                high = int(ends[j - 1])
                total = np.zeros(high - low + 1, dtype=_U)
                np.cumsum((values[low:high].astype(_U, copy=False) + _U(plus)) * up[: high - low], out=total[1:])
                s = starts[i:j] - low
                out[i:j] = (total[ends[i:j] - low] - total[s]) * down[s]
                i = j
                continue
            factor = 1
            for a in range(low, int(ends[i]), BLOCK):
                part = values[a : min(a + BLOCK, int(ends[i]))].astype(_U, copy=False) + _U(plus)
                out[i] += _U(factor) * (part * up[: len(part)]).sum(dtype=_U)
                factor = factor * pow(self.base, BLOCK, 1 << 64) % (1 << 64)
            i += 1
        return out


_BYTES, _TOKENS = _Powers(_BASE, _INV), _Powers(_BASE2, _INV2)


def text_slices(column: pa.Array, lower: bool = False, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of a string column in slices: first row, bytes, offsets of the rows in the bytes. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
        if lower:
            # Slice by slice, so that the whole batch is not there twice.
            part = pc.utf8_lower(column.slice(at, to - at))
            ends = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset : part.offset + len(part) + 1]
            flat = np.frombuffer(part.buffers()[2], dtype=np.uint8) if part.buffers()[2] is not None else np.zeros(0, np.uint8)
            yield at, flat[ends[0] : ends[-1]], ends - ends[0]
        else:
            yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes for which the table `inside` is true; rows and `breaks` end runs."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    member = inside[data]
    cut_at = np.zeros(n + 1, dtype=bool)
    cut_at[offsets] = True
    if breaks is not None:
        cut_at[breaks] = True
    first = member.copy()
    first[1:] &= ~member[:-1] | cut_at[1:n]
    last = member.copy()
    last[:-1] &= ~member[1:] | cut_at[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that are sorted and do not overlap; equal spans have equal hashes wherever they stand."""
    return mix(_BYTES.spans(data, 1, starts, ends))


def token_span_hash(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of tokens, sorted and not overlapping, wherever they stand."""
    return mix(_TOKENS.spans(tokens, 0, starts, ends) ^ mix((ends - starts).astype(_U)))


def window_hash(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of k tokens, wherever it stands; len(tokens) - k + 1 of them, none if that is not positive."""
    n = len(tokens) - k + 1
    if n < 1:
        return np.zeros(0, dtype=_U)
    up, down = _TOKENS.get(BLOCK + k)
    out = np.empty(n, dtype=_U)
    for a in range(0, n, BLOCK):
        b = min(a + BLOCK, n)
        part = tokens[a : b + k - 1]
        total = np.zeros(len(part) + 1, dtype=_U)
        np.cumsum(part * up[: len(part)], out=total[1:])
        out[a:b] = (total[k:] - total[:-k]) * down[: b - a]
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the rows: starts, ends, hashes, and the index of each row's first word (one more entry than rows)."""
    starts, ends = runs(data, offsets, WORD)
    return starts, ends, span_hash(data, starts, ends), np.searchsorted(starts, offsets)
