"""Deterministic embeddings by hashing, without a model, as Arrow functions of whole batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

_U = np.uint64
_INVERSE = pow(33, -1, 1 << 64)
#: Values hashed at a time.
_CHUNK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=_U)
    while len(out) < n:
        out = np.concatenate([out, out * _U(pow(base, len(out), 1 << 64))])
    return out[:n]


_UP, _DOWN = _powers(33, _CHUNK + 1), _powers(_INVERSE, _CHUNK + 1)


def _hash(values: np.ndarray) -> int:
    """h = 33 h + x over the values from 5381, modulo 2**64, chunk by chunk as products with the powers of 33."""
    h = 5381
    for a in range(0, len(values), _CHUNK):
        part = values[a : a + _CHUNK].astype(_U)
        n = len(part)
        h = (h * pow(33, n, 1 << 64) + int((part * _UP[:n][::-1]).sum(dtype=_U))) % (1 << 64)
    return h


def _hashes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The hashes of consecutive runs of values, a chunk of runs at a time."""
    out = np.empty(len(offsets) - 1, dtype=_U)
    i = 0
    while i < len(out):
        j = int(np.searchsorted(offsets, offsets[i] + _CHUNK, "right")) - 1
        if j <= i:
            out[i] = _hash(values[offsets[i] : offsets[i + 1]])
            i += 1
            continue
        at = offsets[i : j + 1] - offsets[i]
        total = np.zeros(at[-1] + 1, dtype=_U)
        np.cumsum(values[offsets[i] : offsets[j]].astype(_U) * _DOWN[: at[-1]], out=total[1:])
        n = at[1:] - at[:-1]
        last = np.maximum(at[1:] - 1, 0)
        out[i:j] = _U(5381) * _UP[n] + np.where(n > 0, (total[at[1:]] - total[at[:-1]]) * _UP[last], _U(0))
        i = j
    return out


def text_hash(text: Column) -> Column:
    """The hash of the code points, as DECIMAL(20, 0)."""

    @F.arrow_udf("bigint")
    def run(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        sizes = np.cumsum([0, *[len(t) if t else 0 for t in texts]])
        h = _hashes(np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), dtype=np.uint32), sizes)
        return pa.array(h.view(np.int64), mask=np.array([t is None for t in texts], dtype=bool))

    h = run(text).cast("decimal(20,0)")
    return F.when(h < 0, h + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(h).cast("decimal(20,0)")


def spread(hash: Column, dim: int) -> Column:
    """A hash's elements ((h + i) mod 1000) / 1000 at unit length: one of a thousand vectors."""
    raw = (np.arange(1000)[:, None] + np.arange(dim)) % 1000 / 1000.0
    every = raw / np.linalg.norm(raw, axis=1, keepdims=True)

    @F.arrow_udf("array<double>")
    def rows(base: pa.Array) -> pa.Array:
        some = base.is_valid().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(np.where(some, dim, 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(every[base.drop_null().to_numpy()].ravel()))
        return pa.compute.if_else(pa.array(some), lists, pa.scalar(None, pa.list_(pa.float64())))

    return rows((hash % 1000).cast("int"))


def _spread(h: int, dim: int) -> np.ndarray:
    raw = (h % 1000 + np.arange(dim)) % 1000 / 1000.0
    return raw / np.linalg.norm(raw)


def embed_text(text: Column, dim: int = 384, hash: Column | None = None) -> Column:
    """Blank text has zeros; null stays null. hash: the text's, if it is at hand."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    return F.when(text.isNull(), F.lit(None).cast("array<double>")).when(~text.rlike(r"\S"), zeros).otherwise(spread(text_hash(text) if hash is None else hash, dim))


def embed_image(data: Column, dim: int = 768) -> Column:
    """By the first 1000 bytes."""

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if b is None else _spread(_hash(np.frombuffer(b[:1000], dtype=np.uint8)), dim) for b in column.to_pylist()], pa.list_(pa.float64()))

    return run(data)


def embed_audio(data: Column, dim: int = 768) -> Column:
    """Means of dim equal chunks of 16-bit samples, little-endian; zeros for fewer samples than dim."""

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        def one(raw):
            if raw is None:
                return None
            x = np.frombuffer(raw[: len(raw) // 2 * 2], dtype="<i2") / 32768.0
            chunk = len(x) // dim
            return x[: chunk * dim].reshape(dim, chunk).mean(axis=1) if chunk else np.zeros(dim)

        return column.map(one)

    return run(data)


def embed_video(frames: Column, dim: int = 768) -> Column:
    """Of an array of frames (binary): each has its share of the elements, by its hash, at unit length together; zeros without frames."""

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        def one(rows):
            if rows is None:
                return None
            out = np.zeros(dim)
            share = dim // max(1, len(rows))
            for i, frame in enumerate(rows):
                at = np.arange(i * share, min((i + 1) * share, dim))
                out[at] = (_hash(np.frombuffer(frame, dtype=np.uint8)) % 1000 + at) % 1000 / 1000.0
            return out / (np.linalg.norm(out) or 1.0)

        return column.map(one)

    return run(frames)


def _near(x: np.ndarray, reach: float) -> np.ndarray:
    """How many points, itself included, are nearer to each point than reach: by cells of that size, of which only neighbours are compared."""
    cell = np.floor(x / reach).astype(np.int64)
    cells: dict[tuple, list[int]] = {}
    for i, c in enumerate(map(tuple, cell.tolist())):
        cells.setdefault(c, []).append(i)
    out = np.zeros(len(x))
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    for (a, b, c), own in cells.items():
        around = [i for s in steps for i in cells.get((a + s[0], b + s[1], c + s[2]), ())]
        out[own] = (np.linalg.norm(x[own][:, None] - x[around][None], axis=2) < reach).sum(axis=1)
    return out


def _cloud(rows, dim: int, reach: float) -> np.ndarray:
    x = np.array([list(r) for r in rows], dtype=float) if rows is not None and len(rows) else np.zeros((0, 3))
    out = np.zeros(dim)
    if not len(x):
        return out
    part = dim // 7
    extent = np.maximum(x.max(axis=0) - x.min(axis=0), 0.001)
    at = np.arange(part) % len(x)
    out[: 3 * part] = ((x[at] - x.mean(axis=0)) / extent).T.ravel()
    out[3 * part : 4 * part] = _near(x, reach)[at] / len(x)
    out[4 * part : 7 * part] = np.repeat(extent / extent.sum(), part)
    return out / (np.linalg.norm(out) or 1.0)


def embed_points(points: Column, dim: int = 1024, reach: float = 0.1) -> Column:
    """Of an array of [x, y, z]: seven parts of the elements, for the points' places from the centre by extent, the shares of points around each, and the extents; at unit length."""

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda rows: _cloud(rows, dim, reach))

    return run(points)


def embed_voxels(data: Column, shape: tuple[int, int, int], dim: int = 1024) -> Column:
    """Of a grid of bytes, x fastest: as embed_points of the places that are not zero."""

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        def one(raw):
            at = np.flatnonzero(np.frombuffer(raw or b"", dtype=np.uint8)[: shape[0] * shape[1] * shape[2]])
            return _cloud(np.column_stack([at % shape[0], at // shape[0] % shape[1], at // (shape[0] * shape[1])]), dim, 0.1)

        return column.map(one)

    return run(data)


def route(kind: Column, text: Column, data: Column, points: Column | None = None, frames: Column | None = None, dim: int = 384) -> Column:
    """The embedding that fits the kind of a record: text, image, audio, video (frames) or pointcloud (points); null for other kinds."""
    out = F.when(kind == "text", embed_text(text, dim)).when(kind == "image", embed_image(data, dim)).when(kind == "audio", embed_audio(data, dim))
    if frames is not None:
        out = out.when(kind == "video", embed_video(frames, dim))
    return out if points is None else out.when(kind == "pointcloud", embed_points(points, dim))
