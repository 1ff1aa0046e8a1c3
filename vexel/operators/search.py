"""Exact vector search: single and batch k-NN, range search, nearest scalars, inverted files and product quantization."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexel.functions import vector as V


def checked(v: Column, dim: int) -> Column:
    """v, or an error if its length is not dim."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(v).cast("string"))))


def _literal(query: Sequence[float]) -> Column:
    return F.lit([float(x) for x in query]) if len(query) else F.array().cast("array<double>")


def with_distance(items: DataFrame, query: Sequence[float], metric: str = "cosine", vector: str = "embedding") -> DataFrame:
    """items that have a vector, with a column `distance`. The query is a literal, so the scan stays one stage."""
    return items.where(F.col(vector).isNotNull()).withColumn("distance", F.round(V.metric(metric)(checked(F.col(vector), len(query)), _literal(query)), 6) + 0.0)


def knn(items: DataFrame, query: Sequence[float], k: int = 10, metric: str = "cosine", id: str = "vec_id", vector: str = "embedding", where: Column | None = None, filter_mode: str = "pre", overfetch: int = 2) -> DataFrame:
    """The k nearest items, ties by id. The predicate holds before the search; with filter_mode="post" it is put to the overfetch * k nearest, which can leave fewer than k."""
    if where is not None and filter_mode == "pre":
        items = items.where(where)
    near = with_distance(items, query, metric, vector).orderBy("distance", id).limit(k if where is None or filter_mode == "pre" else k * overfetch)
    return near if where is None or filter_mode == "pre" else near.where(where).orderBy("distance", id).limit(k)


def within(items: DataFrame, query: Sequence[float], most: float, metric: str = "cosine", vector: str = "embedding") -> DataFrame:
    """All items no farther than `most`."""
    return with_distance(items, query, metric, vector).where(F.col("distance") <= most)


def nearest_scalars(items: DataFrame, value: Column, target: float, k: int, id: str) -> DataFrame:
    """The k items whose value is nearest to the target."""
    return items.withColumn("distance", F.round(F.abs(value - target), 6)).orderBy("distance", id).limit(k)


def _distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "manhattan":
        return np.stack([np.abs(x - row).sum(axis=1) for row in q])
    inner = q @ x.T
    if metric == "dot":
        return -inner
    if metric == "cosine":
        size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        return np.where(size == 0, 1.0, 1 - np.divide(inner, size, out=np.zeros_like(inner), where=size != 0))
    return np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * inner, 0))


class Nearest:
    """Of each of n rows, the k least (distance, place) so far; NaN comes after all numbers."""

    def __init__(self, n: int, k: int, place: type | str = "int64"):
        self.k, self.distance, self.place, self.count = k, np.full((n, k), np.nan), np.zeros((n, k), dtype=place), np.zeros(n, dtype="int64")

    def add(self, row: np.ndarray, distance: np.ndarray, place: np.ndarray) -> None:
        if not len(row):
            return
        rows = np.unique(row)
        held, column = np.nonzero(np.arange(self.k) < self.count[rows][:, None])
        row, distance, place = np.concatenate([rows[held], row]), np.concatenate([self.distance[rows[held], column], distance]), np.concatenate([self.place[rows[held], column], place])
        order = np.lexsort((place, distance, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        row, rank, order = row[keep], rank[keep], order[keep]
        self.distance[row, rank], self.place[row, rank] = distance[order], place[order]
        self.count[rows] = np.bincount(np.searchsorted(rows, row), minlength=len(rows))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, distance, place of all that are held."""
        row, column = np.nonzero(np.arange(self.k) < self.count[:, None])
        return row, self.distance[row, column], self.place[row, column]


def _exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """The distance of each row of a to the same row of b, to 6 decimals."""
    if metric in ("manhattan", "euclidean"):
        d = np.abs(a - b).sum(axis=1) if metric == "manhattan" else np.sqrt(np.square(a - b).sum(axis=1))
    else:
        d = -np.einsum("ij,ij->i", a, b)
        if metric == "cosine":
            size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
            d = np.where(size == 0, 1.0, 1 + np.divide(d, size, out=np.zeros_like(d), where=size != 0))
    return np.round(d, 6) + 0.0


class _Cell:
    """Queries of one cell and their nearest of the items that are put to them in the order of their ids.

    A matrix product gives each pair a score that is never above the true one by its rounding; only pairs whose score
    could still bring an item among the k nearest have their distance taken exactly.
    """

    ROWS, COLUMNS, PAIRS = 256, 8192, 100_000

    def __init__(self, q: np.ndarray, k: int, metric: str):
        self.q, self.k, self.metric, self.seen, self.gaps = q, k, metric, 0, np.zeros(0, dtype="int64")
        self.near, self.whole = Nearest(len(q), k), ~np.isnan(q).any(axis=1)
        self.error = (q.shape[1] + 8) * 1e-15
        self.qq = np.square(q).sum(axis=1)
        left = {"euclidean": -2 * q, "dot": -q, "cosine": -_unit(q)}.get(metric, q)
        self.left = left if metric == "manhattan" else np.column_stack([left, np.ones(len(q))])

    def put(self, x: np.ndarray) -> None:
        # Blocks as long as all before them: each brings about k candidates a query.
        while len(x):
            n = min(len(x), max(2 * self.k, 512, min(self.seen, self.COLUMNS)))
            self._block(x[:n])
            x = x[n:]

    def _block(self, x: np.ndarray) -> None:
        place = self.seen + np.arange(len(x))
        self.seen += len(x)
        whole = ~np.isnan(x).any(axis=1)
        if not whole.all():
            self.gaps = np.concatenate([self.gaps, place[~whole]])[: self.k]
            x, place = x[whole], place[whole]
        if not len(x):
            return
        xx = np.square(x).sum(axis=1)
        add = {"euclidean": xx * (1 - self.error), "dot": -self.error * xx}.get(self.metric, np.full(len(x), -self.error))
        right = x if self.metric == "manhattan" else np.column_stack([_unit(x) if self.metric == "cosine" else x, add])
        for at in range(0, len(self.q), self.ROWS):
            rows = slice(at, at + self.ROWS)
            score = _distances(self.left[rows], right, "manhattan") if self.metric == "manhattan" else self.left[rows] @ right.T
            kth, full = self.near.distance[rows, -1], self.near.count[rows] == self.k
            # A later item wins only by a smaller distance, less by half a unit of the sixth decimal.
            limit = np.where(full & ~np.isnan(kth), kth - 4e-7 + np.abs(kth) * 1e-14, np.inf)
            if len(x) >= self.k and not full.all():
                limit = np.fmin(limit, self._far(np.partition(score, self.k - 1, axis=1)[:, self.k - 1], rows, xx.max()) + 2e-6)
            hit = ~(score > self._least(limit, rows)[:, None]) & self.whole[rows][:, None]
            row, column = np.nonzero(hit)
            for part in range(0, len(row), self.PAIRS):
                r, c = row[part : part + self.PAIRS] + at, column[part : part + self.PAIRS]
                self.near.add(r, _exact(self.q[r], x[c], self.metric), place[c])

    def _least(self, distance: np.ndarray, rows: slice) -> np.ndarray:
        """The score that no pair within the distance exceeds."""
        e, qq = self.error, self.qq[rows]
        if self.metric == "euclidean":
            return np.where(distance < 0, -np.inf, distance * np.abs(distance) - qq * (1 - e))
        return {"dot": distance + e * (qq + np.abs(distance)), "cosine": distance - 1 + e}.get(self.metric, distance * (1 + e))

    def _far(self, score: np.ndarray, rows: slice, xx: float) -> np.ndarray:
        """The distance that no pair of the score exceeds, xx being the greatest square of an item."""
        e, qq = self.error, self.qq[rows]
        if self.metric == "euclidean":
            return np.sqrt(np.maximum(score + qq + 4 * e * (qq + xx), 0))
        return {"dot": score + 4 * e * (qq + xx), "cosine": 1 + score + 4 * e}.get(self.metric, score * (1 + 4 * e))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, distance, place; a vector with NaN is at distance NaN from all."""
        for rows, places in ((np.flatnonzero(self.whole & (self.near.count < self.k)), self.gaps), (np.flatnonzero(~self.whole), np.arange(min(self.k, self.seen)))):
            self.near.add(np.repeat(rows, len(places)), np.full(len(rows) * len(places), np.nan), np.tile(places, len(rows)))
        return self.near.rows()


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size != 0)


#: Most numbers that a side of a cell holds.
NUMBERS = 1 << 22


def _sized(rows: DataFrame, by: list[str]) -> dict[tuple, tuple[int, int]]:
    """Of each group the number of rows and of dimensions."""
    return {tuple(r[c] for c in by): (r.n, r.dim or 0) for r in rows.groupBy(*by).agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).collect() if r.n}


def _nearest(queries: DataFrame, items: DataFrame, k: int, metric: str, query_id: str, id: str, vector: str, by: list[str], block: int | None) -> DataFrame:
    """query_id, id, distance, rank of the k nearest, among the pairs that agree in `by` (of few groups; none: all pairs).

    The pairs of a group are a rectangle, cut into cells of at most about `block` by `block` rows, and a task has whole cells:
    what it reads and holds is bounded, whatever the tables' sizes, and of a query k candidates leave each cell.
    """
    spark = items.sparkSession
    kind_q, kind_i = queries.schema[query_id].dataType.simpleString(), items.schema[id].dataType.simpleString()
    kinds = {df.schema[vector].dataType.simpleString() for df in (queries, items)}
    kind_v = "array<float>" if kinds == {"array<float>"} else "array<double>"
    pick = lambda df, key: df.where(F.col(vector).isNotNull()).select(*by, F.col(key).alias("i"), F.col(vector).cast(kind_v).alias("v"))
    q, x = pick(queries, query_id), pick(items, id)
    size_q, size_x = _sized(q, by), _sized(x, by)
    groups = [g for g in size_q if g in size_x]
    schema = f"query_id {kind_q}, id {kind_i}, distance double"
    if not groups or k < 1:
        found = spark.createDataFrame([], schema)
    else:
        parallel, work = max(1, spark.sparkContext.defaultParallelism), sum(size_q[g][0] * size_x[g][0] for g in groups)
        side = block or max(1, min(NUMBERS // max(k, 1, *(d for s in (size_q, size_x) for _, d in s.values())), max(512, int((work / (3 * parallel)) ** 0.5))))
        grid, cells = [], 0
        for g in groups:
            down, across = (-(-s[g][0] // side) for s in (size_q, size_x))
            grid.append((*g, cells, down, across))
            cells += down * across
        tasks = min(cells, max(4 * parallel, -(-2 * work // side**2)))
        names = ["__first", "__down", "__across"]
        # The groups' sizes were collected, so they are few enough to be broadcast.
        put = (lambda df: df.join(F.broadcast(spark.createDataFrame(grid, [*by, *names])), by)) if by else (lambda df: df.withColumns(dict(zip(names, map(F.lit, grid[0])))))
        first, down, across = map(F.col, names)
        mine = lambda n: F.pmod(F.xxhash64("i"), n)
        span = lambda n, f: F.explode(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), f).cast("array<bigint>")).alias("cell")
        none = lambda kind: F.lit(None).cast(kind)
        asked = put(q).select(span(across, lambda j: first + mine(down) * across + j), F.lit(0).alias("side"), F.col("i").alias("qi"), none(kind_i).alias("xi"), "v")
        given = put(x).select(span(down, lambda j: first + j * across + mine(across)), F.lit(1).alias("side"), none(kind_q).alias("qi"), F.col("i").alias("xi"), "v")
        dealt = asked.unionByName(given).repartitionById(tasks, (F.col("cell") % tasks).cast("int")).sortWithinPartitions("cell", "side", "xi")
        found = dealt.mapInArrow(_searcher(k, metric), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.isnan("distance"), "distance", "id")).cast("long")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query_id").alias(query_id), F.col("id").alias(id), "distance", "rank")


def _searcher(k: int, metric: str):
    """For mapInArrow over rows (cell, side, qi, xi, v) in order of cell, side and xi."""

    def matrix(v: pa.ListArray, dims: set) -> np.ndarray:
        dims |= set(np.unique(np.diff(v.offsets.to_numpy())).tolist())
        if len(dims) > 1:
            raise ValueError(f"vectors of {sorted(dims)} dimensions cannot be compared")
        return v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), max(dims))

    def run(batches):
        now, q, qi, xi, cell, dims = None, [], [], [], None, set()

        def ended():
            if cell is not None:
                row, distance, place = cell.rows()
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(qi).take(pa.array(row)), pa.concat_arrays(xi).take(pa.array(place)), pa.array(distance)], names=["query_id", "id", "distance"])

        for batch in batches:
            number, side = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("cell", "side"))
            starts = np.flatnonzero(np.r_[True, (np.diff(number) != 0) | (np.diff(side) != 0)]) if len(number) else []
            for a, b in zip(starts, [*starts[1:], len(number)]):
                part = batch.slice(a, b - a)
                get = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
                if number[a] != now:
                    yield from ended()
                    now, q, qi, xi, cell, dims = number[a], [], [], [], None, set()
                if side[a] == 0:
                    # Dimensions count as wrong only where there is something to compare.
                    q.append(get("v"))
                    qi.append(get("qi"))
                elif q:
                    with np.errstate(all="ignore"):
                        if cell is None:
                            cell = _Cell(np.concatenate([matrix(v, dims) for v in q]), k, metric)
                        cell.put(matrix(get("v"), dims))
                    xi.append(get("xi"))
        yield from ended()

    return run


def batch_knn(queries: DataFrame, items: DataFrame, k: int = 10, metric: str = "cosine", query_id: str = "query_id", id: str = "vec_id", vector: str = "embedding", block: int | None = None) -> DataFrame:
    """query_id, id, distance, rank: the k nearest items of every query, exactly.

    The work is the product of the sides, in cells of at most `block` rows a side (by default NUMBERS over the dimensions);
    each row is sent once to each cell of its line.  batch_probe is for less work.  Null vectors are no neighbours and, as
    queries, have none; a distance that is NaN comes last; vectors of different lengths raise.
    """
    V.metric(metric)
    return _nearest(queries, items, k, metric, query_id, id, vector, [], block)


def batch_probe(queries: DataFrame, assigned: DataFrame, centroids: np.ndarray, k: int = 10, nprobe: int = 4, metric: str = "cosine", query_id: str = "query_id", id: str = "vec_id", vector: str = "embedding", block: int | None = None) -> DataFrame:
    """As batch_knn, among the items (with `cluster`, from assign) of each query's nprobe nearest clusters; all clusters make it exact. A large cluster is many cells."""
    V.metric(metric)

    @F.pandas_udf("array<int>")
    def near(v: pd.Series) -> pd.Series:
        d = _distances(np.stack(v).astype(float), centroids, "euclidean") if len(v) else np.zeros((0, len(centroids)))
        return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :nprobe].astype("int32")))

    spread = queries.where(F.col(vector).isNotNull()).select(query_id, vector, F.explode(near(F.col(vector))).alias("cluster"))
    return _nearest(spread, assigned, k, metric, query_id, id, vector, ["cluster"], block)


def train_centroids(items: DataFrame, n: int, rounds: int = 20, id: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """n centroids by Lloyd's rounds from the n items that come first by the hash of their id; each round is one aggregation of n partial sums. A cluster that is left empty keeps its centroid."""
    first = items.select(F.col(vector).alias("v")).orderBy(F.xxhash64(id), id).limit(n).collect()
    centroids = np.array([r.v for r in first], dtype=float)
    if not len(centroids):
        return centroids

    def sums(frames):
        total, count = np.zeros_like(centroids), np.zeros(len(centroids))
        for frame in frames:
            x = np.stack(frame["v"]).astype(float)
            near = _distances(x, centroids, "euclidean").argmin(axis=1)
            np.add.at(total, near, x)
            np.add.at(count, near, 1)
        yield pd.DataFrame({"c": np.arange(len(count)), "n": count, "s": list(total)})

    for _ in range(rounds):
        parts = items.select(F.col(vector).alias("v")).mapInPandas(sums, "c int, n double, s array<double>")
        each = parts.select("c", "n", F.posexplode("s").alias("p", "x")).groupBy("c", "p").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
        new = centroids.copy()
        for r in each:
            if r.n:
                new[r.c, r.p] = r.x / r.n
        if np.allclose(new, centroids, atol=1e-12):
            break
        centroids = new
    return centroids


def assign(items: DataFrame, centroids: np.ndarray, vector: str = "embedding") -> DataFrame:
    """items with the number of their nearest centroid, `cluster`; written partitioned by it, a search reads its clusters only."""

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(_distances(np.stack(v).astype(float), centroids, "euclidean").argmin(axis=1) if len(v) else [], dtype="int32")

    return items.where(F.col(vector).isNotNull()).withColumn("cluster", nearest(F.col(vector)))


def probe(assigned: DataFrame, centroids: np.ndarray, query: Sequence[float], k: int, nprobe: int, metric: str = "cosine", id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """k-NN among the items of the nprobe nearest clusters; exact if nprobe is their number."""
    near = _distances(np.array([query], dtype=float), centroids, "euclidean")[0].argsort(kind="stable")[:nprobe]
    return knn(assigned, query, k, metric, id, vector, where=F.col("cluster").isin([int(c) for c in near]))


class ProductQuantizer:
    """m sub-vectors, each by its nearest of up to 256 centroids. What is left over by the division stays out of the codes."""

    def __init__(self, m: int = 8, size: int = 256, rounds: int = 20):
        self.m, self.size, self.rounds, self.books = m, size, rounds, []

    def train(self, items: DataFrame, id: str = "vec_id", vector: str = "embedding") -> ProductQuantizer:
        """Lloyd's rounds for all parts at once: a round is one pass over items and one aggregation of m * size partial sums."""
        first = [np.array(r.v, dtype=float) for r in items.where(F.col(vector).isNotNull()).select(F.col(vector).alias("v"), F.xxhash64(id).alias("h"), id).orderBy("h", id).limit(self.size).collect()]
        if not first:
            self.books, self.width = [], 0
            return self
        self.width = len(first[0]) // self.m
        books = [np.array([v[i * self.width : (i + 1) * self.width] for v in first]) for i in range(self.m)]
        width = self.width
        vectors = items.where(F.col(vector).isNotNull()).select(F.col(vector).alias("v"))
        for _ in range(self.rounds):
            now = books

            def sums(frames):
                total, count = np.zeros((len(now), *now[0].shape)), np.zeros((len(now), len(now[0])))
                for frame in frames:
                    if len(frame):
                        x = np.stack(frame["v"]).astype(float)
                        for i, b in enumerate(now):
                            part = x[:, i * width : (i + 1) * width]
                            near = _distances(part, b, "euclidean").argmin(axis=1)
                            np.add.at(total[i], near, part)
                            np.add.at(count[i], near, 1)
                m, c = np.indices(count.shape)
                yield pd.DataFrame({"m": m.ravel(), "c": c.ravel(), "n": count.ravel(), "s": list(total.reshape(-1, width))})

            parts = vectors.mapInPandas(sums, "m int, c int, n double, s array<double>").select("m", "c", "n", F.posexplode("s").alias("p", "x"))
            new = [b.copy() for b in now]
            for r in parts.groupBy("m", "c", "p").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
                if r.n:
                    new[r.m][r.c, r.p] = r.x / r.n
            books = new
            if all(np.allclose(a, b, atol=1e-12) for a, b in zip(now, new)):
                break
        self.books = books
        return self

    def encode(self, items: DataFrame, vector: str = "embedding") -> DataFrame:
        """items with `codes`, an array of m numbers below 256."""
        books, width = self.books, self.width

        @F.pandas_udf("array<int>")
        def codes(v: pd.Series) -> pd.Series:
            x = np.stack(v).astype(float) if len(v) else np.zeros((0, width * len(books)))
            out = np.column_stack([_distances(x[:, i * width : (i + 1) * width], b, "euclidean").argmin(axis=1) for i, b in enumerate(books)])
            return pd.Series(list(out.astype("int32")))

        return items.withColumn("codes", codes(F.col(vector)))

    def decode(self, items: DataFrame) -> DataFrame:
        """items with `approximate`, the vector that the codes stand for."""
        books = self.books

        @F.pandas_udf("array<double>")
        def vectors(codes: pd.Series) -> pd.Series:
            return pd.Series([np.concatenate([b[c] for b, c in zip(books, row)]) for row in codes])

        return items.withColumn("approximate", vectors(F.col("codes")))

    def search(self, encoded: DataFrame, query: Sequence[float], k: int, id: str = "vec_id") -> DataFrame:
        """k-NN by the table of squared distances between the query's parts and the centroids."""
        q = np.asarray(query, dtype=float).reshape(self.m, self.width)
        tables = [((b - part) ** 2).sum(axis=1) for part, b in zip(q, self.books)]

        @F.pandas_udf("double")
        def distance(codes: pd.Series) -> pd.Series:
            c = np.stack(codes)
            return pd.Series(np.sqrt(sum(t[c[:, i]] for i, t in enumerate(tables))))

        return encoded.withColumn("distance", F.round(distance(F.col("codes")), 6)).orderBy("distance", id).limit(k)


def diversify(hits: DataFrame, k: int, weight: float = 0.5, group: str = "query_id", id: str = "vec_id", vector: str = "embedding", relevance: str = "score") -> DataFrame:
    """Maximal marginal relevance: of each group's hits, k taken one by one by weight * relevance + (1 - weight) * (1 - mean cosine similarity to those taken). Columns group, id, position. A group must fit one task: bound it by the k of the search before."""

    def greedy(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([relevance, id], ascending=[False, True]).reset_index(drop=True)
        x = np.stack(frame[vector]).astype(float)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
        rel, taken, left = frame[relevance].to_numpy(float), [], list(range(len(frame)))
        while left and len(taken) < k:
            near = (x[left] @ x[taken].T).mean(axis=1) if taken else np.ones(len(left))
            score = np.round(weight * rel[left] + (1 - weight) * (1 - near), 9)
            taken.append(left.pop(int(score.argmax())))
        return pd.DataFrame({group: frame[group].iloc[taken].to_numpy(), id: frame[id].iloc[taken].to_numpy(), "position": np.arange(1, len(taken) + 1)})

    schema = f"{group} {hits.schema[group].dataType.simpleString()}, {id} {hits.schema[id].dataType.simpleString()}, position long"
    return hits.select(group, id, vector, relevance).groupBy(group).applyInPandas(greedy, schema)
