"""A catalogue of vector collections: versioned Parquet folders under one root, each write a new version.

A version is written aside and then renamed, so a reader sees it whole or not at all, and a
second writer of the same version fails.  Older versions are checkpoints to go back to.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.functions import vector as V
from vexel.operators import search, storage
from vexel.sources.files import Files

COLUMNS = "id string, vector array<float>, metadata string"


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    # Definition

    def create(self, name: str, dim: int, metric: str = "cosine", index: str = "exact") -> None:
        """An empty collection; raises if there is one of that name, or no such metric or index."""
        V.metric(metric)
        if index not in INDEXES:
            raise ValueError(f"unknown index {index!r}; one of {sorted(INDEXES)}")
        if self.files.exists(f"{name}/meta.json"):
            raise ValueError(f"collection {name!r} exists")
        self.files.write(f"{name}/meta.json", json.dumps({"name": name, "dim": dim, "metric": metric, "index": index, "created": time.time()}).encode(), overwrite=False)
        self._write(name, self.spark.createDataFrame([], COLUMNS))

    def drop(self, name: str) -> bool:
        return self.files.exists(name) and self.files.delete(name)

    def names(self) -> list[str]:
        return [n for n in self.files.names() if self.files.exists(f"{n}/meta.json")]

    def describe(self, name: str) -> dict:
        if not self.files.exists(f"{name}/meta.json"):
            raise ValueError(f"no collection {name!r}")
        return json.loads(self.files.read(f"{name}/meta.json"))

    # Versions

    def versions(self, name: str) -> list[int]:
        return [int(v[2:]) for v in self.files.names(name) if v.startswith("v=")]

    def _write(self, name: str, rows: DataFrame) -> int:
        version = (self.versions(name) or [-1])[-1] + 1
        aside = f"{name}/.new-{uuid.uuid4().hex}"
        rows.write.parquet(self.files.at(aside))
        if not self.files.move(aside, f"{name}/v={version:012d}"):
            self.files.delete(aside)
            raise RuntimeError(f"version {version} of {name!r} was written by another")
        return version

    def read(self, name: str, version: int | None = None) -> DataFrame:
        self.describe(name)
        at = self.versions(name)[-1] if version is None else version
        return self.spark.read.schema(COLUMNS).parquet(self.files.at(f"{name}/v={at:012d}"))

    def restore(self, name: str, version: int) -> int:
        """An older version becomes the newest."""
        return self._write(name, self.read(name, version))

    def keep(self, name: str, last: int) -> list[int]:
        """Deletes all but the last versions; returns those deleted."""
        gone = self.versions(name)[:-last] if last > 0 else []
        for v in gone:
            self.files.delete(f"{name}/v={v:012d}")
        return gone

    # Rows

    def _checked(self, name: str, rows: DataFrame) -> DataFrame:
        dim = self.describe(name)["dim"]
        rows = rows.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"), F.col("metadata").cast("string").alias("metadata") if "metadata" in rows.columns else F.lit("{}").alias("metadata"))
        if not storage.wrong_dimension(rows.where("vector is not null"), dim, "vector").isEmpty():
            raise ValueError(f"a vector of {name!r} must have {dim} elements")
        return rows

    def insert(self, name: str, rows: DataFrame) -> int:
        """Rows (id, vector, metadata), those of known ids in place of the old ones; all or none, by their length. Of an id that is given twice one row is taken. Returns the version."""
        new = self._checked(name, rows).dropDuplicates(["id"])
        if not new.where("id is null or vector is null").isEmpty():
            raise ValueError("ids and vectors may not be null")
        return self._write(name, storage.insert(self.read(name), new, "id"))

    def upsert(self, name: str, rows: DataFrame) -> dict[str, int]:
        """As insert; how many were inserted and updated."""
        report = {r.outcome: r["count"] for r in storage.upsert_report(self.read(name), self._checked(name, rows), "id").groupBy("outcome").count().collect()}
        self.insert(name, rows)
        return {k: report.get(k, 0) for k in ("inserted", "updated")}

    def update(self, name: str, rows: DataFrame) -> int:
        """New vectors or metadata (null: as it was) of known ids; others are left aside. Returns how many were changed."""
        new = self._checked(name, rows).dropDuplicates(["id"])
        old = self.read(name)
        known = new.join(old.select("id"), "id", "left_semi").count()
        self._write(name, storage.update(old, new, "id"))
        return known

    def delete(self, name: str, ids: DataFrame) -> int:
        old = self.read(name)
        ids = ids.select(F.col("id").cast("string").alias("id"))
        gone = storage.deleted(old, ids, "id").count()
        self._write(name, storage.delete(old, ids, "id"))
        return gone

    def apply(self, name: str, log: DataFrame, seq: str, op: str = "op") -> int:
        """A log (id, vector, metadata, op, seq) of inserts, updates and deletes. Returns the version."""
        last = storage.latest(log.select("id", "vector", "metadata", op, seq), "id", seq)
        kept = self._checked(name, last.where(F.col(op) != "delete"))
        return self._write(name, storage.delete(self.read(name), last, "id").unionByName(kept))

    def get(self, name: str, ids: Sequence[str]) -> DataFrame:
        return self.read(name).where(F.col("id").isin(list(ids)))

    def count(self, name: str) -> int:
        return self.read(name).count()

    def statistics(self, name: str) -> dict:
        about, r = self.describe(name), storage.describe(self.read(name), "vector").first()
        return {"name": name, "count": r.n, "dimension": about["dim"], "metric": about["metric"], "index": about["index"], "bytes": r.bytes}

    def search(self, name: str, query: Sequence[float], k: int = 10, where: Column | None = None) -> DataFrame:
        """id, distance, score of the k nearest, by the collection's metric and index."""
        about = self.describe(name)
        hits = INDEXES[about["index"]](self.read(name), list(query), k, about["metric"], where)
        return hits.select("id", "distance", (F.round(V.score_linear(F.col("distance")), 6) + 0.0).alias("score"))

    # Copies

    def backup(self, name: str, target: str) -> dict:
        """Copies the newest version, with its definition and a checksum of its rows."""
        files = Files(self.spark, target)
        rows = self.read(name)
        rows.write.mode("overwrite").parquet(files.at("rows"))
        r = storage.checksum(rows).first()
        about = self.describe(name) | {"count": r.n, "checksum": str(r.checksum), "at": time.time()}
        files.write("backup.json", json.dumps(about).encode())
        return about

    def verify(self, target: str) -> bool:
        """Whether a backup's rows are those it was made of."""
        files = Files(self.spark, target)
        about, r = json.loads(files.read("backup.json")), storage.checksum(self.spark.read.schema(COLUMNS).parquet(files.at("rows"))).first()
        return (r.n, str(r.checksum)) == (about["count"], about["checksum"])

    def recover(self, target: str, name: str | None = None) -> str:
        """A backup as a collection, under its old name or a new one; raises if it does not verify."""
        if not self.verify(target):
            raise ValueError(f"the backup in {target} is damaged")
        files = Files(self.spark, target)
        about = json.loads(files.read("backup.json"))
        name = name or about["name"]
        if name not in self.names():
            self.create(name, about["dim"], about["metric"], about["index"])
        self._write(name, self.spark.read.schema(COLUMNS).parquet(files.at("rows")))
        return name


def expire(spark: SparkSession, root: str, days: float, now: float | None = None) -> list[str]:
    """Deletes the backups under root that are older than so many days; returns their names."""
    files, now = Files(spark, root), time.time() if now is None else now
    old = [n for n in files.names() if files.exists(f"{n}/backup.json") and now - json.loads(files.read(f"{n}/backup.json"))["at"] > days * 86400]
    for n in old:
        files.delete(n)
    return old


def _exact(rows: DataFrame, query: list[float], k: int, metric: str, where: Column | None) -> DataFrame:
    return search.knn(rows, query, k, metric, "id", "vector", where)


def _inverted(rows: DataFrame, query: list[float], k: int, metric: str, where: Column | None) -> DataFrame:
    """By the nearest three quarters of the clusters, whose number is the square root of the rows'."""
    n = max(1, int(rows.count() ** 0.5))
    centroids = search.train_centroids(rows, n, 10, "id", "vector")
    kept = rows if where is None else rows.where(where)
    return search.probe(search.assign(kept, centroids, "vector"), centroids, query, k, -(-3 * n // 4), metric, "id", "vector")


#: Searches by the name of an index.
INDEXES = {"exact": _exact, "graph": _exact, "inverted": _inverted}
