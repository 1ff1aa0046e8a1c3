"""Collections: keyed tables with the last write winning, their changes and their checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and Spark is local."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if not named and held.isDefined():
        named = held.get()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="vexel-")
    if not held.isDefined():
        sc.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder's name in the shared folder; the folder is deleted when the driver ends."""
    name = f"{shared(spark)}/{kind}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return name


def latest(rows: DataFrame, key: str | list[str], seq: str) -> DataFrame:
    """Of each key the row with the greatest seq."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("__r")).select(*keys, *[f"__r.{c}" for c in rest]).select(*rows.columns)


def insert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """base with the rows of new; those of base with such a key go."""
    return base.join(new.select(key).distinct(), key, "left_anti").select(*base.columns).unionByName(new.select(*base.columns))


def upsert_report(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key and outcome, inserted or updated, of each new key."""
    old = base.select(key, F.lit(True).alias("__old")).distinct()
    return new.select(key).distinct().join(old, key, "left").select(key, F.when(F.col("__old"), "updated").otherwise("inserted").alias("outcome"))


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key).distinct(), key, "left_anti").select(*base.columns)


def deleted(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows that delete takes away."""
    return base.join(keys.select(key).distinct(), key, "left_semi").select(*base.columns)


def update(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with the columns of changes that are not null, where the key is known; other keys are left aside. changes has a key once."""
    names = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"__new_{c}") for c in names])
    return base.join(new, key, "left").select(*[F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in base.columns])


def wrong_dimension(rows: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Rows that an insert must refuse."""
    return rows.where(F.coalesce(F.size(vector), F.lit(-1)) != dim)


def describe(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: n, dimension, bytes (4 for each element)."""
    return rows.agg(F.count("*").alias("n"), F.max(F.size(vector)).cast("long").alias("dimension"), (F.coalesce(F.sum(F.size(vector)), F.lit(0)) * 4).cast("long").alias("bytes"))


def apply_changes(base: DataFrame, log: DataFrame, key: str, seq: str, op: str = "op") -> DataFrame:
    """base after a log of inserts, updates and deletes: of each key the last entry counts."""
    last = latest(log, key, seq)
    kept = delete(base, last, key)
    return kept.unionByName(last.where(F.col(op) != "delete").select(*base.columns))


def checksum(df: DataFrame) -> DataFrame:
    """One row: n and an order-free sum of row hashes, by which copies are verified."""
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")).alias("checksum"))


def last_n(rows: DataFrame, n: int, order: str) -> DataFrame:
    """A ring buffer's content: the n rows with the greatest `order`."""
    return rows.orderBy(F.desc(order)).limit(n)


def first_by(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")
