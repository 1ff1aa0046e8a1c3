"""The register of queries, and the views that several of them share, each as a DataFrame and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL twin."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The embedding that single searches ask for."""
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding)


def micros(ts: str = "ts"):
    """Microseconds since 1970 of a timestamp without a zone, read as UTC whatever the session's zone."""
    return F.expr(f"unix_micros(cast(convert_timezone('UTC', current_timezone(), {ts}) as timestamp))")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.col("event_id").alias("seq"), micros().alias("ts"), "value")


SERIES = "series AS (SELECT event_type AS series, event_id AS seq, epoch_us(ts) AS ts, value FROM events)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 37) % 180 - 90).cast("double").alias("lat"), ((F.col("c_custkey") * 91) % 360 - 180).cast("double").alias("lon"))


POINTS = "points AS (SELECT c_custkey AS id, CAST((c_custkey * 37) % 180 - 90 AS DOUBLE) AS lat, CAST((c_custkey * 91) % 360 - 180 AS DOUBLE) AS lon FROM customer)"


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    nodes = s.select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.lit("supplier").alias("label")).union(n.select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.lit("nation").alias("label")))
    located = s.select(F.concat(F.lit("L"), "s_suppkey").alias("edge_id"), F.concat(F.lit("S"), "s_suppkey").alias("src"), F.concat(F.lit("N"), "s_nationkey").alias("dst"), F.lit("located").alias("label"), (1 + F.col("s_suppkey") % 7).cast("double").alias("weight"))
    ring = n.select(F.concat(F.lit("R"), "n_nationkey").alias("edge_id"), F.concat(F.lit("N"), "n_nationkey").alias("src"), F.concat(F.lit("N"), ((F.col("n_nationkey") + 1) % 25).cast("string")).alias("dst"), F.lit("next").alias("label"), (1 + F.col("n_nationkey") % 7).cast("double").alias("weight"))
    return nodes, located.union(ring)


GRAPH = """nodes AS (SELECT 'S' || s_suppkey AS id, 'supplier' AS label FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'nation' FROM nation),
edges AS (SELECT 'L' || s_suppkey AS edge_id, 'S' || s_suppkey AS src, 'N' || s_nationkey AS dst, 'located' AS label, CAST(1 + s_suppkey % 7 AS DOUBLE) AS weight FROM supplier
UNION ALL SELECT 'R' || n_nationkey, 'N' || n_nationkey, 'N' || ((n_nationkey + 1) % 25), 'next', CAST(1 + n_nationkey % 7 AS DOUBLE) FROM nation)"""


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_id") % 10 == 0, "delete").when(F.col("event_id") % 10 <= 3, "update").otherwise("insert")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), op.alias("op"), F.col("event_id").alias("lsn"), micros().alias("ts"), "value")


LOG = "log AS (SELECT user_id AS key, CASE WHEN event_id % 10 = 0 THEN 'delete' WHEN event_id % 10 <= 3 THEN 'update' ELSE 'insert' END AS op, event_id AS lsn, epoch_us(ts) AS ts, value FROM events)"

TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')"
