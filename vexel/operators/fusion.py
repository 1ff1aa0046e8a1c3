"""Fusion of ranked lists and reranking. A list has the columns id, score, rank, source, weight."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexel.functions import text as T

EPSILON = 1e-9


def ranked(hits: DataFrame, source: str, weight: float = 1.0, base: int = 0) -> DataFrame:
    """hits (id, score) with rank by falling score, from `base`; source and weight."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1 + base
    return hits.select("id", "score", rank.cast("long").alias("rank"), F.lit(source).alias("source"), F.lit(float(weight)).alias("weight"))


def _fused(hits: DataFrame, score: Column) -> DataFrame:
    return hits.groupBy("id").agg((F.round(score, 6) + 0.0).alias("score"), F.concat_ws(",", F.sort_array(F.collect_set("source"))).alias("sources"))


def reciprocal_rank(hits: DataFrame, k: float = 60.0) -> DataFrame:
    return _fused(hits, F.sum(1.0 / (k + F.col("rank"))))


def weighted_sum(hits: DataFrame) -> DataFrame:
    return _fused(hits, F.sum(F.col("score") * F.col("weight")))


def _scaled(hits: DataFrame, by: list[str], flat: Column) -> DataFrame:
    """hits with `scaled`, the score between the least (0) and the greatest (1) of its group; `flat` where they are equal. The bounds are aggregated and joined, so that one large group is no single task."""
    bounds = hits.groupBy(*by).agg(F.min("score").alias("__low"), F.max("score").alias("__high"))
    joined = hits.join(bounds, by) if by else hits.crossJoin(F.broadcast(bounds))
    spread = F.col("__high") - F.col("__low")
    return joined.withColumn("scaled", F.when(spread < EPSILON, flat).otherwise((F.col("score") - F.col("__low")) / spread)).drop("__low", "__high")


def normalized_sum(hits: DataFrame) -> DataFrame:
    """As weighted_sum, of scores scaled over all sources together."""
    return _fused(_scaled(hits, [], F.lit(1.0)), F.sum(F.col("scaled") * F.col("weight")))


def comb_mnz(hits: DataFrame) -> DataFrame:
    """Sum times number of hits."""
    return _fused(hits, F.sum(F.col("score") * F.col("weight")) * F.count("*"))


METHODS: dict[str, Callable[[DataFrame], DataFrame]] = {"rrf": reciprocal_rank, "weighted": weighted_sum, "normalized": normalized_sum, "comb_mnz": comb_mnz}


def top(fused: DataFrame, k: int) -> DataFrame:
    return fused.orderBy(F.desc("score"), "id").limit(k)


def merge(left: DataFrame, right: DataFrame, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """Full outer merge of two lists (id, score): id, left_score, right_score, score; a missing score is 0."""
    a, b = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("left_score", "right_score"))
    both = left.select("id", F.col("score").alias("left_score")).join(right.select("id", F.col("score").alias("right_score")), "id", "full_outer")
    return both.select("id", a.alias("left_score"), b.alias("right_score"), (F.round(weights[0] * a + weights[1] * b, 6) + 0.0).alias("score"))


def coarse_rank(hits: DataFrame, k: int = 500) -> DataFrame:
    """id, source, raw_score, coarse: scores scaled per source (raw where a source is flat); of an id the hit with the greatest raw score stays."""
    scaled = _scaled(hits, ["source"], F.col("score"))
    best = scaled.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "source"))).where("__n = 1")
    return best.select("id", "source", F.col("score").alias("raw_score"), (F.round("scaled", 6) + 0.0).alias("coarse")).orderBy(F.desc("coarse"), "id").limit(k)


def fine_rank(candidates: DataFrame, documents: DataFrame, query: str, k: int = 50, model: Callable[[Column, Column], Column] | None = None, weights: tuple[float, float] = (0.3, 0.7)) -> DataFrame:
    """id, coarse, rerank, score of the candidates (id, coarse) that have a document (id, text).

    rerank is the model's score of (query, text), or 0.1 * match ratio + 0.4 * coarse without one;
    score mixes coarse and rerank, and is coarse alone where rerank is not positive.
    """
    joined = documents.select("id", "text").join(F.broadcast(candidates.select("id", "coarse")), "id")
    q = F.lit(query)
    rerank = model(q, F.col("text")) if model else 0.1 * T.match_ratio(q, F.col("text"), fold=False) + 0.4 * F.col("coarse")
    scored = joined.select("id", "coarse", (F.round(rerank, 6) + 0.0).alias("rerank"))
    mixed = F.when(F.col("rerank") <= 0, F.col("coarse")).otherwise(weights[0] * F.col("coarse") + weights[1] * F.col("rerank"))
    return scored.withColumn("score", F.round(mixed, 6) + 0.0).orderBy(F.desc("score"), "id").limit(k)


def two_stage(hits: DataFrame, documents: DataFrame, query: str, coarse_k: int = 500, fine_k: int = 50) -> DataFrame:
    return fine_rank(coarse_rank(hits, coarse_k), documents, query, fine_k)


def build_context(hits: DataFrame, most: int = 4000, group: str = "query_id", order: str = "rank", text: str = "text") -> DataFrame:
    """group, context: the texts of a group in order, joined by blank lines, cut to `most` characters of text; the one that crosses the limit is cut. A group is bounded by the search that gave it."""
    w = Window.partitionBy(group).orderBy(order)
    before = F.coalesce(F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = hits.withColumn("__before", before).where(F.col("__before") < most).select(group, order, F.substring(F.col(text), F.lit(1), (most - F.col("__before")).cast("int")).alias("__part"))
    return parts.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "__part"))), lambda x: x["__part"]), "\n\n").alias("context"))


def recall(short: DataFrame, long: DataFrame, k: int = 10) -> DataFrame:
    """Union of short-term and long-term hits (id, importance, score): the most important of each id, then the k best."""
    one = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("importance"), F.desc("score")))
    return short.unionByName(long).withColumn("__n", one).where("__n = 1").drop("__n").orderBy(F.desc("importance"), "id").limit(k)
