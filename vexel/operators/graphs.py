"""Property graphs as two DataFrames: nodes (id, label) and edges (edge_id, src, dst, label, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.operators.storage import checkpoint


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node; such edges may not be added."""
    ends = edges.select("*", F.explode(F.array("src", "dst")).alias("__end"))
    return ends.join(nodes.select(F.col("id").alias("__end")), "__end", "left_anti").drop("__end").distinct()


def neighbours(nodes: DataFrame, edges: DataFrame, incoming: bool = False) -> DataFrame:
    """node, neighbour, neighbour_label, edge_id, weight; parallel edges count each."""
    near, far = ("dst", "src") if incoming else ("src", "dst")
    return edges.join(nodes.select(F.col("id").alias(far), F.col("label").alias("neighbour_label")), far).select(F.col(near).alias("node"), F.col(far).alias("neighbour"), "neighbour_label", "edge_id", "weight")


def walks(edges: DataFrame, starts: DataFrame, depth: int, exact: bool = False) -> DataFrame:
    """Simple paths from the starts (column id) of 1 to `depth` edges, or of exactly so many: start, node, hops, path (ids with '>' between)."""
    out, front = None, starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path"))
    steps = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    for hops in range(1, depth + 1):
        front = front.join(steps, "node").where(~F.array_contains("path", F.col("next"))).select("start", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        rows = front.select("start", "node", F.lit(hops).cast("long").alias("hops"), F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"))
        if not exact or hops == depth:
            out = rows if out is None else out.unionByName(rows)
    return out


def reachable(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, node, hops: nodes within `depth` edges and the least number of edges to them."""
    known = front = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).cast("long").alias("hops"))
    steps = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    for hops in range(1, depth + 1):
        step = front.join(steps, "node").select("start", F.col("next").alias("node")).distinct()
        front = step.join(known, ["start", "node"], "left_anti").withColumn("hops", F.lit(hops).cast("long"))
        known = known.unionByName(front)
        if hops % 4 == 0:
            known, front = checkpoint(known), checkpoint(front)
    return known


def shortest_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node, weight, path: least total weight (none negative) from each start to each node that it reaches; of equal paths the first as text.

    Rounds of relaxation over the nodes whose weight fell in the round before: a round is one join and one
    aggregation, written to the shared folder.  It ends when no weight falls.
    """
    steps = checkpoint(edges.groupBy(F.col("src").alias("node"), F.col("dst").alias("next")).agg(F.min("weight").cast("double").alias("w")))
    known = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.struct(F.lit(0.0).alias("weight"), F.col("id").cast("string").alias("path")).alias("best"), F.lit(True).alias("fell"))
    while True:
        moved = known.where("fell").join(steps, "node").select("start", F.col("next").alias("node"), F.struct((F.col("best.weight") + F.col("w")).alias("weight"), F.concat("best.path", F.lit(">"), F.col("next").cast("string")).alias("path")).alias("best"), F.lit(False).alias("old"))
        every = known.select("start", "node", "best", F.lit(True).alias("old")).union(moved)
        known = every.groupBy("start", "node").agg(F.min("best").alias("best"), F.min(F.when(F.col("old"), F.col("best"))).alias("was")).select("start", "node", "best", (F.col("was").isNull() | (F.col("best") < F.col("was"))).alias("fell"))
        known = checkpoint(known)
        if known.where("fell").isEmpty():
            return known.select("start", "node", "best.weight", "best.path")


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that are left without the nodes `ids` (column id)."""
    gone = ids.select("id").distinct()
    left = edges
    for end in ("src", "dst"):
        left = left.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return nodes.join(gone, "id", "left_anti"), left.select(*edges.columns)
