"""One query over vectors, text, attributes, places and times: filters first, then the retrievers, then fusion."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.functions import geo as G
from vexel.operators import bm25, fusion, search
from vexel.operators.filters import Filter, all_of, time_range


def place_filter(shape: str, relation: str, value: Sequence, lat: str = "lat", lon: str = "lon") -> Column:
    """Whether a row's point stands in that relation to a shape.

    Shapes: point (lat, lon), circle (lat, lon, km), box (least and greatest lat, lon), polygon (its corners).  Relations: within and
    intersects, which for points are the same, contains (the point is the shape), disjoint, and near (no farther than
    a circle's km; from a point, 1 km).
    """
    y, x = F.col(lat), F.col(lon)
    km = lambda a, b: G.haversine(F.lit(float(a)), F.lit(float(b)), y, x)
    inside = {
        "point": lambda: km(*value[:2]) <= (1.0 if relation == "near" else 1e-6),
        "circle": lambda: km(value[0], value[1]) <= float(value[2]),
        "box": lambda: G.in_box(y, x, tuple(value)),
        "polygon": lambda: G.in_polygon(y, x, G.points(*value)),
    }
    if shape not in inside or relation not in ("within", "intersects", "contains", "disjoint", "near"):
        raise ValueError(f"unknown shape or relation: {shape!r}, {relation!r}")
    if relation == "contains" and shape != "point":
        return F.lit(False)
    return ~inside[shape]() if relation == "disjoint" else inside[shape]()


@dataclass(frozen=True)
class HybridQuery:
    """What to search for; parts that are left out have no say."""

    vector: Sequence[float] | None = None
    text: str | None = None
    filters: tuple[Filter, ...] = ()
    places: tuple[tuple[str, str, Sequence], ...] = ()
    times: tuple[tuple[str, Any, Any], ...] = ()
    weights: dict[str, float] = field(default_factory=lambda: {"vector": 0.5, "text": 0.5})
    method: str = "rrf"
    metric: str = "cosine"
    k: int = 10
    coarse_k: int = 100

    def where(self, *filters: Filter) -> HybridQuery:
        return replace(self, filters=(*self.filters, *filters))

    def in_place(self, shape: str, relation: str, value: Sequence) -> HybridQuery:
        return replace(self, places=(*self.places, (shape, relation, value)))

    def in_time(self, column: str, start: Any = None, end: Any = None) -> HybridQuery:
        return replace(self, times=(*self.times, (column, start, end)))

    def predicate(self) -> Column:
        parts = [all_of(list(self.filters)), *[place_filter(*p) for p in self.places], *[time_range(*t) for t in self.times]]
        return reduce(lambda a, b: a & b, parts)

    def run(self, items: DataFrame) -> DataFrame:
        """id, score, sources of the k best of items (id, vector, text and whatever the filters name). The text's statistics are those of all items."""
        if self.method not in fusion.METHODS:
            raise ValueError(f"unknown method {self.method!r}; one of {sorted(fusion.METHODS)}")
        lists = []
        keep = self.predicate()
        if self.vector is not None:
            hits = search.knn(items, self.vector, self.coarse_k, self.metric, "id", "vector", keep).select("id", (F.round(1 / (1 + F.col("distance")), 6)).alias("score"))
            lists.append(fusion.ranked(hits, "vector", self.weights.get("vector", 1.0)))
        if self.text is not None:
            lists.append(fusion.ranked(bm25.search(items, self.text, self.coarse_k, keep, False, id="id").select("id", "score"), "text", self.weights.get("text", 1.0)))
        if not lists:
            return items.where(keep).select("id", F.lit(0.0).alias("score"), F.lit("").alias("sources")).orderBy("id").limit(self.k)
        return fusion.top(fusion.METHODS[self.method](reduce(DataFrame.unionByName, lists)), self.k)
