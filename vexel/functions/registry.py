"""Functions by name: scalar, vector, filter and aggregate functions that are built from Columns, and those of SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.functions import vector as V

KINDS = ("scalar", "vector", "filter", "aggregate")


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def normalized_sum(*x: Column) -> Column:
    """The sum of the arguments over their norm; 0 if that is 0."""
    size = F.sqrt(reduce(lambda a, b: a + b, [c * c for c in x]))
    return F.when(size == 0, 0.0).otherwise(reduce(lambda a, b: a + b, x) / size)


class Registry:
    """Names and the functions of Columns that they stand for. An unknown name sums its arguments, if it is asked to."""

    def __init__(self) -> None:
        self._known: dict[str, tuple[str, Callable[..., Column]]] = {}
        for name, kind, f in (
            ("normalize", "scalar", normalized_sum),
            ("sigmoid", "scalar", sigmoid),
            ("relu", "scalar", relu),
            ("elementwise_add", "vector", lambda *v: reduce(V.add, v)),
            ("elementwise_mul", "vector", lambda *v: reduce(V.multiply, v)),
        ):
            self.register(name, f, kind)

    def register(self, name: str, f: Callable[..., Column], kind: str = "scalar") -> None:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}; one of {KINDS}")
        self._known[name] = kind, f

    def get(self, name: str) -> Callable[..., Column]:
        if name not in self._known:
            raise ValueError(f"no function {name!r}; there are {sorted(self._known)}")
        return self._known[name][1]

    def names(self, kind: str | None = None) -> list[str]:
        return sorted(n for n, (k, _) in self._known.items() if kind in (None, k))

    def call(self, name: str, *columns: Column, or_sum: bool = False) -> Column:
        if or_sum and name not in self._known:
            return reduce(lambda a, b: a + b, columns)
        return self.get(name)(*columns)

    def where(self, df: DataFrame, name: str, *columns: Column) -> DataFrame:
        """df's rows that a filter function lets pass."""
        if self._known[name][0] != "filter":
            raise ValueError(f"{name!r} is no filter")
        return df.where(self.get(name)(*columns))


def register_sql(spark: SparkSession, name: str, arguments: str, body: str) -> None:
    """A SQL function for this session, inlined into plans that call it: arguments 'x double', body 'x * 2'."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURN {body}")
