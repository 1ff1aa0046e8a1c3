"""Filters as data, turned into Columns: typed fields, JSON and string-map metadata, time, access rules."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)),
    "not_in": lambda c, v: ~c.isin(list(v)),
    "between": lambda c, v: c.between(*v),
    "contains": lambda c, v: c.contains(v),
    "starts_with": lambda c, v: c.startswith(v),
    "ends_with": lambda c, v: c.endswith(v),
    "matches": lambda c, v: c.rlike(v),
}


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: Any

    def column(self) -> Column:
        """A plain comparison, which scans can push down. A missing value passes no filter, not even ne: null counts as false in a where clause."""
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op!r}; one of {sorted(OPERATORS)}")
        return OPERATORS[self.op](F.col(self.field), self.value)


def all_of(filters: list[Filter]) -> Column:
    return reduce(lambda a, b: a & b, [f.column() for f in filters], F.lit(True))


def any_of(filters: list[Filter]) -> Column:
    return reduce(lambda a, b: a | b, [f.column() for f in filters], F.lit(False))


def json_equals(metadata: Column, wanted: dict[str, Any]) -> Column:
    """Whether JSON text has every key of wanted with a value of that type and size; a null wanted matches a JSON null only."""
    value = F.try_parse_json(metadata)
    tests = [F.lit(True)]
    for key, want in wanted.items():
        path = f"$['{key}']"
        kind = "boolean" if isinstance(want, bool) else "bigint" if isinstance(want, int) else "double" if isinstance(want, float) else "string"
        tests.append(F.is_variant_null(F.try_variant_get(value, path, "variant")) if want is None else F.coalesce(F.try_variant_get(value, path, kind) == F.lit(want), F.lit(False)))
    return reduce(lambda a, b: a & b, tests)


def map_test(fields: Column, key: str, op: str, value: Any) -> Column:
    """A test of a string map: eq and in compare text; gt, gte, lt and lte numbers, false where the text is none."""
    text = F.try_element_at(fields, F.lit(key))
    if op in ("gt", "gte", "lt", "lte"):
        return F.coalesce(OPERATORS[op](text.try_cast("double"), float(value)), F.lit(False))
    return F.coalesce(OPERATORS[op](text, value), F.lit(False))


def time_range(field: str, start: Any = None, end: Any = None) -> Column:
    """Both ends count; a missing end is open."""
    c = F.col(field)
    return reduce(lambda a, b: a & b, [*([c >= F.lit(start)] if start is not None else []), *([c <= F.lit(end)] if end is not None else [])], F.lit(True))


def space_time_box(low: tuple[float, ...], high: tuple[float, ...], fields: tuple[str, ...] = ("x", "y", "z", "t")) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f).between(a, b) for f, a, b in zip(fields, low, high)])


def space_time_ball(center: tuple[float, float, float, float], space: float, time: float) -> Column:
    d = F.sqrt(sum((F.pow(F.col(f) - c, 2) for f, c in zip("xyz", center)), F.lit(0.0)))
    return (d <= space) & (F.abs(F.col("t") - center[3]) <= time)


def space_time_distance(center: tuple[float, float, float, float], space: float = 1.0, time: float = 1.0) -> Column:
    """What nearest neighbours in space and time are ranked by."""
    d = F.sqrt(sum((F.pow(F.col(f) - c, 2) for f, c in zip("xyz", center)), F.lit(0.0)))
    return space * d + time * F.abs(F.col("t") - center[3])


def not_blocked(rows: DataFrame, blocked: DataFrame, key: str) -> DataFrame:
    return rows.join(blocked.select(key).distinct(), key, "left_anti").select(*rows.columns)
