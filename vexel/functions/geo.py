"""Geographic functions as Columns. Points are latitude and longitude in degrees; polygons and lines are arrays of structs (lat, lon)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, DEGREE_KM = 6371.0, 111.0


def points(*pairs: tuple[float, float]) -> Column:
    """A literal array of points."""
    return F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in pairs])


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def radius_box(lat: float, lon: float, km: float) -> tuple[float, float, float, float]:
    """Least and greatest latitude and longitude that a circle reaches, by 111 km a degree; near a pole all longitudes."""
    import math

    d = km / DEGREE_KM
    shrink = math.cos(math.radians(lat))
    e = d / shrink if shrink > 1e-9 else 360.0
    return lat - d, lat + d, lon - e, lon + e


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def boxes_meet(a: Column, b: Column) -> Column:
    """Whether two structs (min_lat, max_lat, min_lon, max_lon) share a point."""
    return (a["min_lat"] <= b["max_lat"]) & (b["min_lat"] <= a["max_lat"]) & (a["min_lon"] <= b["max_lon"]) & (b["min_lon"] <= a["max_lon"])


def _edges(ring: Column) -> Column:
    """Structs (a, b) of each vertex and its predecessor, the last one's being the first's."""
    shifted = F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(1))))
    return F.zip_with(ring, shifted, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def in_polygon(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd ray casting; false for fewer than three vertices."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        return spans & (lon < F.try_divide((b["lon"] - a["lon"]) * (lat - a["lat"]), b["lat"] - a["lat"]) + a["lon"])

    return F.when(F.size(ring) < 3, False).otherwise(F.size(F.filter(_edges(ring), crosses)) % 2 == 1)


def polygon_area(ring: Column) -> Column:
    """In square degrees, by the shoelace formula."""
    twice = F.aggregate(F.transform(_edges(ring), lambda e: e["b"]["lat"] * e["a"]["lon"] - e["a"]["lat"] * e["b"]["lon"]), F.lit(0.0), lambda total, x: total + x)
    return F.when(F.size(ring) < 3, 0.0).otherwise(F.abs(twice) / 2)


def polygon_box(ring: Column) -> Column:
    lat, lon = F.transform(ring, lambda p: p["lat"]), F.transform(ring, lambda p: p["lon"])
    return F.struct(F.array_min(lat).alias("min_lat"), F.array_max(lat).alias("max_lat"), F.array_min(lon).alias("min_lon"), F.array_max(lon).alias("max_lon"))


def line_length(line: Column) -> Column:
    """In km along the great circles between neighbours."""
    legs = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: haversine(a["lat"], a["lon"], b["lat"], b["lon"]))
    return F.aggregate(legs, F.lit(0.0), lambda total, x: total + x)


def segment_distance(lat: Column, lon: Column, a: Column, b: Column) -> Column:
    """km to the nearest point of a segment; that point is found in the plane of degrees."""
    dy, dx = b["lat"] - a["lat"], b["lon"] - a["lon"]
    t = F.coalesce(F.try_divide((lat - a["lat"]) * dy + (lon - a["lon"]) * dx, dy * dy + dx * dx), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return haversine(lat, lon, a["lat"] + t * dy, a["lon"] + t * dx)


def line_distance(lat: Column, lon: Column, line: Column) -> Column:
    """km to the nearest segment; null for a line of fewer than two points."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.array_min(F.zip_with(F.slice(line, 1, n), F.slice(line, 2, n), lambda a, b: segment_distance(lat, lon, a, b)))


def cell(lat: Column, lon: Column, degrees: float) -> Column:
    """The grid cell of a point, for equi-joins on place."""
    return F.struct(F.floor(lat / degrees).alias("y"), F.floor(lon / degrees).alias("x"))
