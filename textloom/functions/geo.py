"""Places on the sphere, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6371008.7714


def distance(lat: Column, lon: Column, to_lat: float, to_lon: float) -> Column:
    """Metres to a point, by the haversine."""
    a, b = F.radians(lat), F.radians(F.lit(to_lat))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(F.lit(to_lon)) - F.radians(lon)) / 2), 2)
    return F.lit(2 * RADIUS) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inside a box; one whose west lies east of its east crosses the date line."""
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & across


def in_polygon(lat: Column, lon: Column, points: list[tuple[float, float]]) -> Column:
    """Inside a polygon of (lat, lon) corners: a ray to the east crosses an odd number of edges."""
    crossings = []
    for (a, b), (c, d) in zip(points, points[1:] + points[:1]):
        if a != c:
            east = F.lit(b) + (lat - a) / (c - a) * (d - b)
            crossings.append((((F.lit(a) > lat) != (F.lit(c) > lat)) & (lon < east)).cast("int"))
    return F.coalesce(reduce(lambda x, y: x + y, crossings) % 2 == 1, F.lit(False)) if crossings else F.lit(False)


def query(lat: Column, lon: Column, text: str) -> Column:
    """``lat,lon,metres``, a box ``south,west,north,east`` or a polygon of more pairs."""
    parts = [float(x) for x in text.split(",")]
    if len(parts) == 3:
        return distance(lat, lon, parts[0], parts[1]) <= parts[2]
    if len(parts) == 4:
        return in_box(lat, lon, *parts)
    if len(parts) < 6 or len(parts) % 2:
        raise ValueError(f"neither a distance, nor a box, nor a polygon: {text}")
    return in_polygon(lat, lon, list(zip(parts[::2], parts[1::2])))
