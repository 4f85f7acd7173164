"""Geographic predicates and distances on a sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in metres.
RADIUS = 6_371_008.7714


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points in degrees."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    """Bounds included; a box whose west is greater than its east crosses the date line."""
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & across


def within(lat: Column, lon: Column, lat0: float, lon0: float, metres: float) -> Column:
    """A bounding box first, which can prune row groups, then the distance."""
    reach = math.degrees(metres / RADIUS)
    south, north = lat0 - reach, lat0 + reach
    near = lat.between(south, north)
    if south > -90 and north < 90 and reach < 90:
        wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(reach)) / math.cos(math.radians(lat0)))))
        if -180 <= lon0 - wide and lon0 + wide <= 180:
            near = near & lon.between(lon0 - wide, lon0 + wide)
    return near & (haversine(lat, lon, F.lit(lat0), F.lit(lon0)) <= metres)


def in_polygon(lat: Column, lon: Column, ring: list[tuple[float, float]], holes: list[list[tuple[float, float]]] = ()) -> Column:
    """Even-odd rule over the edges of a closed ring of (lat, lon); holes are taken out."""
    lats, lons = [p[0] for p in ring], [p[1] for p in ring]

    def odd(points: list[tuple[float, float]]) -> Column:
        hits = F.lit(0)
        for (a1, o1), (a2, o2) in zip(points, points[1:]):
            if a1 == a2:
                continue
            crosses = (F.lit(a1) > lat) != (F.lit(a2) > lat)
            hits = hits + F.when(crosses & (lon < (o2 - o1) * (lat - a1) / (a2 - a1) + o1), 1).otherwise(0)
        return hits % 2 == 1

    inside = in_box(lat, lon, min(lats), max(lats), min(lons), max(lons)) & odd(ring)
    for hole in holes:
        inside = inside & ~odd(hole)
    return inside


def geojson_rings(geometry: dict) -> list[tuple[list, list]]:
    """``(ring, holes)`` of a GeoJSON Polygon or MultiPolygon; its points are (lon, lat)."""
    parts = [geometry["coordinates"]] if geometry["type"] == "Polygon" else geometry["coordinates"]
    turned = [[[(y, x) for x, y, *_ in ring] for ring in rings] for rings in parts]
    return [(rings[0], rings[1:]) for rings in turned]
