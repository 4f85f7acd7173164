"""Geography over points that are made from customer keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import geo, scalar
from vellum.operators import facets
from vellum.operators.ordering import distance_key, page
from vellum.queries import query, table

_P = "p AS (SELECT c_custkey AS id, (c_custkey * 7919 % 18001) / 100.0 - 90.0 AS lat, (c_custkey * 104729 % 36001) / 100.0 - 180.0 AS lon FROM customer)"


def _d(lat: float, lon: float) -> str:
    return f"2 * 6371008.7714 * asin(sqrt(least(pow(sin((radians({lat}) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians({lat})) * pow(sin(radians({lon} - lon) / 2), 2), 1.0)))"


def _points(spark, sf):
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(key.alias("id"), (key * 7919 % 18001 / 100.0 - 90.0).alias("lat"), (key * 104729 % 36001 / 100.0 - 180.0).alias("lon"))


@query(f"WITH {_P} SELECT id FROM p WHERE lat BETWEEN -20.0 AND 35.5 AND (lon >= 150 OR lon <= -120.25)")
def geo_box(spark, sf):
    return _points(spark, sf).where(geo.in_box(F.col("lat"), F.col("lon"), -20.0, 35.5, 150.0, -120.25)).select("id")


@query(f"WITH {_P} SELECT id FROM p WHERE {_d(48.85, 2.35)} <= 3000000")
def geo_distance(spark, sf):
    return _points(spark, sf).where(geo.within(F.col("lat"), F.col("lon"), 48.85, 2.35, 3_000_000)).select("id")


@query(f"WITH {_P} SELECT id FROM p WHERE lat > -10.003 AND lat < 40.003 AND lon > 0.5 * (lat + 10.003) - 30.001 AND lon < 60.007 - 0.25 * (lat + 10.003)")
def geo_polygon(spark, sf):
    ring = [(-10.003, -30.001), (-10.003, 60.007), (40.003, 60.007 - 0.25 * 50.006), (40.003, 0.5 * 50.006 - 30.001), (-10.003, -30.001)]
    return _points(spark, sf).where(geo.in_polygon(F.col("lat"), F.col("lon"), ring)).select("id")


@query(f"WITH {_P} SELECT id, round({_d(10.0, 20.0)}, 2) AS metres FROM p ORDER BY {_d(10.0, 20.0)}, id LIMIT 12")
def geo_nearest(spark, sf):
    key = distance_key(F.col("lat"), F.col("lon"), 10.0, 20.0)
    return page(_points(spark, sf), [key], "id", 12).select("id", F.round(key.value, 2).alias("metres"))


@query(
    f"""WITH {_P}, d AS (SELECT {_d(0.0, 0.0)} / 1000 AS km FROM p) SELECT place, label, count FROM (SELECT count(*) FILTER (km < 5000) AS a, count(*) FILTER (km <= 10000) AS b FROM d),
    LATERAL (SELECT * FROM (VALUES (0, 'near', a), (1, 'half', b)) v(place, label, count))"""
)
def geo_distance_facet(spark, sf):
    km = scalar.haversin_km(F.col("lat"), F.col("lon"), F.lit(0.0), F.lit(0.0))
    return facets.ranges(_points(spark, sf), km, [("near", None, True, 5000.0, False), ("half", None, True, 10000.0, True)])
