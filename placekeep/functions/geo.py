"""Distances in miles, radius and corridor searches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placekeep.functions.predicates import in_box

#: The earth's radius in miles, and miles in a degree of latitude.
RADIUS_MILES = 3958.7613
DEGREE_MILES = 69.0
#: Fixed values of the trip planner: vertices looked at, candidates, stops.
VERTICES, CANDIDATES, STOPS = 650, 2000, 25


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle miles; null if any coordinate is."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.lit(RADIUS_MILES * 2) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def within_radius(df: DataFrame, lat: float, lon: float, miles: float) -> DataFrame:
    """Rows with latitude and longitude within ``miles``, with the exact distance as ``exact_miles``.

    A latitude band, which the scan can prune by, stands before the exact test.
    """
    band = math.degrees(miles / RADIUS_MILES) + 1e-6
    near = df.where(F.col("latitude").between(lat - band, lat + band) & F.col("longitude").isNotNull())
    return near.withColumn("exact_miles", haversine(F.lit(lat), F.lit(lon), F.col("latitude").cast("double"), F.col("longitude").cast("double"))).where(F.col("exact_miles") <= miles)


def corridor_box(route: list[tuple[float, float]], miles: float) -> tuple[float, float, float, float]:
    """Bounds of the route, padded by ``miles``."""
    lats, lons = [p[0] for p in route], [p[1] for p in route]
    middle = math.radians((min(lats) + max(lats)) / 2)
    lat_pad, lon_pad = miles / DEGREE_MILES, miles / max(20.0, DEGREE_MILES * math.cos(middle))
    return min(lats) - lat_pad, max(lats) + lat_pad, min(lons) - lon_pad, max(lons) + lon_pad


def route_distance(route: list[tuple[float, float]]) -> Column:
    """Miles to the nearest looked-at vertex of the route.

    The vertices are at most about twice ``VERTICES`` literals, so the minimum
    is an expression over an array, without a join.
    """
    stride = max(1, len(route) // VERTICES)
    points = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in route[::stride]])
    return F.array_min(F.transform(points, lambda p: haversine(F.col("latitude").cast("double"), F.col("longitude").cast("double"), p["a"], p["b"])))


def plan_stops(places: DataFrame, route: list[tuple[float, float]], detour: float, candidates: int = CANDIDATES, stops: int = STOPS) -> DataFrame:
    """Best stops near a route: the largest candidates in its box, scored by what they offer less the detour."""
    near = places.where(in_box(F.col("latitude"), F.col("longitude"), corridor_box(route, detour)))
    largest = near.orderBy(F.desc("game_count"), "location_id").limit(candidates)
    scored = largest.withColumn("detour_miles", route_distance(route) * 2)
    tags = F.when(F.coalesce("source_tags", F.lit("")) != "", 10.0).otherwise(0.0)
    score = F.coalesce("game_count", F.lit(0)) * 1.5 + F.coalesce("pinball_games", F.lit(0)) * 0.6 + F.coalesce("rhythm_games", F.lit(0)) * 2.0 + tags - F.col("detour_miles") * 2.5
    return scored.where(F.col("detour_miles") <= detour).withColumn("score", score).orderBy(F.desc("score"), "location_id").limit(stops)
