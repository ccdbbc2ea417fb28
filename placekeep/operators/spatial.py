"""Joins of many points, or many routes, with many places.

The sphere is cut into rows of latitude as high as the radius, and each row into
columns that are as wide as the radius at its far edge, so that a circle reaches
the row above and below and the columns at either side. Places stand in one cell,
points in each cell that their circle touches; they meet on equal cells and are
then measured. Cells with more than ``DENSE`` rows of a side are dealt to
several keys: a cell of many points and many places is split both ways, so that
no task sees more than about ``DENSE`` of either.

Spark's estimates of size don't see that points become a row for each cell, so
left alone it may broadcast them all through the driver. These joins are asked to
shuffle both sides; only crowded cells are broadcast, up to ``BROADCAST_CELLS``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placekeep.functions.geo import CANDIDATES, DEGREE_MILES, RADIUS_MILES, STOPS, VERTICES, haversine
from placekeep.session import checkpointed

#: Rows of a side in a cell before it is split.
DENSE = 2000
#: Cells that are broadcast as crowded, at most; more are joined by a shuffle.
BROADCAST_CELLS = 100_000


def _valid(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.isNotNull() & ~F.isnan(lon)


def _turn(lon: Column) -> Column:
    """Degrees east of the antimeridian, from 0 to 360."""
    return F.pmod(lon + 180.0, F.lit(360.0))


def _columns(row: Column, height: float, angle: float) -> Column:
    """Columns of a row: each is no narrower than the radius is in the row and those beside it; 1 near the poles."""
    edge = F.greatest(F.abs((row - 1) * height - 90.0), F.abs((row + 2) * height - 90.0))
    share = math.sin(min(angle, math.pi) / 2) / F.cos(F.radians(F.least(edge, F.lit(89.9))))
    width = F.degrees(2 * F.asin(F.least(share, F.lit(1.0)))) * 1.0001
    return F.when((edge >= 89.9) | (share >= 1.0), F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(360.0 / width))).cast("int")


def _column(lon: Column, columns: Column) -> Column:
    return F.least(F.floor(_turn(lon) / 360.0 * columns), columns - 1).cast("int")


def _shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast, whatever its estimated size."""
    return df.hint("merge")


def _split(df: DataFrame, own: str, other: str, sizes: DataFrame) -> DataFrame:
    """Rows with a part of their own side and one row for each part of the other side, where the cell is crowded."""
    few = F.broadcast(sizes) if sizes.count() <= BROADCAST_CELLS else _shuffled(sizes)
    joined = df.join(few, ["_row", "_col"], "left")
    mine = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce(own, F.lit(1))).cast("int")
    return joined.withColumn(f"_{own}", mine).withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)).cast("int") - 1))).drop(own, other)


def within_miles(points: DataFrame, places: DataFrame, miles: float) -> DataFrame:
    """All columns of ``points`` and ``places`` and exact_miles, for each point and each place within ``miles`` of it.

    ``points`` has point_lat and point_lon, ``places`` latitude and longitude;
    other names mustn't clash. Rows without valid coordinates meet nothing;
    longitudes may lie beyond 180 degrees. Circles reach over the antimeridian
    and the poles.
    """
    angle = miles / RADIUS_MILES
    height = math.degrees(angle) * 1.0001 + 1e-9
    lat, lon = F.col("latitude").cast("double"), F.col("longitude").cast("double")
    at = places.where(_valid(lat, lon)).withColumn("_row", F.floor((lat + 90.0) / height).cast("int"))
    at = at.withColumn("_col", _column(lon, _columns(F.col("_row"), height, angle)))
    plat, plon = F.col("point_lat").cast("double"), F.col("point_lon").cast("double")
    row = F.floor((plat + 90.0) / height).cast("int")
    reach = points.where(_valid(plat, plon)).withColumn("_row", F.explode(F.sequence(row - 1, row + 1)))
    reach = reach.withColumn("_n", _columns(F.col("_row"), height, angle)).withColumn("_c", _column(plon, F.col("_n")))
    # In another row a column has another width, but is never narrower than the circle there.
    sides = F.array_distinct(F.transform(F.sequence(F.col("_c") - 1, F.col("_c") + 1), lambda c: F.pmod(c, F.col("_n"))))
    reach = reach.withColumn("_col", F.explode(sides)).drop("_n", "_c")
    count = lambda df, name: df.groupBy("_row", "_col").agg(F.count("*").alias(name))
    parts = lambda c: F.ceil(F.col(c) / DENSE).cast("int")
    crowded = count(reach, "_p").join(_shuffled(count(at, "_q")), ["_row", "_col"]).where((F.col("_p") > DENSE) | (F.col("_q") > DENSE))
    crowded = checkpointed(crowded.select("_row", "_col", parts("_p").alias("ps"), parts("_q").alias("qs")))
    keys = ["_row", "_col", "_ps", "_qs"]
    met = _split(reach, "ps", "qs", crowded).join(_shuffled(_split(at, "qs", "ps", crowded)), keys).drop(*keys)
    distance = haversine(plat, plon, lat, lon)
    return met.withColumn("exact_miles", distance).where(F.col("exact_miles") <= miles)


def nearest_to_each(points: DataFrame, places: DataFrame, miles: float, limit: int) -> DataFrame:
    """For each point_id the ``limit`` nearest places within ``miles``, in the order of the radius search.

    The radius grows: points look first as far as holds about twice ``limit``
    places where these are dense; those that find too few look twice as far. So
    the pairs grow with the points, not with the places within ``miles`` of each.
    """
    order = [F.col("miles"), F.coalesce("game_count", F.lit(0)).desc(), F.col("name").asc_nulls_last(), F.col("location_id")]
    w = Window.partitionBy("point_id").orderBy(*order)

    def nearest(some: DataFrame, radius: float) -> DataFrame:
        near = within_miles(some, places, radius).withColumn("miles", F.round("exact_miles", 2))
        return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).drop("point_lat", "point_lon", "exact_miles")

    rest, done, places = points.select("point_id", "point_lat", "point_lon"), None, checkpointed(places)
    radius = _first_radius(places, miles, limit)
    while radius < miles:
        # A place beyond the radius may round to the same hundredth of a mile.
        last_is_sure = (F.col("place") == limit) & (F.col("miles") <= radius - 0.01)
        found = checkpointed(nearest(rest, radius).withColumn("_sure", F.max(last_is_sure).over(Window.partitionBy("point_id"))))
        part = found.where("_sure").drop("_sure")
        done = part if done is None else done.unionByName(part)
        sure = found.where(F.col("_sure") & (F.col("place") == limit)).select(F.col("point_id").alias("_id"))
        rest = checkpointed(rest.join(_shuffled(sure), F.col("point_id").eqNullSafe(F.col("_id")), "left_anti"))
        if rest.isEmpty():
            return done
        radius *= 2
    last = nearest(rest, miles)
    return last if done is None else done.unionByName(last)


def _first_radius(places: DataFrame, miles: float, limit: int) -> float:
    """A radius with about twice ``limit`` places around an average place, ``miles`` at most."""
    height = math.degrees(miles / RADIUS_MILES)
    lat, lon = F.col("latitude").cast("double"), F.col("longitude").cast("double")
    cells = places.where(_valid(lat, lon)).groupBy(F.floor(lat / height), F.floor(_turn(lon) * F.cos(F.radians(lat)) / height)).agg(F.count("*").cast("double").alias("n"))
    row = cells.agg(F.sum(F.col("n") * F.col("n")).alias("square"), F.sum("n").alias("n")).first()
    if not row.n:
        return miles
    # Cells are as high and wide as ``miles``.
    radius = miles * math.sqrt(2 * limit / (math.pi * row.square / row.n))
    return radius if radius < miles / 2 else miles


def vertices(routes: DataFrame) -> DataFrame:
    """(route_id, point_lat, point_lon): the looked-at vertices of ``routes`` (route_id, seq, lat, lon), every stride-th from the first."""
    w = Window.partitionBy("route_id")
    numbered = routes.withColumn("_k", F.row_number().over(w.orderBy("seq")) - 1).withColumn("_n", F.count("*").over(w))
    stride = F.greatest(F.lit(1), F.floor(F.col("_n") / VERTICES))
    return numbered.where(F.col("_k") % stride == 0).select("route_id", F.col("lat").cast("double").alias("point_lat"), F.col("lon").cast("double").alias("point_lon"))


def along_routes(routes: DataFrame, places: DataFrame, miles: float) -> DataFrame:
    """Columns of ``places`` with route_id and route_miles: places within ``miles`` of a looked-at vertex, and the least distance."""
    near = within_miles(vertices(routes), places.select("location_id", "latitude", "longitude"), miles)
    least = near.groupBy("route_id", "location_id").agg(F.min("exact_miles").alias("route_miles"))
    return least.join(places, "location_id")


#: Degrees of the cells in which routes' boxes meet places.
BOX_CELL = 2.0


def in_route_boxes(routes: DataFrame, places: DataFrame, miles: float) -> DataFrame:
    """Columns of ``places`` with route_id, for each place in the padded box of a route."""
    box = routes.groupBy("route_id").agg(F.min("lat").alias("_s"), F.max("lat").alias("_n"), F.min("lon").alias("_w"), F.max("lon").alias("_e"))
    pad = miles / F.greatest(F.lit(20.0), DEGREE_MILES * F.cos(F.radians((F.col("_s") + F.col("_n")) / 2)))
    box = box.select("route_id", (F.col("_s") - miles / DEGREE_MILES).alias("_s"), (F.col("_n") + miles / DEGREE_MILES).alias("_n"), (F.col("_w") - pad).alias("_w"), (F.col("_e") + pad).alias("_e"))
    cell = lambda c: F.floor(c / BOX_CELL).cast("int")
    span = lambda a, b: F.explode(F.sequence(cell(F.col(a)), cell(F.col(b))))
    cells = box.withColumn("_row", span("_s", "_n")).withColumn("_col", span("_w", "_e"))
    lat, lon = F.col("latitude").cast("double"), F.col("longitude").cast("double")
    at = places.where(lat.isNotNull() & lon.isNotNull()).withColumn("_row", cell(lat)).withColumn("_col", cell(lon))
    inside = lat.between(F.col("_s"), F.col("_n")) & lon.between(F.col("_w"), F.col("_e"))
    return at.join(_shuffled(cells), ["_row", "_col"]).where(inside).drop("_row", "_col", "_s", "_n", "_w", "_e")


def plan_trips(routes: DataFrame, places: DataFrame, detour: float, candidates: int = CANDIDATES, stops: int = STOPS) -> DataFrame:
    """The stops that ``geo.plan_stops`` gives for each of many routes (route_id, seq, lat, lon), with route_id and place.

    Only each route's largest candidates go on from the boxes; a route's
    looked-at vertices are an array of about twice ``VERTICES`` at most.
    """
    largest = Window.partitionBy("route_id").orderBy(F.col("game_count").desc_nulls_last(), "location_id")
    points = vertices(routes).groupBy("route_id").agg(F.collect_list(F.struct(F.col("point_lat").alias("a"), F.col("point_lon").alias("b"))).alias("_points"))
    chosen = in_route_boxes(routes, places, detour).withColumn("_c", F.row_number().over(largest)).where(F.col("_c") <= candidates).drop("_c")
    lat, lon = F.col("latitude").cast("double"), F.col("longitude").cast("double")
    distance = F.array_min(F.transform("_points", lambda p: haversine(lat, lon, p["a"], p["b"])))
    scored = chosen.join(points, "route_id").withColumn("detour_miles", distance * 2).drop("_points").where(F.col("detour_miles") <= detour)
    tags = F.when(F.coalesce("source_tags", F.lit("")) != "", 10.0).otherwise(0.0)
    score = F.coalesce("game_count", F.lit(0)) * 1.5 + F.coalesce("pinball_games", F.lit(0)) * 0.6 + F.coalesce("rhythm_games", F.lit(0)) * 2.0 + tags - F.col("detour_miles") * 2.5
    best = Window.partitionBy("route_id").orderBy(F.desc("score"), "location_id")
    return scored.withColumn("score", score).withColumn("place", F.row_number().over(best)).where(F.col("place") <= stops)
