"""Joins of points and routes with places, against every pair."""

import math
import random

import pytest
from pyspark.sql import functions as F

from placekeep.functions import geo
from placekeep.operators import spatial


def miles(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * geo.RADIUS_MILES * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


def scattered(rng, n):
    """Coordinates everywhere, many around one city, at the antimeridian, at the poles, and some that aren't valid."""
    out = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(n)]
    out += [(40 + rng.gauss(0, 0.2), -100 + rng.gauss(0, 0.2)) for _ in range(n)]
    out += [(rng.uniform(-60, 60), rng.choice([-1, 1]) * (180 - abs(rng.gauss(0, 0.3)))) for _ in range(n)]
    out += [(rng.choice([-1, 1]) * (90 - abs(rng.gauss(0, 0.5))), rng.uniform(-180, 180)) for _ in range(n)]
    return [*out, (None, 1.0), (1.0, None), (95.0, 0.0), (float("nan"), 0.0), (0.0, float("nan")), (90.0, 0.0), (-90.0, 5.0), (0.0, 180.0), (0.0, -180.0), (40.0, 260.0)]


def good(p):
    return p[0] is not None and p[1] is not None and -90 <= p[0] <= 90 and not math.isnan(p[1])


@pytest.mark.parametrize("radius, dense", [(5.0, 2000), (60.0, 2000), (60.0, 7), (1500.0, 40), (9000.0, 2000)])
def test_points_equal_every_pair(spark, monkeypatch, radius, dense):
    monkeypatch.setattr(spatial, "DENSE", dense)
    rng = random.Random(radius)
    points, places = scattered(rng, 60), scattered(rng, 80)
    a = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "point_id long, point_lat double, point_lon double")
    b = spark.createDataFrame([(k, *p) for k, p in enumerate(places)], "location_id long, latitude double, longitude double")
    got = {(r.point_id, r.location_id): r.exact_miles for r in spatial.within_miles(a, b, radius).collect()}
    want = {(i, j): miles(p, q) for i, p in enumerate(points) for j, q in enumerate(places) if good(p) and good(q) and miles(p, q) <= radius}
    assert got.keys() == want.keys() and len(want) > 50
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert spatial.within_miles(a, b, radius).count() == len(want)


def test_plan_has_no_product_and_no_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(spatial, "DENSE", 50)
    a = spark.range(400).select(F.col("id").alias("point_id"), (40 + F.rand(1) / 1000).alias("point_lat"), (-100 + F.rand(2) / 1000).alias("point_lon"))
    b = spark.range(700).select(F.col("id").alias("location_id"), (40 + F.rand(3) / 1000).alias("latitude"), (-100 + F.rand(4) / 1000).alias("longitude"))
    joined = spatial.within_miles(a, b, 10.0)
    assert joined.count() == 400 * 700
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    # Points and places of the one cell meet under many keys, each with few of both.
    parts = {}
    crowded = spark.createDataFrame([(1, 1, 8, 14)], "_row int, _col int, ps int, qs int")
    for name, df, n, own, other in (("p", a, 400, "ps", "qs"), ("q", b, 700, "qs", "ps")):
        dealt = spatial._split(df.withColumn("_row", F.lit(1)).withColumn("_col", F.lit(1)), own, other, crowded).groupBy("_ps", "_qs").count().collect()
        parts[name] = dealt
        assert len(dealt) == 8 * 14 and max(r["count"] for r in dealt) < 110


def test_nearest_equal_the_single_search(spark):
    rng = random.Random(3)
    places = spark.createDataFrame([(k, f"n{k % 7}", k % 5 or None, rng.uniform(30, 45), rng.uniform(-120, -80)) for k in range(300)], "location_id long, name string, game_count long, latitude double, longitude double")
    points = [(k, rng.uniform(30, 45), rng.uniform(-120, -80)) for k in range(6)]
    got = spatial.nearest_to_each(spark.createDataFrame(points, "point_id long, point_lat double, point_lon double"), places, 250.0, 8).collect()
    for k, lat, lon in points:
        near = geo.within_radius(places, lat, lon, 250.0).withColumn("miles", F.round("exact_miles", 2))
        want = near.orderBy("miles", F.coalesce("game_count", F.lit(0)).desc(), "name", "location_id").limit(8).collect()
        assert [r.location_id for r in sorted((r for r in got if r.point_id == k), key=lambda r: r.place)] == [r.location_id for r in want]


def test_routes_equal_single_routes(spark):
    rng = random.Random(8)
    places = spark.createDataFrame(
        [(k, k % 40 or None, k % 9, k % 4, "x" if k % 6 == 0 else None, rng.uniform(25, 49), rng.uniform(-124, -67)) for k in range(900)] + [(9001, 5, 1, 1, None, None, 1.0)],
        "location_id long, game_count long, pinball_games long, rhythm_games long, source_tags string, latitude double, longitude double",
    )
    routes = {1: [(30 + i * 0.05, -120 + i * 0.18) for i in range(200)], 2: [(45.0, -70.0)], 3: [(26 + i * 0.01, -81 + i * 0.004) for i in range(1700)], 4: [(0.0, 0.0), (1.0, 1.0)]}
    given = spark.createDataFrame([(r, k, *p) for r, ps in routes.items() for k, p in enumerate(ps)], "route_id long, seq long, lat double, lon double").repartition(5)
    got = spatial.plan_trips(given, places, 60.0, candidates=150, stops=10).collect()
    near = spatial.along_routes(given, places, 40.0).collect()
    for r, ps in routes.items():
        want = geo.plan_stops(places, ps, 60.0, candidates=150, stops=10).collect()
        mine = sorted((x for x in got if x.route_id == r), key=lambda x: x.place)
        assert [(x.location_id, round(x.score, 6)) for x in mine] == [(x.location_id, round(x.score, 6)) for x in want]
        looked = ps[:: max(1, len(ps) // geo.VERTICES)]
        plain = {x.location_id: min(miles((x.latitude, x.longitude), q) for q in looked) for x in places.where("latitude IS NOT NULL").collect()}
        assert {x.location_id: round(x.route_miles, 6) for x in near if x.route_id == r} == {k: round(v, 6) for k, v in plain.items() if v <= 40.0}
    plan = spatial.along_routes(given, places, 40.0)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_nearest_of_dense_places_meet_few(spark, monkeypatch):
    """Thousands of places within the radius of each point: only the near ones are met, and far points find theirs; ties of hundredths too."""
    rng = random.Random(12)
    rows = [(k, f"n{k % 7}", k % 5, round(40 + rng.random(), 3), round(-100 + rng.random(), 3)) for k in range(2500)] + [(9000 + k, "far", 1, 44.0, -100.0 + k / 10) for k in range(4)]
    places = spark.createDataFrame(rows, "location_id long, name string, game_count long, latitude double, longitude double")
    points = [(k, 40 + rng.random(), -100 + rng.random()) for k in range(25)] + [(100, 43.9, -100.0), (101, 60.0, 0.0), (102, None, 1.0)]
    seen, real = [], spatial.within_miles

    def counted(*args):
        out = real(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(spatial, "within_miles", counted)
    got = spatial.nearest_to_each(spark.createDataFrame(points, "point_id long, point_lat double, point_lon double"), places, 250.0, 5).collect()
    assert sum(seen) < 10_000
    for k, lat, lon in points:
        near = sorted((round(d, 2), -g, n, i) for i, n, g, a, b in rows if lat is not None and (d := miles((lat, lon), (a, b))) <= 250.0)
        assert [r.location_id for r in sorted((r for r in got if r.point_id == k), key=lambda r: r.place)] == [x[-1] for x in near[:5]]


def test_points_and_cells_are_not_broadcast(spark, monkeypatch):
    """Spark takes points for small, as it doesn't count their rows for each cell; only crowded cells may go through the driver."""
    plans, real = [], spatial.checkpointed

    def noted(df):
        out = real(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(spatial, "checkpointed", noted)
    points = spark.range(300).select(F.col("id").alias("point_id"), (40 + F.rand(1)).alias("point_lat"), (-100 + F.rand(2)).alias("point_lon"))
    places = spark.range(2000).select(F.col("id").alias("location_id"), F.lit("n").alias("name"), F.col("id").alias("game_count"), (40 + F.rand(3)).alias("latitude"), (-100 + F.rand(4)).alias("longitude"))
    nearest = spatial.nearest_to_each(points, places, 250.0, 5)
    assert nearest.count() == 1500
    routes = points.select(F.col("point_id").alias("route_id"), F.lit(0).alias("seq"), F.col("point_lat").alias("lat"), F.col("point_lon").alias("lon"))
    boxes = spatial.in_route_boxes(routes, places, 20.0)
    assert boxes.count() > 300
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in (nearest, boxes)]
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line and "WholeStage" not in line.split("Join")[0]]
    assert sum("SortMergeJoin" in x for x in joins) >= 4
    assert all("LeftOuter" in x for x in joins if "Broadcast" in x), joins
