"""Registered queries on the bound test tables, and the same results as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placekeep.functions import predicates as P
from placekeep.functions import text as X
from placekeep.functions.geo import plan_stops
from placekeep.model import Places, bind, bound
from placekeep.operators import identity, matching, upsert
from placekeep.plans import cli, evidence, feeds, rosters, snapshot
from placekeep.session import checkpointed, table
from placekeep.sources import catalogues, pages

STATE = "NATION_3"
RARE = 20
ROUTE = [(30.0 + i * 0.05, -120.0 + i * 0.18) for i in range(200)]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query over the bound tables under its function's name."""

    def register(fn: Callable[[Places], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(bind(spark, sf_dir))
        if sql is not None:
            SQL[fn.__name__] = bound(sql)
        return fn

    return register


def table_query(sql: str | None = None):
    """Registers a query over (spark, sf_dir)."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


@query(
    f""", scoped AS (SELECT i.canonical_game_id AS game_id, i.canonical_name AS name, i.canonical_manufacturer AS manufacturer, a.location_id
        FROM identity i JOIN location_games lg ON lg.game_id = i.game_id JOIN active a ON a.location_id = lg.location_id)
    SELECT game_id, name, manufacturer, count(DISTINCT location_id) AS location_count FROM scoped GROUP BY 1, 2, 3
    HAVING count(DISTINCT location_id) <= {RARE} ORDER BY 4, 2, 1 LIMIT 25"""
)
def rare_games(p: Places) -> DataFrame:
    return cli.rare_items(p, RARE, 25)


@query(
    f"""SELECT 'locations' AS metric, count(*) AS value FROM locations
    UNION ALL SELECT 'active_locations', count(*) FROM active
    UNION ALL SELECT 'locations_in_state', count(*) FROM locations WHERE state = '{STATE}'
    UNION ALL SELECT 'active_locations_in_state', count(*) FROM active WHERE state = '{STATE}'
    UNION ALL SELECT 'source_a_locations', count(*) FROM locations WHERE location_id BETWEEN -1999999999 AND -1000000000
    UNION ALL SELECT 'source_b_locations', count(*) FROM locations WHERE location_id BETWEEN -2999999999 AND -2000000000
    UNION ALL SELECT 'games', count(*) FROM games
    UNION ALL SELECT 'source_a_games', count(*) FROM games WHERE game_id BETWEEN -1999999999 AND -1000000000
    UNION ALL SELECT 'source_b_games', count(*) FROM games WHERE game_id BETWEEN -2999999999 AND -2000000000
    UNION ALL SELECT 'location_games', count(*) FROM location_games
    UNION ALL SELECT 'active_location_games', count(*) FROM location_games JOIN active USING (location_id)
    UNION ALL SELECT 'pinball_rows', count(*) FROM location_games WHERE cabinet_type = 'Pinball'
    UNION ALL SELECT 'active_pinball_rows', count(*) FROM location_games JOIN active USING (location_id) WHERE cabinet_type = 'Pinball'
    UNION ALL SELECT 'canonical_links', count(*) FROM canonical_links"""
)
def summary_metrics(p: Places) -> DataFrame:
    return cli.summary(p, STATE)


@query(
    f"""SELECT coalesce(city, '') AS city, state, count(*) AS locations, CAST(sum(coalesce(game_count, 0)) AS BIGINT) AS listed_games,
        count(CASE WHEN location_id < 0 THEN 1 END) AS other_source_locations
    FROM active WHERE state = '{STATE}' GROUP BY 1, 2 ORDER BY 4 DESC, 3 DESC, 1 LIMIT 25"""
)
def city_summary(p: Places) -> DataFrame:
    return cli.city_summary(p, STATE, 25)


_PLACE = "location_id, name, type, city, state, street_address, postal_code, game_count, source_url, status, replacement_name"


@query(
    f"""SELECT {_PLACE} FROM active
    WHERE lower(name) LIKE lower('%r#00000000%') OR lower(coalesce(city, '')) LIKE lower('%r#00000000%') OR lower(coalesce(street_address, '')) LIKE lower('%r#00000000%')
    ORDER BY CASE WHEN lower(name) = lower('r#00000000') THEN 0 ELSE 1 END, game_count DESC NULLS LAST, name, location_id LIMIT 25"""
)
def search_locations_exact(p: Places) -> DataFrame:
    return cli.search_places(p, "r#00000000", 25, fuzzy=False)


@query()
def search_locations_fuzzy(p: Places) -> DataFrame:
    return cli.search_places(p, "Suplier#000000012", 25)


_ITEMS = f"""SELECT i.canonical_game_id AS game_id, i.canonical_name AS name, i.canonical_manufacturer AS manufacturer, count(DISTINCT i.game_id) AS source_game_rows,
        count(CASE WHEN a.location_id IS NOT NULL THEN lg.location_id END) AS location_count, count(CASE WHEN a.state = '{STATE}' THEN 1 END) AS state_location_count
    FROM identity i LEFT JOIN location_games lg ON lg.game_id = i.game_id LEFT JOIN active a ON a.location_id = lg.location_id
    WHERE lower(i.source_name) LIKE '%e%' OR lower(i.canonical_name) LIKE '%e%' OR lower(coalesce(i.source_manufacturer, '')) LIKE '%e%' OR lower(coalesce(i.canonical_manufacturer, '')) LIKE '%e%'
    GROUP BY 1, 2, 3 ORDER BY 6 DESC, 5 DESC, 2, 1"""


@query(_ITEMS + " LIMIT 25")
def search_games(p: Places) -> DataFrame:
    return cli.search_items(p, "e", STATE, 25, fuzzy=False)


@query()
def search_games_fuzzy(p: Places) -> DataFrame:
    return cli.search_items(p, "smal rng", STATE, 25)


@query(
    f""", wanted AS ({_ITEMS} LIMIT 8)
    SELECT a.location_id, a.name AS location, a.city, a.state, a.street_address, i.canonical_name AS game, i.canonical_manufacturer AS manufacturer, i.source_name AS source_game,
        lg.year, lg.cabinet_type, a.source_url, a.status, a.replacement_name
    FROM location_games lg JOIN active a USING (location_id) JOIN identity i USING (game_id) WHERE i.canonical_game_id IN (SELECT game_id FROM wanted)
    ORDER BY a.state, a.city, a.name, i.canonical_name, a.location_id, i.game_id, lg.year, lg.cabinet_type LIMIT 200"""
)
def where_to_play(p: Places) -> DataFrame:
    return cli.where_to_find(p, "e", STATE, 200, fuzzy=False)


def _one(p: Places, key: int) -> DataFrame:
    return p.locations.where(F.col("location_id") == key).select("location_id")


@query(
    """SELECT g.name AS game, g.manufacturer, lg.year, lg.cabinet_type, g.game_id FROM location_games lg JOIN games g USING (game_id) WHERE lg.location_id = 5
    ORDER BY CASE WHEN lg.cabinet_type = 'Pinball' THEN 0 ELSE 1 END, g.name, g.game_id, lg.year, lg.cabinet_type LIMIT 200"""
)
def inventory(p: Places) -> DataFrame:
    return cli.inventory_of(p, _one(p, 5), 200)


@query()
def inventory_by_name(p: Places) -> DataFrame:
    return cli.inventory(p, "Supplier#000000005", 200)


@query(
    """, l AS (SELECT i.canonical_game_id AS game_id, i.canonical_name AS name, i.canonical_manufacturer AS manufacturer FROM location_games lg JOIN identity i USING (game_id) WHERE lg.location_id = 1),
    r AS (SELECT i.canonical_game_id AS game_id, i.canonical_name AS name, i.canonical_manufacturer AS manufacturer FROM location_games lg JOIN identity i USING (game_id) WHERE lg.location_id = 2)
    SELECT 'shared' AS bucket, name, manufacturer, game_id FROM l WHERE game_id IN (SELECT game_id FROM r)
    UNION ALL SELECT 'only_left', name, manufacturer, game_id FROM l WHERE game_id NOT IN (SELECT game_id FROM r)
    UNION ALL SELECT 'only_right', name, manufacturer, game_id FROM r WHERE game_id NOT IN (SELECT game_id FROM l)
    ORDER BY 1, 2, 4 LIMIT 500"""
)
def compare_inventories(p: Places) -> DataFrame:
    return cli.compare_places(p, _one(p, 1), _one(p, 2), 500)


_HAV = "3958.7613 * 2 * atan2(sqrt({a}), sqrt(1 - {a}))"


def _hav_sql(lat: str, lon: str, lat2: str, lon2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon}) / 2), 2))"
    return f"(CAST(3958.7613 * 2 AS DOUBLE) * atan2(sqrt({a}), sqrt(1 - {a})))"


@query(
    f""", d AS (SELECT *, {_hav_sql("CAST(40 AS DOUBLE)", "CAST(-100 AS DOUBLE)", "latitude", "longitude")} AS exact_miles FROM active)
    SELECT round(exact_miles, 2) AS miles, location_id, name, type, city, state, street_address, game_count, source_url, status, replacement_name FROM d WHERE exact_miles <= 500
    ORDER BY 1, game_count DESC, name, location_id LIMIT 50"""
)
def nearby(p: Places) -> DataFrame:
    return cli.nearby(p, 40.0, -100.0, 500.0, 50)


@table_query("SELECT n_name, n_regionkey FROM nation")
def raw_sql_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "nation").createOrReplaceTempView("placekeep_nation")
    return cli.raw_sql(spark, "SELECT n_name, n_regionkey FROM placekeep_nation ORDER BY n_name;", 100)


@query(
    """SELECT l.location_id, l.name, l.city, l.state, l.street_address, l.game_count, s.status, s.replacement_name, s.confidence, s.verified_at, s.evidence
    FROM statuses s JOIN locations l USING (location_id) WHERE s.status NOT IN ('active', 'unverified', 'uncertain', 'matched', 'needs_review')
    ORDER BY l.state, l.city, l.name, l.location_id LIMIT 100"""
)
def inactive_locations(p: Places) -> DataFrame:
    return cli.inactive_places(p, 100)


@query(
    """, latest AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY checked_at DESC NULLS LAST, verification_id DESC NULLS LAST) AS rn FROM verifications)
    SELECT l.location_id, l.name, l.city, l.state, l.street_address, coalesce(s.status, v.status) AS status, v.provider, v.match_kind, v.confidence, v.checked_at, s.replacement_name
    FROM latest v JOIN locations l USING (location_id) LEFT JOIN statuses s USING (location_id) WHERE v.rn = 1
    ORDER BY CASE coalesce(s.status, v.status) WHEN 'replaced' THEN 0 WHEN 'closed' THEN 1 WHEN 'possible_replaced' THEN 2 WHEN 'not_found' THEN 3 WHEN 'needs_review' THEN 4 ELSE 5 END,
        v.confidence DESC NULLS LAST, l.name, l.location_id LIMIT 100"""
)
def verification_report(p: Places) -> DataFrame:
    return cli.verification_report(p, 100)


@query(
    """, latest AS (SELECT *, row_number() OVER (PARTITION BY location_id, provider ORDER BY checked_at DESC NULLS LAST, verification_id DESC NULLS LAST) AS rn FROM verifications)
    SELECT a.location_id, a.name, a.city, a.state, a.game_count, a.status, max(v.checked_at) AS last_checked_at, string_agg(DISTINCT v.provider, ',' ORDER BY v.provider) AS verification_sources
    FROM active a LEFT JOIN latest v ON v.location_id = a.location_id AND v.rn = 1 GROUP BY 1, 2, 3, 4, 5, 6
    HAVING max(v.checked_at) IS NULL OR coalesce(a.game_count, 0) >= 25
    ORDER BY CASE WHEN max(v.checked_at) IS NULL THEN 0 ELSE 1 END, coalesce(a.game_count, 0) DESC, a.state, a.city, a.name, a.location_id LIMIT 100"""
)
def latest_per_provider_review_queue(p: Places) -> DataFrame:
    return cli.review_queue(p, 100)


@query(
    """SELECT l.state, count(DISTINCT l.location_id) AS locations, count(DISTINCT CASE WHEN l.location_id > 0 THEN l.location_id END) AS native_locations,
        count(DISTINCT CASE WHEN l.location_id BETWEEN -1999999999 AND -1000000000 THEN l.location_id END) AS source_a_only_locations,
        count(DISTINCT CASE WHEN l.location_id BETWEEN -2999999999 AND -2000000000 THEN l.location_id END) AS source_b_only_locations,
        count(DISTINCT a.location_id) AS source_a_linked_locations, count(DISTINCT b.location_id) AS source_b_linked_locations, CAST(sum(coalesce(l.game_count, 0)) AS BIGINT) AS listed_game_count
    FROM locations l LEFT JOIN a_links a USING (location_id) LEFT JOIN b_links b USING (location_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60"""
)
def source_coverage(p: Places) -> DataFrame:
    return cli.source_coverage(p, 60)


@table_query(
    """SELECT a.c_nationkey AS state, a.c_mktsegment AS city, a.c_custkey AS left_id, a.c_name AS left_name, CAST(floor(a.c_acctbal / 5) AS VARCHAR) AS left_address,
        b.c_custkey AS right_id, b.c_name AS right_name, CAST(floor(b.c_acctbal / 5) AS VARCHAR) AS right_address
    FROM (SELECT * REPLACE (CAST(c_nationkey AS VARCHAR) AS c_nationkey) FROM customer) a JOIN (SELECT * REPLACE (CAST(c_nationkey AS VARCHAR) AS c_nationkey) FROM customer) b
      ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND b.c_custkey > a.c_custkey AND (lower(a.c_name) = lower(b.c_name) OR floor(a.c_acctbal / 5) = floor(b.c_acctbal / 5))
    ORDER BY 1, 2, 4, 3, 6 LIMIT 100""".replace("CAST(floor(a.c_acctbal / 5) AS VARCHAR)", "CAST(CAST(floor(a.c_acctbal / 5) AS BIGINT) AS VARCHAR)").replace("CAST(floor(b.c_acctbal / 5) AS VARCHAR)", "CAST(CAST(floor(b.c_acctbal / 5) AS BIGINT) AS VARCHAR)")
)
def duplicate_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    named = c.select(F.col("c_custkey").alias("location_id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("state"), F.col("c_mktsegment").alias("city"), F.floor(F.col("c_acctbal") / 5).cast("long").cast("string").alias("street_address"))
    return cli.duplicate_leads(named, 100)


@query(
    """SELECT k.alias_game_id, a.name AS alias_name, k.canonical_game_id, c.name AS canonical_name, k.confidence, k.reason, k.source
    FROM canonical_links k JOIN games a ON a.game_id = k.alias_game_id JOIN games c ON c.game_id = k.canonical_game_id
    WHERE lower(a.name) LIKE '%1%' OR lower(c.name) LIKE '%1%' OR lower(coalesce(a.manufacturer, '')) LIKE '%1%' OR lower(coalesce(c.manufacturer, '')) LIKE '%1%'
    ORDER BY k.confidence DESC, c.name, a.name, k.alias_game_id LIMIT 100"""
)
def game_aliases(p: Places) -> DataFrame:
    return cli.item_aliases(p, 100, "1")


@query(
    """, last AS (SELECT location_id, max(checked_at) AS last_checked_at FROM verifications GROUP BY 1)
    SELECT l.location_id, last_checked_at FROM (SELECT DISTINCT location_id FROM locations) l LEFT JOIN last USING (location_id)
    WHERE last_checked_at IS NULL OR last_checked_at < '2024-01-30T00:00:00'"""
)
def stale_verification(p: Places) -> DataFrame:
    return cli.needing_verification(p, p.locations, "2024-01-30T00:00:00")


@query(
    """, last AS (SELECT location_id, max(TRY_CAST(checked_at AS TIMESTAMP)) AS seen FROM verifications GROUP BY 1)
    SELECT a.location_id, a.name, a.game_count FROM active a LEFT JOIN last USING (location_id) WHERE (seen IS NULL OR seen < TIMESTAMP '2024-01-30 12:00:00') AND a.game_count >= 25
    ORDER BY seen NULLS FIRST, a.game_count DESC, a.location_id LIMIT 50"""
)
def scan_candidates(p: Places) -> DataFrame:
    return feeds.scan_candidates(p, "2024-01-30 12:00:00", 25)


@query(
    """, latest AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY TRY_CAST(checked_at AS TIMESTAMP) DESC NULLS LAST, verification_id DESC NULLS LAST) AS rn FROM verifications)
    SELECT l.location_id, l.name, coalesce(l.google_place_id, json_extract_string(v.raw_json, '$.k')) AS place_id, v.status, v.match_kind
    FROM latest v JOIN locations l USING (location_id) WHERE v.rn = 1 AND v.status IN ('closed', 'matched')"""
)
def legacy_candidates_json(p: Places) -> DataFrame:
    return feeds.legacy_candidates(p)


_METRICS = f""", placed AS (SELECT a.location_id, i.canonical_game_id, coalesce(lg.cabinet_type, '') AS cabinet_type FROM active a JOIN location_games lg USING (location_id) JOIN identity i USING (game_id)),
    nat AS (SELECT canonical_game_id, count(DISTINCT location_id) AS n FROM placed GROUP BY 1),
    metrics AS (SELECT a.location_id, a.name, coalesce(a.city, '') AS city, coalesce(a.state, '') AS state, coalesce(a.street_address, '') AS street_address, coalesce(a.website_url, '') AS website_url,
        coalesce(a.google_place_id, '') AS google_place_id, coalesce(a.google_cid, '') AS google_cid, a.latitude, a.longitude, count(p.canonical_game_id) AS machine_count,
        count(DISTINCT p.canonical_game_id) AS unique_game_count, CAST(sum(CASE WHEN p.cabinet_type = 'Pinball' THEN 1 ELSE 0 END) AS BIGINT) AS pinball_count,
        count(DISTINCT CASE WHEN n.n < {RARE} THEN p.canonical_game_id END) AS rare_us_count
    FROM active a LEFT JOIN placed p USING (location_id) LEFT JOIN nat n ON n.canonical_game_id = p.canonical_game_id GROUP BY ALL),
    shown AS (SELECT * FROM metrics WHERE machine_count > 0)"""
_ROLLED = "count(*) AS arcades, CAST(sum(machine_count) AS BIGINT) AS machines, CAST(sum(rare_us_count) AS BIGINT) AS rare_us_machines, CAST(sum(pinball_count) AS BIGINT) AS pinball_machines"


@query(_METRICS + " SELECT * FROM metrics")
def dashboard_metrics(p: Places) -> DataFrame:
    return snapshot.metrics(p, RARE)


@query(_METRICS + f" SELECT state, {_ROLLED}, state AS label FROM shown GROUP BY state")
def dashboard_states(p: Places) -> DataFrame:
    return snapshot.dashboard_states(snapshot.metrics(p, RARE), X.STATES)


@query(_METRICS + f" SELECT CASE WHEN trim(city) = '' THEN 'Unknown' ELSE trim(city) END AS city, state, {_ROLLED}, concat_ws(', ', CASE WHEN trim(city) = '' THEN 'Unknown' ELSE trim(city) END, state) AS label FROM shown GROUP BY 1, 2")
def dashboard_cities(p: Places) -> DataFrame:
    return snapshot.dashboard_cities(snapshot.metrics(p, RARE))


@query(_METRICS + " SELECT count(*) AS arcades, count(DISTINCT (CASE WHEN trim(city) = '' THEN 'Unknown' ELSE trim(city) END, state)) AS cities, count(DISTINCT state) AS states, CAST(coalesce(sum(machine_count), 0) AS BIGINT) AS machines, CAST(coalesce(sum(rare_us_count), 0) AS BIGINT) AS rare_us_machines FROM shown")
def dashboard_totals(p: Places) -> DataFrame:
    return snapshot.dashboard_totals(snapshot.metrics(p, RARE))


_BINS = ", ".join(f"('{label}', {low}, {high})" for low, high, label in snapshot.BINS)


@query(
    _METRICS
    + f""", bins(label, min, max) AS (VALUES {_BINS})
    SELECT b.label, b.min, b.max, count(s.location_id) AS arcades, CAST(coalesce(sum(s.machine_count), 0) AS BIGINT) AS machines, CAST(coalesce(sum(s.rare_us_count), 0) AS BIGINT) AS rare_us_machines
    FROM bins b LEFT JOIN shown s ON s.machine_count BETWEEN b.min AND b.max GROUP BY 1, 2, 3"""
)
def dashboard_histogram(p: Places) -> DataFrame:
    return snapshot.histogram(snapshot.metrics(p, RARE))


@query(
    _METRICS
    + """, m AS (SELECT *, 0 AS list, -machine_count AS o FROM (SELECT * FROM shown ORDER BY machine_count DESC, name, location_id LIMIT 100)),
    r AS (SELECT *, 1 AS list, -rare_us_count AS o FROM (SELECT * FROM shown ORDER BY rare_us_count DESC, name, location_id LIMIT 100)),
    u AS (SELECT *, row_number() OVER (PARTITION BY name, city, state ORDER BY list DESC, o DESC, location_id DESC) AS rn FROM (SELECT * FROM m UNION ALL SELECT * FROM r))
    SELECT name, city, state, location_id, machine_count AS machines, unique_game_count AS unique_games, rare_us_count AS rare_us_machines, pinball_count AS pinball_machines, latitude AS lat, longitude AS lon FROM u WHERE rn = 1"""
)
def dashboard_top_union(p: Places) -> DataFrame:
    return snapshot.largest(snapshot.metrics(p, RARE))


@query(_METRICS + " SELECT location_id, latitude AS lat, longitude AS lon, machine_count AS machines, rare_us_count AS rare FROM shown WHERE latitude BETWEEN 24.396308 AND 49.384358 AND longitude BETWEEN -124.848974 AND -66.885444")
def dashboard_heat(p: Places) -> DataFrame:
    return snapshot.heat_points(snapshot.metrics(p, RARE))


_ROUTES = """, route_locations AS (
    SELECT al.location_id, al.name, coalesce(al.city, '') AS city, coalesce(al.state, '') AS state, coalesce(al.street_address, '') AS street_address, coalesce(al.website_url, '') AS website_url,
        coalesce(al.google_place_id, '') AS google_place_id, coalesce(al.google_cid, '') AS google_cid, CAST(al.latitude AS REAL) AS latitude, CAST(al.longitude AS REAL) AS longitude, al.status,
        count(lg.game_id) AS game_count, count(DISTINCT i.canonical_game_id) AS unique_game_count, CAST(sum(CASE WHEN lg.cabinet_type = 'Pinball' THEN 1 ELSE 0 END) AS BIGINT) AS pinball_games,
        CAST(sum(CASE WHEN lower(coalesce(lg.cabinet_type, '')) IN ('music game', 'rhythm') OR lower(i.source_name) LIKE '%dance%' OR lower(i.source_name) LIKE '%pump it up%' OR lower(i.source_name) LIKE '%sound voltex%' THEN 1 ELSE 0 END) AS BIGINT) AS rhythm_games,
        trim((CASE WHEN max(a.location_id) IS NOT NULL THEN 'source A ' ELSE '' END) || (CASE WHEN max(b.location_id) IS NOT NULL THEN 'source B ' ELSE '' END)) AS source_tags
    FROM active al LEFT JOIN location_games lg USING (location_id) LEFT JOIN identity i USING (game_id) LEFT JOIN a_links a USING (location_id) LEFT JOIN b_links b USING (location_id)
    WHERE al.latitude IS NOT NULL AND al.longitude IS NOT NULL
    GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11 HAVING count(lg.game_id) > 0)"""
_SNAP = f""", us AS (SELECT i.canonical_game_id, count(DISTINCT lg.location_id) AS n FROM location_games lg JOIN identity i USING (game_id) JOIN active USING (location_id) GROUP BY 1),
    st AS (SELECT i.canonical_game_id, a.state, count(DISTINCT lg.location_id) AS n FROM location_games lg JOIN identity i USING (game_id) JOIN active a USING (location_id) GROUP BY 1, 2),
    snap AS (SELECT lg.location_id, a.state AS location_state, lg.game_id, i.source_name AS name, coalesce(i.source_manufacturer, '') AS manufacturer, i.canonical_game_id, i.canonical_name, coalesce(lg.cabinet_type, '') AS cabinet_type,
        coalesce(us.n, 0) AS us_location_count, coalesce(st.n, 0) AS state_location_count, CASE WHEN coalesce(us.n, 0) < {RARE} THEN 1 ELSE 0 END AS rare_us, CASE WHEN coalesce(st.n, 0) = 1 THEN 1 ELSE 0 END AS unique_state
    FROM location_games lg JOIN active a USING (location_id) JOIN identity i USING (game_id) LEFT JOIN us USING (canonical_game_id) LEFT JOIN st ON st.canonical_game_id = i.canonical_game_id AND st.state = a.state)"""


@query(_ROUTES + " SELECT * FROM route_locations")
def route_snapshot(p: Places) -> DataFrame:
    return snapshot.route_locations(p)


@query(_SNAP + " SELECT * FROM snap")
def placement_snapshot(p: Places) -> DataFrame:
    return snapshot.location_games(p, RARE)


@query(_SNAP + " SELECT CASE WHEN lower(cabinet_type) = 'pinball' THEN 'pinball' ELSE 'arcade' END AS kind, count(DISTINCT canonical_game_id) AS games FROM snap GROUP BY 1")
def browse_kinds(p: Places) -> DataFrame:
    return snapshot.browse_kinds(snapshot.location_games(p, RARE))


@query(_SNAP + " SELECT coalesce(nullif(manufacturer, ''), 'Unknown') AS manufacturer, count(DISTINCT canonical_game_id) AS games, CAST(sum(rare_us) AS BIGINT) AS rare_hits FROM snap WHERE lower(cabinet_type) <> 'pinball' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 80")
def browse_makers(p: Places) -> DataFrame:
    return snapshot.browse_makers(snapshot.location_games(p, RARE), "arcade")


@query(
    _SNAP
    + """ SELECT canonical_game_id, canonical_name, CASE WHEN lower(min(cabinet_type)) = 'pinball' THEN 'pinball' ELSE 'video' END AS machine_kind, min(us_location_count) AS us_location_count,
        count(DISTINCT location_id) AS listed_locations, max(rare_us) AS rare_us
    FROM snap WHERE lower(cabinet_type) = 'pinball' AND coalesce(nullif(manufacturer, ''), 'Unknown') = 'Brand#11' GROUP BY 1, 2 ORDER BY 4, 2, 1 LIMIT 120"""
)
def browse_games(p: Places) -> DataFrame:
    return snapshot.browse_items(snapshot.location_games(p, RARE), "pinball", "Brand#11")


_FOUND = "s.canonical_name, s.cabinet_type, s.us_location_count, s.state_location_count, s.rare_us, r.name AS location_name, r.city, r.state, r.street_address, r.game_count"


@query(_SNAP + _ROUTES + f" SELECT {_FOUND} FROM snap s JOIN route_locations r USING (location_id) WHERE s.canonical_name = (SELECT min(name) FROM games) ORDER BY r.state, r.city, r.name, location_id, s.game_id, s.cabinet_type LIMIT 120")
def browse_locations(p: Places) -> DataFrame:
    name = p.games.agg(F.min("name")).first()[0]
    return snapshot.browse_places(snapshot.location_games(p, RARE), snapshot.route_locations(p), name)


@query(_SNAP + _ROUTES + f" SELECT {_FOUND} FROM snap s JOIN route_locations r USING (location_id) WHERE lower(s.name) LIKE '%ring%' OR lower(s.canonical_name) LIKE '%ring%' ORDER BY s.us_location_count, r.game_count DESC, location_id, s.game_id, s.cabinet_type LIMIT 80")
def browse_search(p: Places) -> DataFrame:
    return snapshot.search_snapshot(snapshot.location_games(p, RARE), snapshot.route_locations(p), "ring")


def _trip_sql() -> str:
    from placekeep.functions.geo import corridor_box

    box = corridor_box(ROUTE, 80.0)
    points = ", ".join(f"({a!r}, {b!r})" for a, b in ROUTE)
    return (
        _ROUTES
        + f""", pts(a, b) AS (SELECT CAST(col0 AS DOUBLE), CAST(col1 AS DOUBLE) FROM (VALUES {points})),
    cand AS (SELECT * FROM route_locations WHERE CAST(latitude AS DOUBLE) BETWEEN {box[0]!r} AND {box[1]!r} AND CAST(longitude AS DOUBLE) BETWEEN {box[2]!r} AND {box[3]!r} ORDER BY game_count DESC, location_id LIMIT 2000),
    near AS (SELECT location_id, 2 * min({_hav_sql("CAST(latitude AS DOUBLE)", "CAST(longitude AS DOUBLE)", "a", "b")}) AS detour FROM cand, pts GROUP BY 1)
    SELECT location_id, c.name, c.game_count, round(detour, 4) AS detour_miles,
        round(c.game_count * 1.5 + c.pinball_games * 0.6 + c.rhythm_games * 2.0 + CASE WHEN source_tags <> '' THEN 10 ELSE 0 END - detour * 2.5, 4) AS score
    FROM cand c JOIN near USING (location_id) WHERE detour <= 80 ORDER BY c.game_count * 1.5 + c.pinball_games * 0.6 + c.rhythm_games * 2.0 + CASE WHEN source_tags <> '' THEN 10 ELSE 0 END - detour * 2.5 DESC, location_id LIMIT 25"""
    )


@query(_trip_sql())
def trip_corridor(p: Places) -> DataFrame:
    return plan_stops(snapshot.route_locations(p), ROUTE, 80.0).select("location_id", "name", "game_count", F.round("detour_miles", 4).alias("detour_miles"), F.round("score", 4).alias("score"))


@query(
    """SELECT l.location_id, l.name, l.game_count FROM locations l WHERE l.state IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4', 'NATION_5') AND l.game_count >= 10
      AND NOT EXISTS (SELECT 1 FROM statuses s WHERE s.location_id = l.location_id AND s.status IN ('closed', 'replaced')) ORDER BY l.game_count DESC, l.location_id LIMIT 50"""
)
def not_exists_check_list(p: Places) -> DataFrame:
    return feeds.check_list(p, ["NATION_1", "NATION_2", "NATION_3", "NATION_4", "NATION_5"], 10)


@query("SELECT k.location_id, k.source_id, l.state FROM a_links k JOIN locations l USING (location_id) LEFT JOIN statuses s USING (location_id) WHERE coalesce(s.status, 'active') NOT IN ('closed', 'replaced') AND l.state <> 'NATION_7' AND l.game_count >= 5")
def links_composed(p: Places) -> DataFrame:
    return feeds.links_to_validate(p, p.a_links, P.all_of([F.col("state") != "NATION_7", F.col("game_count") >= 5]))


@query("SELECT game_id, cabinet_type, n FROM (SELECT game_id, cabinet_type, count(*) AS n, row_number() OVER (PARTITION BY game_id ORDER BY count(*) DESC, cabinet_type) AS rn FROM location_games WHERE coalesce(cabinet_type, '') <> '' GROUP BY 1, 2) WHERE rn = 1")
def mode_cabinet(p: Places) -> DataFrame:
    return feeds.mode_of(p.location_games, "game_id", "cabinet_type")


@query("SELECT state, count(DISTINCT location_id) AS locations, count(DISTINCT CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN location_id END) AS with_coordinates, count(DISTINCT CASE WHEN coalesce(website_url, '') <> '' THEN location_id END) AS with_website, count(DISTINCT CASE WHEN coalesce(google_place_id, '') <> '' THEN location_id END) AS with_place_id, count(DISTINCT CASE WHEN location_id < 0 THEN location_id END) AS other_source_locations FROM active GROUP BY 1")
def quality_report(p: Places) -> DataFrame:
    return snapshot.quality(p)


@query("SELECT a.location_id, a.name, a.state, a.game_count, a.website_url, count(DISTINCT lg.game_id) AS listed FROM active a JOIN location_games lg USING (location_id) WHERE coalesce(a.website_url, '') <> '' GROUP BY 1, 2, 3, 4, 5 HAVING count(DISTINCT lg.game_id) >= 50 ORDER BY 6 DESC, 2, 1 LIMIT 25")
def roster_candidates(p: Places) -> DataFrame:
    return feeds.roster_candidates(p)


@query("SELECT DISTINCT lg.location_id, g.name FROM location_games lg JOIN games g USING (game_id) JOIN active USING (location_id)")
def roster_names(p: Places) -> DataFrame:
    return feeds.roster_names(p)


@query("SELECT g.game_id, g.name, coalesce(g.manufacturer, '') AS manufacturer, count(DISTINCT lg.location_id) AS location_count, count(DISTINCT CASE WHEN coalesce(s.status, 'active') IN ('active', 'unverified', 'uncertain', 'matched', 'needs_review') THEN lg.location_id END) AS active_location_count FROM games g LEFT JOIN location_games lg USING (game_id) LEFT JOIN statuses s USING (location_id) WHERE g.name <> '' GROUP BY 1, 2, 3")
def items_with_counts(p: Places) -> DataFrame:
    return identity.items_with_counts(p)


@query(
    """SELECT game_id, trim(regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS normal,
        replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(replace(lower(name), '&', ' and '), '\\bac\\s*/?\\s*dc\\b', 'acdc', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g')), '^the ', ''), ' the$', ''), ' ', '') AS title_key,
        trim(regexp_replace(lower(manufacturer), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS maker_key,
        CASE WHEN game_id > 0 THEN 'native' WHEN game_id BETWEEN -1999999999 AND -1000000000 THEN 'source_a' WHEN game_id BETWEEN -2999999999 AND -2000000000 THEN 'source_b' ELSE 'owner_roster' END AS source,
        CASE WHEN game_id BETWEEN -1999999999 AND -1000000000 THEN -game_id - 1000000000 WHEN game_id BETWEEN -2999999999 AND -2000000000 THEN -game_id - 2000000000 ELSE abs(game_id) END AS source_id
    FROM games"""
)
def title_keys(p: Places) -> DataFrame:
    k = F.col("game_id")
    return p.games.select("game_id", X.normal(F.col("name")).alias("normal"), X.title_key(F.col("name")).alias("title_key"), X.maker_key(F.col("manufacturer")).alias("maker_key"), identity.source_name(k).alias("source"), identity.source_id(k).alias("source_id"))


@query(
    """, items AS (SELECT g.game_id, g.name, g.manufacturer, count(DISTINCT lg.location_id) AS n, count(DISTINCT CASE WHEN coalesce(s.status, 'active') IN ('active', 'unverified', 'uncertain', 'matched', 'needs_review') THEN lg.location_id END) AS a
        FROM games g LEFT JOIN location_games lg USING (game_id) LEFT JOIN statuses s USING (location_id) GROUP BY 1, 2, 3),
    e AS (SELECT *, first_value(game_id) OVER (PARTITION BY name, manufacturer ORDER BY CASE WHEN game_id > 0 THEN 0 WHEN game_id >= -1999999999 THEN 1 ELSE 2 END, a DESC, n DESC, lower(name), abs(game_id)) AS canonical_game_id FROM items)
    SELECT game_id, canonical_game_id FROM e"""
)
def canonical_election(p: Places) -> DataFrame:
    return identity.elect(identity.items_with_counts(p), "name", "manufacturer").select("game_id", "canonical_game_id")


# Text forms, likeness and matching


@query(
    """SELECT game_id, substr(sha1(CAST(game_id AS VARCHAR)), 1, 15) AS digits, ('0x' || substr(sha1(CAST(game_id AS VARCHAR)), 1, 15))::BIGINT AS candidate_id FROM games"""
)
def candidate_hash(p: Places) -> DataFrame:
    k = F.col("game_id").cast("string")
    return p.games.select("game_id", F.substring(F.sha1(k), 1, 15).alias("digits"), X.hashed_id(k).alias("candidate_id"))


@query(
    """, items AS (SELECT g.game_id, g.name, g.manufacturer, count(DISTINCT lg.location_id) AS n, count(DISTINCT CASE WHEN coalesce(s.status, 'active') IN ('active', 'unverified', 'uncertain', 'matched', 'needs_review') THEN lg.location_id END) AS a
        FROM games g LEFT JOIN location_games lg USING (game_id) LEFT JOIN statuses s USING (location_id) WHERE g.name <> '' GROUP BY 1, 2, 3),
    keyed AS (SELECT *, replace(regexp_replace(lower(name), '^the | the$', '', 'g'), ' ', '') AS key FROM items),
    c AS (SELECT key, count(*) AS size, count(DISTINCT manufacturer) AS makers, min(lower(name)) AS t FROM keyed WHERE length(key) >= 4 GROUP BY 1),
    e AS (SELECT k.*, first_value(game_id) OVER w AS canonical_game_id, first_value(name) OVER w AS canonical_name FROM keyed k JOIN c USING (key) WHERE size >= 2 AND (makers = 1 OR length(t) >= 12 OR len(string_split(t, ' ')) >= 3)
        WINDOW w AS (PARTITION BY key ORDER BY CASE WHEN game_id > 0 THEN 0 WHEN game_id BETWEEN -1999999999 AND -1000000000 THEN 1 WHEN game_id BETWEEN -2999999999 AND -2000000000 THEN 2 ELSE 3 END, a DESC, n DESC, lower(name), abs(game_id)))
    SELECT game_id AS alias_game_id, canonical_game_id, CAST(1 AS DOUBLE) AS confidence, 'exact_compact_title' AS reason, name AS alias_name, canonical_name FROM e WHERE game_id <> canonical_game_id"""
)
def exact_title_clusters(p: Places) -> DataFrame:
    return matching.exact_title_links(identity.items_with_counts(p))


def _misspelt(p: Places) -> DataFrame:
    """Every item once more with a doubled letter, from an owner's roster."""
    items = identity.items_with_counts(p)
    return items.unionByName(items.select((-F.abs("game_id") - 5_000_000_000).alias("game_id"), F.concat(F.substring("name", 1, 5), F.substring("name", 5, 100)).alias("name"), "manufacturer", "location_count", "active_location_count"))


@query()
def spelling_pairs(p: Places) -> DataFrame:
    return matching.spelling_pairs(_misspelt(p).select("game_id", "name", F.lit("").alias("manufacturer"), "location_count", "active_location_count"))


@query()
def duplicate_groups(p: Places) -> DataFrame:
    types = p.location_games.groupBy("game_id").agg(F.array_sort(F.collect_set("cabinet_type")).alias("cabinet_types"), F.count("*").alias("active_placement_count"))
    # Without links every item is an identity of its own; makers are left out so that clusters are compatible.
    items = identity.one_hop(p.games, None).join(types, "game_id", "left").select("game_id", "canonical_game_id", F.col("source_name").alias("name"), F.lit("").alias("manufacturer"), F.coalesce("cabinet_types", F.array().cast("array<string>")).alias("cabinet_types"), F.coalesce("active_placement_count", F.lit(0).cast("long")).alias("active_placement_count"))
    return matching.review_candidates(matching.duplicate_groups(items.where(F.col("name") != "")))


def _copies(p: Places) -> DataFrame:
    """Source places: every place with an edited name."""
    return p.locations.select(F.abs("location_id").alias("source_id"), F.regexp_replace("name", "#0000", " ").alias("name"), "street_address", "city", "state", "postal_code", "latitude", "longitude")


@query()
def place_match(p: Places) -> DataFrame:
    return matching.place_matches(_copies(p), p.locations)


@query()
def game_match(p: Places) -> DataFrame:
    source = p.games.select(F.abs("game_id").alias("source_id"), F.concat(F.col("name"), F.lit(" premium")).alias("name"), "manufacturer")
    return matching.item_matches(source, p.games)


@query()
def directory_greedy(p: Places) -> DataFrame:
    return matching.directory_matches(_copies(p), p.locations)


# Mutations


def _changes(p: Places) -> DataFrame:
    return p.statuses.where(F.col("location_id") % 2 == 0).select("location_id", F.lit("matched").alias("status"), F.lit(None).cast("string").alias("replacement_name"), F.lit(0.9).alias("confidence"), F.lit("2024-02-01T00:00:00").alias("verified_at"), F.lit("source_a").alias("evidence"), F.lit("seen").alias("notes")).unionByName(
        p.locations.where(F.col("location_id") % 5 == 0).join(p.statuses.select("location_id"), "location_id", "left_anti").select("location_id", F.lit("needs_review").alias("status"), F.lit(None).cast("string").alias("replacement_name"), F.lit(0.6).alias("confidence"), F.lit("2024-02-01T00:00:00").alias("verified_at"), F.lit("source_a").alias("evidence"), F.lit("new").alias("notes"))
    )


_CHANGES = """, changes AS (
    SELECT location_id, 'matched' AS status, CAST(NULL AS VARCHAR) AS replacement_name, CAST(0.9 AS DOUBLE) AS confidence, '2024-02-01T00:00:00' AS verified_at, 'source_a' AS evidence, 'seen' AS notes FROM statuses WHERE location_id % 2 = 0
    UNION ALL SELECT location_id, 'needs_review', NULL, CAST(0.6 AS DOUBLE), '2024-02-01T00:00:00', 'source_a', 'new' FROM locations WHERE location_id % 5 = 0 AND location_id NOT IN (SELECT location_id FROM statuses))"""


@query(_CHANGES + " SELECT * FROM statuses WHERE location_id NOT IN (SELECT location_id FROM changes) UNION ALL SELECT * FROM changes")
def upsert_replace(p: Places) -> DataFrame:
    return upsert.replace_rows(p.statuses, _changes(p), ["location_id"])


def _merged(rule: str) -> str:
    cols = ", ".join(f"CASE WHEN c.location_id IS NULL THEN s.{x} WHEN s.location_id IS NULL THEN c.{x} ELSE {rule.format(x=x)} END AS {x}" for x in ("status", "replacement_name", "confidence", "verified_at", "evidence", "notes"))
    return _CHANGES + f" SELECT coalesce(s.location_id, c.location_id) AS location_id, {cols} FROM statuses s FULL OUTER JOIN changes c ON c.location_id = s.location_id"


@query(_merged("coalesce(s.{x}, c.{x})"))
def upsert_fill_only(p: Places) -> DataFrame:
    return upsert.upsert(p.statuses, _changes(p), ["location_id"], {})


@query(_merged("coalesce(c.{x}, s.{x})"))
def upsert_coalesce_new(p: Places) -> DataFrame:
    return upsert.upsert(p.statuses, _changes(p), ["location_id"], {}, default="prefer_new")


@query(
    """, fresh AS (SELECT location_id, CAST(0.92 AS DOUBLE) AS confidence, '2024-02-02T00:00:00' AS checked_at, 'fresh' AS notes FROM locations WHERE location_id % 2 = 0)
    SELECT coalesce(s.location_id, f.location_id) AS location_id, CASE WHEN open THEN 'matched' ELSE s.status END AS status, replacement_name, CASE WHEN open THEN f.confidence ELSE s.confidence END AS confidence,
        CASE WHEN open THEN f.checked_at ELSE s.verified_at END AS verified_at, CASE WHEN open THEN 'source_a' ELSE s.evidence END AS evidence,
        CASE WHEN open AND (s.location_id IS NULL OR s.evidence IS NULL OR s.evidence = 'source_a') THEN f.notes ELSE s.notes END AS notes
    FROM (SELECT s.location_id AS sid, f.location_id AS fid, f.location_id IS NOT NULL AND coalesce(s.status, 'active') NOT IN ('closed', 'replaced') AS open FROM statuses s FULL OUTER JOIN fresh f ON f.location_id = s.location_id) k
    LEFT JOIN statuses s ON s.location_id = k.sid LEFT JOIN fresh f ON f.location_id = k.fid"""
)
def status_policy(p: Places) -> DataFrame:
    fresh = p.locations.where(F.col("location_id") % 2 == 0).select("location_id", F.lit(0.92).alias("confidence"), F.lit("2024-02-02T00:00:00").alias("checked_at"), F.lit("fresh").alias("notes"))
    return upsert.apply_source_status(p.statuses, fresh, "source_a")


@query(
    """, base AS (SELECT location_id, CASE WHEN location_id % 3 = 0 THEN 'https://maps.m.en/x' ELSE website_url END AS website_url, street_address, latitude + CASE WHEN location_id % 4 = 0 THEN 1 ELSE 0 END AS latitude, longitude FROM locations),
    b AS (SELECT *, CASE WHEN lower(coalesce(website_url, '')) LIKE '%maps.m.en%' THEN NULL ELSE website_url END AS site FROM base)
    SELECT 'restored_locations' AS metric, count(*) AS value FROM locations c JOIN b USING (location_id) WHERE c.website_url IS DISTINCT FROM b.site OR c.street_address IS DISTINCT FROM b.street_address OR c.latitude IS DISTINCT FROM b.latitude OR c.longitude IS DISTINCT FROM b.longitude
    UNION ALL SELECT 'cleared_place_ids', count(*) FROM locations WHERE google_place_id IS NOT NULL OR google_cid IS NOT NULL
    UNION ALL SELECT 'cleared_bogus_websites', count(*) FROM locations WHERE lower(coalesce(website_url, '')) LIKE '%maps.m.en%'
    UNION ALL SELECT 'preserved_closures', count(*) FROM statuses JOIN locations USING (location_id) WHERE status = 'closed' AND evidence = 'maps_scan' AND lower(name) LIKE '%(closed)%'
    UNION ALL SELECT 'demoted_closures', count(*) FROM statuses JOIN locations USING (location_id) WHERE status = 'closed' AND evidence = 'maps_scan' AND NOT lower(name) LIKE '%(closed)%'"""
)
def repair_preview(p: Places) -> DataFrame:
    k = F.col("location_id")
    base = p.locations.select("location_id", F.when(k % 3 == 0, "https://maps.m.en/x").otherwise(F.col("website_url")).alias("website_url"), "street_address", (F.col("latitude") + F.when(k % 4 == 0, 1).otherwise(0)).alias("latitude"), "longitude")
    return upsert.repair_preview(upsert.repair_plan(p.locations, base, p.statuses, p.verifications, "maps_scan"))


@query(
    """, chain AS (SELECT abs(game_id) AS alias_game_id, abs(game_id) // 2 AS canonical_game_id FROM games WHERE abs(game_id) // 2 <> abs(game_id)),
    walk AS (WITH RECURSIVE w AS (SELECT alias_game_id, canonical_game_id FROM chain UNION ALL SELECT w.alias_game_id, c.canonical_game_id FROM w JOIN chain c ON c.alias_game_id = w.canonical_game_id) SELECT * FROM w)
    SELECT alias_game_id, canonical_game_id FROM walk WHERE canonical_game_id NOT IN (SELECT alias_game_id FROM chain)"""
)
def transitive_canonical(p: Places) -> DataFrame:
    # Each item points to the one of half its number.
    k = F.abs("game_id")
    return identity.transitive(p.games.select(k.alias("alias_game_id"), F.shiftright(k, 1).alias("canonical_game_id")))


@query(
    """SELECT name, manufacturer, game_id AS old_id, greatest(9999999, (SELECT max(game_id) FROM games)) + row_number() OVER (ORDER BY name, game_id) AS game_id
    FROM games WHERE game_id < 0"""
)
def allocated_ids(p: Places) -> DataFrame:
    return identity.allocate_ids(p.games.where("game_id < 0").select("name", "manufacturer", F.col("game_id").alias("old_id")), ["name", "old_id"], p.games)


# Pages and catalogues


@table_query()
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages.page_summaries(table(spark, sf_dir, "pages"))
    return df.select("page_id", F.explode("page.links").alias("link")).select("page_id", "link.text", "link.url")


@table_query()
def page_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rosters.page_lines(pages.page_summaries(table(spark, sf_dir, "pages")), "page_id")


@table_query()
def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rosters.generic_names(pages.page_summaries(table(spark, sf_dir, "pages")), "page_id")


@table_query()
def page_link_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rosters.probe_scores(pages.page_summaries(table(spark, sf_dir, "pages")), "page_id")


@query()
def roster_compare(p: Places) -> DataFrame:
    known = checkpointed(p.location_games.join(p.games, "game_id").select("location_id", "name").distinct())
    listed = known.where(F.length("name") % 3 != 0).select("location_id", F.concat(F.initcap("name"), F.lit(" (1999)")).alias("name")).withColumn("form", X.roster_name(F.col("name")))
    compared = checkpointed(rosters.compare_rosters(known, listed))
    return rosters.reconciliation(compared, rosters.pair_names(compared))


@table_query()
def csv_list_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One packed row per order, from its lines.
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("ids"))
    join = lambda c: F.array_join(c, ",")
    ids = F.col("ids").cast("array<string>")
    packed = lines.select(
        F.col("l_orderkey").cast("string").alias("Id"), F.lit("Place").alias("Name"), *[F.lit("nil").alias(c) for c in ("Street", "City", "State", "Zip", "Phone", "Lat", "Lon", "Website", "Description", "Date last updated")], F.size("ids").cast("string").alias("Machine count"), F.lit("restaurant").alias("Name [Location type]"),
        join(ids).alias("Id [Machines]"), join(F.transform(ids, lambda i: F.concat(F.lit("Item "), i))).alias("Name [Machines]"), *[F.lit("nil").alias(c) for c in ("Manufacturer [Machines]", "Year [Machines]", "Machine type [Machines]", "Machine display [Machines]", "Ipdb [Machines]", "Opdb [Machines]", "Id [Location machine xrefs]", "Ic enabled [Location machine xrefs]")],
    )
    return catalogues.unpack(packed)["placements"].drop("ic_enabled")


SQL["csv_list_explode"] = "SELECT -(1000000000 + l_partkey) AS placement_id, l_orderkey AS source_id, l_partkey AS machine_id FROM lineitem"


@table_query("SELECT o_orderkey AS placement_id, o_custkey AS source_id, o_orderkey AS machine_id FROM orders WHERE o_orderstatus <> 'F'")
def nested_json_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ref = F.struct(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "2024-01-01").alias("deleted_at"), F.struct(F.col("o_orderkey").alias("id"), F.lit("x").alias("name")).alias("machine"))
    per = o.groupBy("o_custkey").agg(F.collect_list(ref).alias("location_machine_xrefs")).select(F.struct(F.col("o_custkey").alias("id"), F.lit("Place").alias("name"), F.lit("US").alias("country"), "location_machine_xrefs").alias("l"))
    payload = per.groupBy(F.shiftright("l.id", 4).alias("position")).agg(F.to_json(F.struct(F.collect_list("l").alias("locations"))).alias("body"))
    return catalogues.region_bundle(payload)["placements"].drop("ic_enabled")


@query("SELECT s.location_id, s.status, s.notes FROM statuses s")
def jsonl_round_trip(p: Places) -> DataFrame:
    lines = catalogues.to_jsonl(p.statuses.select("location_id", "status", "notes"))
    return lines.select(F.from_json("value", "location_id long, status string, notes string").alias("r")).select("r.*")


@query()
def scan_classified(p: Places) -> DataFrame:
    k = F.abs("location_id")
    body = F.concat(F.col("name"), F.when(k % 4 == 0, " Permanently closed. permanently closed").when(k % 4 == 1, " Temporarily closed").otherwise(" Directions Website Reviews"))
    signals = p.locations.select(
        "location_id", body.alias("body_text"), F.col("name").alias("title"), F.array(F.concat(F.lit("Address: "), F.col("street_address"), F.lit(", "), F.col("city"))).alias("aria_labels"), F.array(F.struct(F.lit("Website: x").alias("label"), F.lit("").alias("text"), F.col("website_url").alias("href"))).alias("links"),
        F.lit("").alias("app_state"), F.concat(F.lit("https://maps.example/@"), F.format_string("%.6f,%.6f", "latitude", "longitude")).alias("final_url"), F.when(k % 7 != 0, F.col("name")).otherwise("Elsewhere").alias("primary_name"), body.alias("primary_text"),
        F.col("name").alias("expected_name"), F.col("street_address").alias("expected_address"), F.col("city").alias("expected_city"), F.col("street_address").alias("expected_street_address"), F.col("google_place_id").alias("asked_place_id"),
    )
    return evidence.classify_scans(signals).select("location_id", "status", F.round("confidence", 4).alias("confidence"), "match_kind", "website", "address", "latitude", "longitude")


@query(
    """SELECT location_id, CASE WHEN game_count <= 600 THEN 'source_no_machines' ELSE 'fresh_source' END AS status,
        CASE WHEN game_count <= 600 THEN CAST(0.65 AS DOUBLE) ELSE CAST(0.82 AS DOUBLE) + CASE WHEN location_id % 2 = 0 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END AS confidence FROM locations"""
)
def source_freshness(p: Places) -> DataFrame:
    k = F.col("location_id")
    df = p.locations.select("location_id", k.alias("id"), F.greatest(F.col("game_count") - 600, F.lit(0)).alias("machine_count"), F.when(k % 2 == 0, "2025-03-01").otherwise("2024-03-01").alias("date_last_updated"), F.lit(0).alias("user_submissions_count"), F.lit(False).alias("ic_active"), F.lit(False).alias("failed"))
    return evidence.source_freshness(df).select("location_id", "status", "confidence")


from placekeep import catalogue_parts  # noqa: E402, F401 (registers further queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
