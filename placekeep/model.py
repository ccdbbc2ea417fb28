"""The logical model: places, the items found there, and the evidence behind both.

Operators take a ``Places``, a set of DataFrames with the columns below. The
sidecar tables may be missing; queries then leave out what depends on them.
``bind`` derives a ``Places`` from the star-schema tables of the test data.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

from placekeep.session import table


def _struct(**columns) -> StructType:
    return StructType([StructField(n, t() if isinstance(t, type) else t) for n, t in columns.items()])


S, L, D, T = StringType, LongType, DoubleType, TimestampType

#: Columns of the owned tables.
SCHEMAS: dict[str, StructType] = {
    "locations": _struct(location_id=L, name=S, type=S, city=S, state=S, street_address=S, postal_code=S, phone=S, address_text=S, website_url=S, google_place_id=S, google_cid=S, is_public=L, game_count=L, unique_game_count=L, world_record_count=L, updated_text=S, description=S, latitude=D, longitude=D, detail_fetched_at=S, source_url=S),
    "games": _struct(game_id=L, name=S, manufacturer=S),
    "location_games": _struct(location_id=L, game_id=L, cabinet_type=S, year=L, players=L, controls_condition=L, screen_condition=L, cabinet_condition=L, fetched_at=S),
    "location_types": _struct(type_id=S, name=S),
    "location_index_sources": _struct(location_id=L, source=S, fetched_at=S),
    "scrape_runs": _struct(run_id=L, started_at=S, finished_at=S, notes=S),
    "location_statuses": _struct(location_id=L, status=S, replacement_name=S, confidence=D, verified_at=S, evidence=S, notes=S),
    "location_verifications": _struct(verification_id=L, location_id=L, checked_at=S, provider=S, status=S, match_kind=S, query=S, matched_name=S, matched_address=S, matched_latitude=D, matched_longitude=D, distance_miles=D, confidence=D, evidence_url=S, raw_json=S, notes=S),
    "a_links": _struct(location_id=L, source_id=L, confidence=D, method=S, linked_at=S),
    "b_links": _struct(location_id=L, source_id=L, confidence=D, method=S, linked_at=S),
    "b_machine_links": _struct(location_id=L, source_location_id=L, source_machine_id=L, source_game_id=L, game_id=L, confidence=D, method=S, linked_at=S),
    "game_canonical_links": _struct(alias_game_id=L, canonical_game_id=L, confidence=D, reason=S, source=S, notes=S, created_at=T, updated_at=T),
    "game_source_records": _struct(source=S, source_game_id=S, game_id=L, source_name=S, source_manufacturer=S, first_seen_at=T, last_seen_at=T, legacy_game_id=L),
    "game_identity_sequence": _struct(sequence_name=S, next_game_id=L),
    "duplicate_review_candidates": _struct(candidate_id=L, title_key=S, min_score=D, affected_locations=L, priority=D, status=S, created_at=T, updated_at=T),
    "duplicate_review_records": _struct(candidate_id=L, game_id=L, name=S, manufacturer=S, source=S, active_locations=L),
    "duplicate_review_decisions": _struct(candidate_id=L, decision=S, notes=S, decided_at=T),
    "web_roster_actions": _struct(location_id=L, action=S, name=S, game_id=L, score=D, applied_at=S),
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    """An empty table of the model."""
    return spark.createDataFrame([], SCHEMAS[name])


def evolve(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the columns of the model that it lacks, as nulls, in the model's order; further ones follow."""
    have = set(df.columns)
    own = [F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]]
    known = {f.name for f in SCHEMAS[name]}
    return df.select(*own, *[c for c in df.columns if c not in known])


@dataclass(frozen=True)
class Places:
    locations: DataFrame
    games: DataFrame
    location_games: DataFrame
    statuses: DataFrame | None = None
    verifications: DataFrame | None = None
    canonical_links: DataFrame | None = None
    a_links: DataFrame | None = None
    b_links: DataFrame | None = None
    scope: tuple[str, ...] | None = None

    def without(self, *names: str) -> Places:
        return replace(self, **{n: None for n in names})


#: Offsets of the id ranges of the two other sources.
A_OFFSET, B_OFFSET = 1_000_000_000, 2_000_000_000


def place_key(key: Column) -> Column:
    """Test binding: every tenth id, from 3 and from 7, belongs to source A and B."""
    return F.when(key % 10 == 3, -(F.lit(A_OFFSET) + key)).when(key % 10 == 7, -(F.lit(B_OFFSET) + key)).otherwise(key).cast("long")


def bind(spark: SparkSession, sf_dir: str) -> Places:
    """Suppliers as places, parts as items, line items as placements, events as evidence."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    supplier, part = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    placements = table(spark, sf_dir, "lineitem").select(
        place_key(F.col("l_suppkey")).alias("location_id"),
        place_key(F.col("l_partkey")).alias("game_id"),
        F.when(F.col("l_returnflag") == "R", "Pinball").otherwise(F.col("l_returnflag")).alias("cabinet_type"),
        F.year("l_shipdate").cast("long").alias("year"),
    )
    counts = placements.groupBy("location_id").agg(F.count("*").alias("game_count"))
    k = F.col("s_suppkey")
    venues = (
        supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
        .join(region, nation["n_regionkey"] == region["r_regionkey"])
        .select(
            place_key(k).alias("location_id"),
            F.col("s_name").alias("name"),
            F.when(k % 2 == 0, "Bar").otherwise("Hall").alias("type"),
            F.col("r_name").alias("city"),
            F.col("n_name").alias("state"),
            F.concat(F.col("s_nationkey").cast("string"), F.lit(" Main Street")).alias("street_address"),
            F.lpad((k % 97).cast("string"), 5, "0").alias("postal_code"),
            F.when(k % 5 != 0, F.concat(F.lit("https://"), F.lower("s_name"), F.lit(".example/"))).alias("website_url"),
            F.when(k % 4 == 1, F.concat(F.lit("place-"), k.cast("string"))).alias("google_place_id"),
            F.lit(None).cast("string").alias("google_cid"),
            (F.lit(25.0) + (k * 37 % 2400) / 100.0).alias("latitude"),
            (F.lit(-124.0) + (k * 53 % 5700) / 100.0).alias("longitude"),
            F.concat(F.lit("https://source.example/"), k.cast("string")).alias("source_url"),
        )
    )
    locations = venues.join(counts, "location_id", "left").withColumn("game_count", F.coalesce("game_count", F.lit(0).cast("long")))
    statuses = supplier.select(
        place_key(k).alias("location_id"),
        F.when(F.col("s_acctbal") < 0, "closed").when(k % 7 == 0, "needs_review").when(k % 11 == 0, "possible_replaced").alias("status"),
        F.when(k % 22 == 0, F.concat(F.lit("New "), F.col("s_name"))).alias("replacement_name"),
        (F.lit(0.5) + (k % 50) / 100.0).alias("confidence"),
        F.lit("2024-01-15T00:00:00").alias("verified_at"),
        F.when(k % 2 == 0, "maps_scan").alias("evidence"),
        F.lit(None).cast("string").alias("notes"),
    ).where("status IS NOT NULL")
    games = part.select(place_key(F.col("p_partkey")).alias("game_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("manufacturer"))
    firsts = part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("first"))
    links = (
        part.join(firsts, ["p_name", "p_brand"])
        .where("p_partkey <> first")
        .select(place_key(F.col("p_partkey")).alias("alias_game_id"), place_key(F.col("first")).alias("canonical_game_id"), F.lit(1.0).alias("confidence"), F.lit("exact_compact_title").alias("reason"), F.lit("auto").alias("source"))
    )
    e = F.col("event_id")
    verifications = table(spark, sf_dir, "events").select(
        e.alias("verification_id"),
        place_key(F.col("user_id")).alias("location_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("checked_at"),
        F.col("event_type").alias("provider"),
        F.when(e % 13 == 0, "closed").when(e % 17 == 0, "not_found").when(e % 19 == 0, "replaced").otherwise("matched").alias("status"),
        F.when(e % 3 == 0, "name_address").otherwise("address").alias("match_kind"),
        (e % 100 / 100.0).alias("confidence"),
        F.col("props").alias("raw_json"),
    )
    a_first = supplier.where(k % 3 == 0).select(place_key(k).alias("location_id"), k.alias("source_id"))
    a_second = supplier.where(k % 9 == 0).select(place_key(k).alias("location_id"), (k + 100_000).alias("source_id"))
    b_links = supplier.where(k % 4 == 0).select(place_key(k).alias("location_id"), k.alias("source_id"))
    scope = tuple(f"NATION_{i}" for i in range(1, 24))
    return Places(locations, games, placements, statuses, verifications, links, a_first.unionByName(a_second), b_links, scope)


def _key_sql(key: str) -> str:
    return f"CAST(CASE WHEN {key} % 10 = 3 THEN -({A_OFFSET} + {key}) WHEN {key} % 10 = 7 THEN -({B_OFFSET} + {key}) ELSE {key} END AS BIGINT)"


#: The same binding as common table expressions.
BOUND_SQL = f"""
location_games AS (
    SELECT {_key_sql("l_suppkey")} AS location_id, {_key_sql("l_partkey")} AS game_id,
           CASE WHEN l_returnflag = 'R' THEN 'Pinball' ELSE l_returnflag END AS cabinet_type, CAST(year(l_shipdate) AS BIGINT) AS year
    FROM lineitem),
locations AS (
    SELECT {_key_sql("s_suppkey")} AS location_id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'Bar' ELSE 'Hall' END AS type, r_name AS city, n_name AS state,
           CAST(s_nationkey AS VARCHAR) || ' Main Street' AS street_address, lpad(CAST(s_suppkey % 97 AS VARCHAR), 5, '0') AS postal_code,
           CASE WHEN s_suppkey % 5 <> 0 THEN 'https://' || lower(s_name) || '.example/' END AS website_url,
           CASE WHEN s_suppkey % 4 = 1 THEN 'place-' || s_suppkey END AS google_place_id, CAST(NULL AS VARCHAR) AS google_cid,
           CAST(25 AS DOUBLE) + (s_suppkey * 37 % 2400) / CAST(100 AS DOUBLE) AS latitude, CAST(-124 AS DOUBLE) + (s_suppkey * 53 % 5700) / CAST(100 AS DOUBLE) AS longitude,
           'https://source.example/' || s_suppkey AS source_url, coalesce(c.n, 0) AS game_count
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) c ON c.l_suppkey = s_suppkey),
statuses AS (
    SELECT * FROM (
        SELECT {_key_sql("s_suppkey")} AS location_id,
               CASE WHEN s_acctbal < 0 THEN 'closed' WHEN s_suppkey % 7 = 0 THEN 'needs_review' WHEN s_suppkey % 11 = 0 THEN 'possible_replaced' END AS status,
               CASE WHEN s_suppkey % 22 = 0 THEN 'New ' || s_name END AS replacement_name, CAST(0.5 AS DOUBLE) + (s_suppkey % 50) / CAST(100 AS DOUBLE) AS confidence,
               '2024-01-15T00:00:00' AS verified_at, CASE WHEN s_suppkey % 2 = 0 THEN 'maps_scan' END AS evidence, CAST(NULL AS VARCHAR) AS notes
        FROM supplier) WHERE status IS NOT NULL),
games AS (SELECT {_key_sql("p_partkey")} AS game_id, p_name AS name, p_brand AS manufacturer FROM part),
canonical_links AS (
    SELECT {_key_sql("p_partkey")} AS alias_game_id, {_key_sql("first")} AS canonical_game_id, CAST(1 AS DOUBLE) AS confidence, 'exact_compact_title' AS reason, 'auto' AS source
    FROM part JOIN (SELECT p_name AS n, p_brand AS b, min(p_partkey) AS first FROM part GROUP BY 1, 2) ON p_name = n AND p_brand = b WHERE p_partkey <> first),
verifications AS (
    SELECT event_id AS verification_id, {_key_sql("user_id")} AS location_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS checked_at, event_type AS provider,
           CASE WHEN event_id % 13 = 0 THEN 'closed' WHEN event_id % 17 = 0 THEN 'not_found' WHEN event_id % 19 = 0 THEN 'replaced' ELSE 'matched' END AS status,
           CASE WHEN event_id % 3 = 0 THEN 'name_address' ELSE 'address' END AS match_kind, event_id % 100 / CAST(100 AS DOUBLE) AS confidence, props AS raw_json
    FROM events),
a_links AS (
    SELECT {_key_sql("s_suppkey")} AS location_id, s_suppkey AS source_id FROM supplier WHERE s_suppkey % 3 = 0
    UNION ALL SELECT {_key_sql("s_suppkey")}, s_suppkey + 100000 FROM supplier WHERE s_suppkey % 9 = 0),
b_links AS (SELECT {_key_sql("s_suppkey")} AS location_id, s_suppkey AS source_id FROM supplier WHERE s_suppkey % 4 = 0),
identity AS (
    SELECT g.game_id, coalesce(k.canonical_game_id, g.game_id) AS canonical_game_id, coalesce(c.name, g.name) AS canonical_name,
           coalesce(c.manufacturer, g.manufacturer) AS canonical_manufacturer, g.name AS source_name, g.manufacturer AS source_manufacturer
    FROM games g LEFT JOIN canonical_links k ON k.alias_game_id = g.game_id LEFT JOIN games c ON c.game_id = k.canonical_game_id),
active AS (
    SELECT l.*, coalesce(s.status, 'active') AS status, s.replacement_name
    FROM locations l LEFT JOIN statuses s USING (location_id)
    WHERE coalesce(s.status, 'active') IN ('active', 'unverified', 'uncertain', 'matched', 'needs_review')
      AND upper(l.state) IN ({", ".join(f"'NATION_{i}'" for i in range(1, 24))}))
"""


def bound(sql: str) -> str:
    """``sql`` over the binding; it may begin with further common table expressions and a SELECT."""
    return f"WITH {BOUND_SQL} {sql}"
