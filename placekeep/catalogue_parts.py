"""Registered queries of single parts: text and address forms, sources, feeds, mutations; with the same results as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placekeep.catalogue import query, table_query
from placekeep.functions import predicates as P
from placekeep.functions import text as X
from placekeep.model import Places, bound
from placekeep.operators import buckets, identity, matching, spatial, upsert
from placekeep.operators.text_index import TextIndex
from placekeep.plans import curation, evidence, feeds, rosters, snapshot
from placekeep.session import by_rows, shared_folder, table
from placekeep.sources import catalogues, pages

AT = "2024-03-01 00:00:00"


# Text forms


@query(
    """SELECT location_id, street_address AS street, 'Ogden' AS city, 'UT' AS state, postal_code, '801-555-0100' AS phone FROM locations"""
)
def address_blocks(p: Places) -> DataFrame:
    block = F.concat(F.col("street_address"), F.lit("\n Ogden,  ut "), F.col("postal_code"), F.lit("\n801-555-0100"))
    return p.locations.select("location_id", X.address_parts(block).alias("a")).select("location_id", "a.*")


@query(
    """SELECT location_id, CASE location_id % 4 WHEN 0 THEN 'UT' WHEN 1 THEN 'NV' WHEN 2 THEN 'DC' WHEN -1 THEN 'NV' WHEN -2 THEN 'DC' END AS state,
        CAST(NULL AS VARCHAR) AS other FROM locations"""
)
def state_codes(p: Places) -> DataFrame:
    k = F.col("location_id") % 4
    name = F.when(k == 0, " utah ").when(F.abs(k) == 1, "Nv").when(F.abs(k) == 2, "D.C.").otherwise("Utopia")
    return p.locations.select("location_id", X.state_code(name).alias("state"), X.state_code(F.lit("")).alias("other"))


@query(
    """SELECT location_id, 'h' || abs(location_id) || '.example' AS host, location_id AS id, location_id % 2 = 0 AS internal, location_id % 3 = 0 AS trusted,
        substr(sha256(source_url), 1, 24) AS cache_key FROM locations"""
)
def url_parts(p: Places) -> DataFrame:
    k = F.col("location_id")
    name = F.concat(F.lit("h"), F.abs(k).cast("string"))
    site = F.concat(F.lit("WWW."), name, F.lit(".example/a?x=1"))
    other = F.when(k % 2 == 0, F.concat(F.lit("http://"), name, F.lit(".example/b"))).otherwise(F.lit("https://elsewhere.example/"))
    third = F.when(k % 3 == 0, F.lit("https://shop.square.site/menu")).otherwise(F.lit("https://unsquare.site"))
    found = F.when(k < 0, -X.id_in_url(F.concat(F.lit("https://s.example/map?by_location_id="), (-k).cast("string")))).otherwise(X.id_in_url(F.concat(F.lit("https://s.example/map?by_location_id="), k.cast("string"))))
    return p.locations.select("location_id", X.host(site).alias("host"), found.alias("id"), feeds.is_internal(site, other).alias("internal"), feeds.is_trusted(third, ["square.site"]).alias("trusted"), pages.cache_key(F.col("source_url")).alias("cache_key"))


@query(
    """SELECT location_id, name || ', ' || city AS joined, 'pinball' AS kind, rtrim(rtrim(printf('%.3f', latitude), '0'), '.') AS latitude, true AS held,
        CASE WHEN website_url IS NOT NULL THEN website_url WHEN google_place_id IS NOT NULL THEN 'https://p.example/' || google_place_id ELSE 'https://s.example/' || replace(replace(name, '#', '%23'), ' ', '+') || '+' || replace(city, ' ', '+') END AS url
    FROM locations"""
)
def place_texts(p: Places) -> DataFrame:
    c = F.col
    url = feeds.place_url(c("website_url"), c("google_place_id"), c("name"), c("city"), "https://p.example/", "https://s.example/")
    return p.locations.select("location_id", P.joined_text(c("name"), F.lit(None), F.lit(""), c("city")).alias("joined"), X.machine_kind(F.lit("PinBall")).alias("kind"), X.stringify(c("latitude")).alias("latitude"), X.holds_words(F.lower(F.concat_ws(" ", "city", "state")), F.lower("city")).alias("held"), url.alias("url"))


@query(
    """SELECT game_id, CASE WHEN abs(game_id) % 3 = 0 THEN -(1000000000 + abs(game_id)) ELSE -(2000000000 + abs(game_id)) END AS own, abs(game_id) AS back FROM games WHERE abs(game_id) < 900000000"""
)
def source_ids(p: Places) -> DataFrame:
    k = F.abs("game_id")
    own = F.when(k % 3 == 0, identity.a_id(k)).otherwise(identity.b_id(k))
    return p.games.where(k < 900_000_000).select("game_id", own.alias("own"), identity.source_id(own).alias("back"))


# Sources


@query("SELECT location_id, name, game_count, type, city, state, is_public, website_url FROM (SELECT abs(location_id) AS location_id, name, game_count, type, city, state, CAST(abs(location_id) % 2 = 0 AS INTEGER) AS is_public, website_url FROM locations)")
def index_table(p: Places) -> DataFrame:
    k = F.abs("location_id")
    cell = lambda c: F.concat(F.lit("<td> "), F.coalesce(c, F.lit("")), F.lit("</td>"))
    site = F.when(F.col("website_url").isNotNull(), F.concat(F.lit('<a href="'), F.col("website_url"), F.lit('">site</a>')))
    name = F.concat(F.lit('<a href="/place.aspx?id='), k.cast("string"), F.lit('">'), F.col("name"), F.lit("</a>"))
    row = F.concat(F.lit("<tr>"), cell(F.lit("1")), cell(name), cell(F.format_number("game_count", 0)), cell(F.col("type")), cell(F.col("city")), cell(F.col("state")), cell(F.when(k % 2 == 0, "Yes").otherwise("No")), cell(site), F.lit("</tr>"))
    head = "<html><table id='other'><tr><td>x</td></tr></table><table id='grid'><tr><th>#</th></tr>"
    page = p.locations.groupBy(F.pmod(k, F.lit(7)).alias("page")).agg(F.concat(F.lit(head), F.array_join(F.collect_list(row), "\n"), F.lit("</table></html>")).alias("html"))
    return pages.index_rows(page.withColumn("url", F.lit("https://i.example/")), "grid")


@query("SELECT abs(location_id) AS location_id, name, type, website_url, street_address, game_count, latitude, longitude FROM locations")
def detail_pages(p: Places) -> DataFrame:
    span = lambda i, c: F.concat(F.lit(f'<span id="{i}">'), F.coalesce(c, F.lit("")), F.lit("</span>"))
    link = F.when(F.col("website_url").isNotNull(), F.concat(F.lit("<a  href='"), F.col("website_url"), F.lit("'>x</a>")))
    html = F.concat(
        F.lit('<div id="T">Location: '), F.col("name"), F.lit("</div>"), span("Y", F.col("type")), span("W", link), span("A", F.concat("street_address", F.lit("<br/>Ogden, UT 84401"))), span("G", F.format_number("game_count", 0)),
        F.lit("<script>var lat = "), F.col("latitude").cast("string"), F.lit("; var lon = "), F.col("longitude").cast("string"), F.lit(";</script>"),
    )
    ids = {"title": "T", "type": "Y", "updated": "U", "website": "W", "address": "A", "games": "G", "unique": "N", "records": "R", "description": "D"}
    df = p.locations.select(F.abs("location_id").alias("location_id"), html.alias("html"))
    return pages.detail_rows(df, ids).select("location_id", "name", "type", "website_url", "street_address", "game_count", "latitude", "longitude")


@table_query("SELECT s_suppkey AS source_id, s_name AS name, 'UT' AS state, CAST(s_suppkey % 50 AS DOUBLE) AS latitude FROM supplier WHERE s_suppkey % 5 <> 0")
def directory_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    entry = F.struct(F.when(k % 5 == 0, F.lit("x")).otherwise(k.cast("string")).alias("id"), F.concat(F.lit(" "), F.col("s_name")).alias("name"), F.lit("utah").alias("subregion"), (k % 50).cast("string").alias("latitude"))
    body = s.groupBy(F.pmod(k, F.lit(3)).alias("part")).agg(F.to_json(F.struct(F.collect_list(entry).alias("arcades"))).alias("body"))
    return catalogues.directory_entries(body).select("source_id", "name", "state", "latitude")


@table_query("SELECT o_custkey AS source_id, o_orderkey AS machine_id, o_orderkey AS source_game_id, o_orderpriority AS name, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 100 END AS condition FROM orders WHERE o_orderkey % 7 <> 0")
def directory_machine_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    game = F.struct(k.cast("string").alias("id"), F.concat(F.col("o_orderpriority"), F.lit(" ")).alias("name"), F.lit("Video").alias("genre"))
    machine = F.struct(F.when(k % 7 == 0, F.lit("?")).otherwise(k.cast("string")).alias("id"), F.when(k % 2 == 0, (k % 100).cast("string")).otherwise("worn").alias("condition"), game.alias("game"))
    per = o.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(machine).alias("machines"))
    entry = F.struct(F.col("id").cast("string").alias("id"), F.lit("UT").alias("subregion"), "machines")
    body = per.groupBy(F.shiftright("id", 4).alias("part")).agg(F.to_json(F.struct(F.collect_list(entry).alias("arcades"))).alias("body"))
    return catalogues.directory_machines(catalogues.directory_entries(body)).select("source_id", "machine_id", "source_game_id", "name", "condition")


@query("SELECT game_id, max(CASE WHEN rn = 1 THEN year END) AS year FROM (SELECT game_id, year, row_number() OVER (PARTITION BY game_id ORDER BY year) AS rn FROM location_games) GROUP BY 1")
def first_values(p: Places) -> DataFrame:
    rows = p.location_games.select("game_id", F.col("year").alias("position"), "year")
    return catalogues.merge_first(rows, "game_id", ["position"])


# Feeds


@query("SELECT location_id, abs(location_id) AS source_id, CAST(1 AS DOUBLE) AS confidence, CASE WHEN abs(location_id) % 6 = 0 THEN 'manual_override' ELSE 'source_url' END AS method FROM locations WHERE abs(location_id) % 3 = 0")
def discovered_links(p: Places) -> DataFrame:
    k = F.abs("location_id")
    own = p.locations.withColumn("source_url", F.when(k % 3 == 0, F.concat(F.lit("https://s.example/map?by_location_id="), k.cast("string"))).otherwise(F.lit("https://s.example/")))
    known = {abs(r.location_id): r.location_id for r in p.locations.where(k % 6 == 0).select("location_id").collect()}
    listed = p.locations.where(k % 6 == 0).select(k.alias("source_id"), "name", "street_address", "city", "state", "postal_code")
    return feeds.discover_links(Places(**{**p.__dict__, "locations": own}), listed, known)


def _compared(p: Places) -> DataFrame:
    k = F.abs("game_id")
    names = p.location_games.join(p.games, "game_id").select("location_id", F.concat_ws(" ", "name", k).alias("name"), (k % 3).alias("n")).distinct()
    n = F.col("n")
    return names.select("location_id", F.when(n == 0, "missing").when(n == 1, "matched").otherwise("website_only").alias("bucket"), "name")


_COMPARED = """, compared AS (SELECT DISTINCT location_id, name || ' ' || abs(game_id) AS name, CASE abs(game_id) % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'matched' ELSE 'website_only' END AS bucket FROM location_games JOIN games USING (game_id)),
    counted AS (SELECT location_id, count(*) FILTER (WHERE bucket = 'matched') AS matched, count(*) FILTER (WHERE bucket = 'missing') AS missing, count(*) FILTER (WHERE bucket = 'website_only') AS website_only FROM compared GROUP BY 1),
    rated AS (SELECT *, matched + missing AS known, CASE WHEN matched + missing > 0 THEN matched / (matched + missing) ELSE 0 END AS share FROM counted)"""


@query(_COMPARED + " SELECT location_id, matched, missing, website_only, known, round(share, 4) AS match_ratio, known > 0 AND (matched >= 20 OR (matched >= 10 AND share >= 0.5)) AS likely_manifest FROM rated")
def roster_manifest(p: Places) -> DataFrame:
    return rosters.manifest(_compared(p))


@query(
    _COMPARED
    + """ SELECT l.location_id, l.game_count, 2 AS roster_page_count, 30 AS extracted_name_count, matched, known, round(share, 4) AS match_ratio, website_only, 'https://r.example/2' AS best_roster_url, 'B' AS best_roster_title
    FROM locations l JOIN rated USING (location_id) WHERE matched >= 20 OR (matched >= 10 AND share >= 0.5) ORDER BY matched DESC, game_count DESC, location_id LIMIT 40"""
)
def selected_manifest(p: Places) -> DataFrame:
    pages_ = p.locations.select("location_id", F.explode(F.array(*[F.struct(F.lit(ok).alias("ok"), F.lit(f"https://r.example/{n}").alias("url"), F.lit(t).alias("title"), F.lit(c).alias("names"), F.lit(1).alias("roster_score")) for n, ok, t, c in ((1, True, "A", 10), (2, True, "B", 20), (3, False, "C", 90))])).alias("g")).select("location_id", "g.*")
    rows = feeds.manifest_rows(p.locations.select("location_id", "game_count"), pages_, _compared(p))
    return feeds.select_manifest(rows, 40).drop("likely_manifest")


@query("SELECT verification_id, location_id FROM verifications WHERE verification_id % 3 = 0")
def unfinished_rows(p: Places) -> DataFrame:
    done = F.when(F.col("verification_id") % 3 != 0, F.col("checked_at"))
    return feeds.unfinished(p.verifications, done).select("verification_id", "location_id")


@query("SELECT location_id, name, game_count FROM locations ORDER BY game_count DESC, lower(name), name LIMIT 10")
def top_places(p: Places) -> DataFrame:
    return feeds.top_labels(p.locations, "name", "game_count").select("location_id", "name", "game_count")


@query(
    """SELECT location_id, CASE WHEN google_place_id IS NOT NULL THEN 'place_id_url_v2' ELSE 'search_url_v2' END AS kind, name || ' ' || street_address || ' ' || city || ' ' || state AS query,
        CASE WHEN google_place_id IS NOT NULL THEN 'https://p.example/' || google_place_id ELSE 'https://s.example/' || replace(replace(name || ' ' || street_address || ' ' || city || ' ' || state, '#', '%23'), ' ', '+') END AS url FROM locations"""
)
def scan_work_items(p: Places) -> DataFrame:
    return feeds.work_items(p.locations.withColumn("place_id", F.col("google_place_id")), "https://s.example/", "https://p.example/")


@query("SELECT location_id, name FROM locations WHERE location_id NOT IN (SELECT location_id FROM statuses) ORDER BY location_id LIMIT 20")
def next_batch(p: Places) -> DataFrame:
    return curation.scan_batches(p.locations, p.statuses, 20).select("location_id", "name")


# Mutations


@query("SELECT location_id, n AS game_count, u AS unique_game_count FROM (SELECT l.location_id, count(lg.game_id) AS n, count(DISTINCT lg.game_id) AS u FROM locations l LEFT JOIN (SELECT * FROM location_games WHERE cabinet_type = 'Pinball') lg USING (location_id) GROUP BY 1)")
def recounted_places(p: Places) -> DataFrame:
    places = p.locations.withColumn("unique_game_count", F.lit(0).cast("long"))
    return upsert.recount(places, p.location_games.where("cabinet_type = 'Pinball'")).select("location_id", "game_count", "unique_game_count")


_FOUND = ", found AS (SELECT location_id, 'place-x' AS google_place_id, CASE WHEN abs(location_id) % 2 = 0 THEN 'https://new.example/' END AS website_url FROM locations WHERE abs(location_id) % 3 = 0)"


@query(_FOUND + " SELECT location_id, coalesce(l.google_place_id, f.google_place_id) AS google_place_id, coalesce(l.website_url, f.website_url) AS website_url, coalesce(f.website_url, l.website_url) AS overwritten FROM locations l LEFT JOIN found f USING (location_id)")
def filled_metadata(p: Places) -> DataFrame:
    k = F.abs("location_id")
    found = p.locations.where(k % 3 == 0).select("location_id", F.lit("place-x").alias("google_place_id"), F.when(k % 2 == 0, "https://new.example/").alias("website_url"))
    filled = upsert.update_metadata(p.locations, found).select("location_id", "google_place_id", "website_url")
    over = upsert.update_metadata(p.locations, found, overwrite=True).select("location_id", F.col("website_url").alias("overwritten"))
    return filled.join(over, "location_id")


@query("SELECT (SELECT max(verification_id) FROM verifications) + row_number() OVER (ORDER BY verification_id) AS verification_id, location_id, '2025-01-01T' || lpad(CAST(verification_id AS VARCHAR), 10, '0') AS checked_at FROM verifications")
def appended_evidence(p: Places) -> DataFrame:
    at = F.concat(F.lit("2025-01-01T"), F.lpad(F.col("verification_id").cast("string"), 10, "0"))
    rows = p.verifications.withColumn("checked_at", at).drop("verification_id")
    return upsert.append_evidence(p.verifications, rows, ["checked_at"]).where("checked_at >= '2025'").select("verification_id", "location_id", "checked_at")


@query("SELECT location_id, game_id, cabinet_type, year FROM (SELECT location_id, game_id, min(cabinet_type) AS cabinet_type, min(year) AS year FROM location_games GROUP BY 1, 2) WHERE abs(game_id) % 2 = 0 UNION ALL SELECT DISTINCT location_id, game_id, 'new', CAST(NULL AS BIGINT) FROM location_games WHERE abs(game_id) % 2 = 1")
def appended_if_new(p: Places) -> DataFrame:
    every = by_rows(p.location_games, "location_id", "game_id").groupBy("location_id", "game_id").agg(F.min("cabinet_type").alias("cabinet_type"), F.min("year").alias("year"))
    new = every.select("location_id", "game_id", F.lit("new").alias("cabinet_type"), F.lit(None).cast("long").alias("year"))
    return upsert.append_if_new(every.where(F.abs("game_id") % 2 == 0), new, ["location_id", "game_id"])


@query("SELECT game_id, CASE WHEN abs(game_id) % 2 = 0 THEN 'New ' || name ELSE name END AS name, coalesce(CASE WHEN abs(game_id) % 4 <> 1 THEN manufacturer END, CASE WHEN abs(game_id) % 2 = 0 THEN 'none' END) AS manufacturer FROM games")
def mixed_update(p: Places) -> DataFrame:
    k = F.abs("game_id")
    old = p.games.withColumn("manufacturer", F.when(k % 4 != 1, F.col("manufacturer")))
    new = p.games.where(k % 2 == 0).select("game_id", F.concat(F.lit("New "), F.col("name")).alias("name"), F.lit("none").alias("manufacturer"))
    return upsert.upsert(old, new, ["game_id"], {"name": "new"})


@query(
    """, ends AS (SELECT alias_game_id AS game_id, canonical_game_id FROM canonical_links)
    SELECT CASE WHEN game_id > 0 THEN 'native' WHEN game_id = 0 THEN 'owner_roster' WHEN game_id >= -1999999999 THEN 'source_a' ELSE 'source_b' END AS source,
        CAST(CASE WHEN game_id >= 0 THEN game_id WHEN game_id >= -1999999999 THEN -game_id - 1000000000 ELSE -game_id - 2000000000 END AS VARCHAR) AS source_game_id,
        coalesce(canonical_game_id, game_id) AS game_id, name AS source_name, game_id AS legacy_game_id FROM games LEFT JOIN ends USING (game_id)"""
)
def source_records(p: Places) -> DataFrame:
    spark = p.games.sparkSession
    none = spark.createDataFrame([], "source string, source_game_id string, game_id long, source_name string, source_manufacturer string, first_seen_at timestamp, last_seen_at timestamp, legacy_game_id long")
    return upsert.backfill_source_records(none, p.games, p.canonical_links, AT).select("source", "source_game_id", "game_id", "source_name", "legacy_game_id")


@query(
    """, made AS (SELECT alias_game_id, canonical_game_id, CASE WHEN abs(alias_game_id) % 2 = 0 THEN 'manual' ELSE 'auto' END AS source FROM canonical_links),
    proposed AS (SELECT alias_game_id, alias_game_id + 1 AS canonical_game_id FROM canonical_links WHERE abs(alias_game_id) % 3 = 0)
    SELECT alias_game_id, CASE WHEN p.alias_game_id IS NOT NULL AND m.source = 'auto' THEN p.canonical_game_id ELSE m.canonical_game_id END AS canonical_game_id, m.source FROM made m LEFT JOIN proposed p USING (alias_game_id)"""
)
def applied_links(p: Places) -> DataFrame:
    k = F.abs("alias_game_id")
    made = p.canonical_links.withColumn("source", F.when(k % 2 == 0, "manual").otherwise("auto"))
    proposed = p.canonical_links.where(k % 3 == 0).select("alias_game_id", (F.col("alias_game_id") + 1).alias("canonical_game_id"), "confidence", "reason")
    return upsert.apply_links(made, proposed).select("alias_game_id", "canonical_game_id", "source")


@query("SELECT alias_game_id, canonical_game_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY alias_game_id ORDER BY confidence DESC, CASE WHEN canonical_game_id > 0 THEN 0 WHEN canonical_game_id >= -1999999999 THEN 1 ELSE 2 END, canonical_game_id) AS rn FROM (SELECT game_id AS alias_game_id, location_id AS canonical_game_id, CAST(abs(location_id) % 3 AS DOUBLE) AS confidence FROM location_games)) WHERE rn = 1")
def best_links(p: Places) -> DataFrame:
    rows = p.location_games.select(F.col("game_id").alias("alias_game_id"), F.col("location_id").alias("canonical_game_id"), (F.abs("location_id") % 3).cast("double").alias("confidence"))
    return matching.best_per(rows, "alias_game_id", F.desc("confidence"), identity.source_rank(F.col("canonical_game_id")), F.col("canonical_game_id"))


@query("SELECT location_id, CASE WHEN abs(location_id) % 3 = 0 THEN 'new' ELSE status END AS status FROM statuses UNION ALL SELECT location_id, 'new' FROM locations WHERE abs(location_id) % 3 = 0 AND location_id NOT IN (SELECT location_id FROM statuses)")
def rebuilt_table(p: Places) -> DataFrame:
    new = p.locations.where(F.abs("location_id") % 3 == 0).select("location_id", F.lit("new").alias("status"))
    return curation.replace_from(p.statuses, new, ("location_id",)).select("location_id", "status")


@query("SELECT location_id, 'matched' AS status, name AS matched_name, CAST(1 AS DOUBLE) AS confidence FROM locations")
def geocoder_checks(p: Places) -> DataFrame:
    item = F.to_json(F.struct(F.col("name"), F.col("street_address").alias("display_name"), F.col("latitude").cast("string").alias("lat"), F.col("longitude").cast("string").alias("lon")))
    answers = p.locations.select("location_id", "name", F.col("street_address").alias("address"), "latitude", "longitude", F.explode(F.array(F.lit("name_address"), F.lit("reverse"))).alias("match_kind"), item.alias("item"))
    return evidence.geocoder_status(evidence.geocoder_candidates(answers)).select("location_id", "status", "matched_name", "confidence")


@query(
    """, snap AS (SELECT location_id, count(*) AS n FROM (SELECT lg.location_id, lg.game_id, lg.cabinet_type, lg.year FROM location_games lg JOIN active USING (location_id)) GROUP BY 1)
    SELECT location_id, n AS games FROM snap WHERE location_id IN (SELECT location_id FROM active ORDER BY location_id LIMIT 5)"""
)
def games_for_stops(p: Places) -> DataFrame:
    from placekeep.plans import cli

    stops = cli.places(p).orderBy("location_id").limit(5)
    return snapshot.games_at(snapshot.location_games(p), stops).select("location_id", F.size("games").cast("long").alias("games"))


# Tables in buckets, and joins of many points and routes


@query(
    """, changes AS (SELECT verification_id, 'again' AS status, CASE WHEN verification_id % 2 = 0 THEN CAST(0.25 AS DOUBLE) END AS confidence
        FROM verifications WHERE verification_id // 100 % 50 = 7
        UNION ALL SELECT verification_id + 1000000000, 'new', CAST(0.5 AS DOUBLE) FROM verifications WHERE verification_id % 500 = 1)
    SELECT coalesce(v.verification_id, c.verification_id) AS verification_id, coalesce(v.location_id, 0) AS location_id, CASE WHEN c.verification_id IS NULL THEN v.status ELSE c.status END AS status,
        coalesce(c.confidence, v.confidence) AS confidence
    FROM verifications v FULL OUTER JOIN changes c ON v.verification_id = c.verification_id"""
)
def bucketed_upsert(p: Places) -> DataFrame:
    import uuid

    spark = p.locations.sparkSession
    store = buckets.BucketStore(spark, f"{shared_folder(spark)}/buckets-{uuid.uuid4().hex}")
    store.commit(store.create("log", p.verifications.select("verification_id", "location_id", "status", "confidence"), ["verification_id"]))
    k = F.col("verification_id")
    again = p.verifications.where(F.floor(k / 100) % 50 == 7).select("verification_id", "location_id", F.lit("again").alias("status"), F.when(k % 2 == 0, 0.25).alias("confidence"))
    new = p.verifications.where(k % 500 == 1).select((k + 1_000_000_000).alias("verification_id"), F.lit(0).cast("long").alias("location_id"), F.lit("new").alias("status"), F.lit(0.5).alias("confidence"))
    buckets.upsert_into(store, "log", again.unionByName(new), {"status": "new"}, "prefer_new")
    return store.read("log")


_ASKED = """SELECT location_id AS question_id, CASE abs(location_id) % 4 WHEN 0 THEN name WHEN 1 THEN substr(name, 2) WHEN 2 THEN left(name, length(name) - 1) ELSE left(name, 4) || substr(name, 6) END AS question,
        abs(location_id) % 4 AS kind FROM locations"""


@query(
    f""", asked AS ({_ASKED})
    SELECT question_id, l.location_id, CASE kind WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 3 THEN 2.0 * length(question) / (length(question) + length(l.name)) ELSE CAST(0.95 AS DOUBLE) END AS score
    FROM asked JOIN locations l ON CASE kind WHEN 3 THEN question_id = l.location_id ELSE contains(l.name, question) END"""
)
def indexed_search(p: Places) -> DataFrame:
    """The best places (all that tie) for the names of all places: as they are, or without their first, last or fifth letter; places whose text holds the question come first."""
    import uuid

    spark = p.locations.sparkSession
    name, kind = F.col("name"), F.abs("location_id") % 4
    less = F.when(kind == 0, name).when(kind == 1, F.expr("substr(name, 2)")).when(kind == 2, F.expr("left(name, length(name) - 1)")).otherwise(F.expr("concat(left(name, 4), substr(name, 6))"))
    rows = p.locations.select("location_id", "name", "city", "street_address")
    index = TextIndex.build(rows, ["location_id"], [name, F.concat_ws(" ", "name", "city", "street_address")], f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}")
    return index.search(p.locations.select(F.col("location_id").alias("question_id"), less.alias("question")), 1, 0.62, holding_first=True)


def _hav(lat: str, lon: str, lat2: str, lon2: str) -> str:
    from placekeep.catalogue import _hav_sql

    return _hav_sql(lat, lon, lat2, lon2)


def _customers(p: Places, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test binding: customers stand at places of their numbers."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("point_id"), (F.lit(25.0) + (k * 131 % 2400) / 100.0).alias("point_lat"), (F.lit(-124.0) + (k * 211 % 5700) / 100.0).alias("point_lon"))


_CUSTOMERS = """points AS (SELECT c_custkey AS point_id, CAST(25 AS DOUBLE) + (c_custkey * 131 % 2400) / CAST(100 AS DOUBLE) AS point_lat,
    CAST(-124 AS DOUBLE) + (c_custkey * 211 % 5700) / CAST(100 AS DOUBLE) AS point_lon FROM customer)"""


@table_query(
    bound(
        f""", {_CUSTOMERS}, d AS (SELECT point_id, location_id, name, game_count, {_hav("point_lat", "point_lon", "latitude", "longitude")} AS exact_miles FROM points, active),
        r AS (SELECT point_id, location_id, name, round(exact_miles, 2) AS miles, row_number() OVER (PARTITION BY point_id ORDER BY round(exact_miles, 2), game_count DESC, name, location_id) AS place
              FROM d WHERE exact_miles <= 120)
        SELECT point_id, location_id, name, miles, place::INTEGER AS place FROM r WHERE place <= 5"""
    )
)
def nearby_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placekeep.model import bind
    from placekeep.plans import cli

    p = bind(spark, sf_dir)
    return spatial.nearest_to_each(_customers(p, spark, sf_dir), cli.places(p).select("location_id", "name", "game_count", "latitude", "longitude"), 120.0, 5).select("point_id", "location_id", "name", "miles", "place")


_NATION_ROUTES = """pts AS (SELECT n_nationkey AS route_id, i AS seq, CAST(26 AS DOUBLE) + n_nationkey * CAST(0.5 AS DOUBLE) + i * CAST(0.1 AS DOUBLE) AS a, CAST(-123 AS DOUBLE) + i * CAST(1.25 AS DOUBLE) AS b
    FROM nation, range(40) r(i))"""


@table_query(
    bound(
        f""", {_NATION_ROUTES}, d AS (SELECT route_id, location_id, min({_hav("a", "b", "latitude", "longitude")}) AS m FROM pts, locations GROUP BY 1, 2)
        SELECT route_id, location_id, round(m, 4) AS route_miles FROM d WHERE m <= 45"""
    )
)
def places_along_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placekeep.model import bind

    routes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("route_id"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("seq"))
    routes = routes.withColumn("lat", F.lit(26.0) + F.col("route_id") * 0.5 + F.col("seq") * 0.1).withColumn("lon", F.lit(-123.0) + F.col("seq") * 1.25)
    return spatial.along_routes(routes, bind(spark, sf_dir).locations, 45.0).select("route_id", "location_id", F.round("route_miles", 4).alias("route_miles"))
