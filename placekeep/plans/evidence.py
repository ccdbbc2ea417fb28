"""Classification of captured evidence: place pages, geocoder answers, source answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placekeep.functions import similarity as S
from placekeep.functions import text as X
from placekeep.functions.geo import haversine
from placekeep.functions.similarity import search_score

#: Closure phrases.
PERMANENT = (r"(?i)\bpermanently\s+closed\b", r"(?i)\bclosed\s+permanently\b", r"(?i)\bclosed_permanently\b", r"(?i)\bpermanent(?:ly)?\s+closure\b")
TEMPORARY = (r"(?i)\btemporarily\s+closed\b", r"(?i)\bclosed\s+temporarily\b", r"(?i)\bclosed_temporarily\b")
CUES = ("directions", "website", "reviews", "call", "save")
#: Fixed value: sources updated from this day on count as fresh.
FRESH_FROM = "2025-01-01"


def one_space(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def plain_name(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "))


def name_score(expected: Column, actual: Column) -> Column:
    a, b = plain_name(expected), plain_name(actual)
    some = (a != "") & (b != "")
    wa, wb = F.array_distinct(X.words(a)), F.array_distinct(X.words(b))
    tokens = F.size(F.array_intersect(wa, wb)) / F.greatest(F.size(wa), F.size(wb), F.lit(1))
    return F.when(~some, 0.0).when(a == b, 1.0).otherwise(F.greatest(tokens, S.ratio_if(some & (a != b), a, b)))


def plain_ratio(expected: Column, actual: Column) -> Column:
    a, b = plain_name(expected), plain_name(actual)
    some = (a != "") & (b != "")
    return F.when(~some, 0.0).otherwise(S.ratio_if(some, a, b))


def current_text(x: Column) -> Column:
    """Text before the reviews."""
    return F.get(F.split(x, r"(?i)(?:^|\n)\s*(?:from the owner|updates? from|review summary|reviews)\b", 2), 0)


def phrase_count(x: Column, patterns: tuple[str, ...]) -> Column:
    total = F.lit(0)
    for p in patterns:
        total = total + F.regexp_count(x, F.lit(p))
    return total


def coordinates(x: Column) -> Column:
    """The first pair of numbers that lies in the country, in either order, as struct<latitude, longitude>."""
    pattern = r"(-?\d+\.\d{5,}),(-?\d+\.\d{5,})"
    firsts, seconds = (F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(pattern), F.lit(i)) for i in (1, 2))

    def pair(p: Column) -> Column:
        a, b = p["a"].cast("double"), p["b"].cast("double")
        straight = a.between(20, 50) & b.between(-130, -60)
        turned = a.between(-130, -60) & b.between(20, 50)
        both = lambda lat, lon: F.struct(lat.alias("latitude"), lon.alias("longitude"))
        return F.when(straight, both(a, b)).when(turned, both(b, a))

    return F.get(F.filter(F.transform(F.arrays_zip(firsts.alias("a"), seconds.alias("b")), pair), lambda p: p.isNotNull()), 0)


def place_metadata(df: DataFrame) -> DataFrame:
    """Adds place_id, cid, website, address, latitude and longitude found in page signals."""
    text = one_space(F.concat_ws(" ", "final_url", "primary_text", "title", "app_state"))
    some = lambda p: F.nullif(one_space(F.regexp_extract(text, p, 1)), F.lit(""))
    site = F.regexp_extract(F.coalesce("primary_text", F.lit("")), r"(?i)\bWebsite:\s*(https?://[^\s|]+|(?:[a-z0-9-]+\.)+[a-z]{2,}(?:/[^\s|]*)?)", 1)
    linked = F.get(F.filter(F.transform(F.filter("links", lambda v: F.regexp_like(v["label"], F.lit("(?i)^(website:|open website)"))), lambda v: X.public_website(v["href"])), lambda u: u.isNotNull()), 0)
    label = F.get(F.filter("aria_labels", lambda v: F.regexp_like(v, F.lit("(?i)^address:"))), 0)
    at = coordinates(F.concat_ws(" ", "final_url", "app_state"))
    return (
        df.withColumn("place_id", some(r"\b(ChIJ[A-Za-z0-9_-]+)\b"))
        .withColumn("cid", some("(?i)!1s(0x[0-9a-f]+:0x[0-9a-f]+)"))
        .withColumn("website", F.coalesce(linked, F.when(site != "", X.public_website(X.with_scheme(site)))))
        .withColumn("address", F.coalesce(one_space(F.regexp_replace(label, "^[^:]*:", "")), some(r"(?i)\bAddress:\s*([^|]+?)(?:\s+Copy address\b|\s+Located in:|\s+Open\b|\s+Closed\b|$)")))
        .withColumn("latitude", at["latitude"])
        .withColumn("longitude", at["longitude"])
    )


def classify_scans(df: DataFrame, engine_text: str = "maps") -> DataFrame:
    """Status, confidence and match kind of place-page signals.

    Columns: body_text, title, aria_labels, links (label, href), app_state,
    final_url, primary_name, primary_text and expected_name, expected_address,
    expected_city, expected_street_address, asked_place_id.
    """
    m = place_metadata(df)
    raw = F.when(F.coalesce("primary_text", F.lit("")) != "", F.col("primary_text")).otherwise(F.col("body_text"))
    m = m.withColumn("text", one_space(current_text(raw)))
    m = m.withColumn("name_score", name_score(F.col("expected_name"), F.col("primary_name"))).withColumn("address_score", plain_ratio(F.col("expected_address"), F.col("address")))
    vague = ~F.regexp_like(F.coalesce("expected_street_address", F.lit("")), F.lit(r"\d")) & F.col("expected_city").isNotNull() & F.col("address").isNotNull()
    there = ~vague | F.contains(plain_name(F.col("address")), plain_name(F.col("expected_city")))
    asked = F.coalesce("expected_name", F.lit("")) != ""
    same = ((F.col("name_score") >= 0.60) | ((F.col("name_score") >= 0.40) & (F.col("address_score") >= 0.75))) & there
    gone, paused = phrase_count(F.col("text"), PERMANENT), phrase_count(F.col("text"), TEMPORARY)
    cues = sum((F.contains(F.lower("text"), F.lit(c)).cast("int") for c in CUES), F.lit(0))
    shown = (asked & (F.coalesce("primary_name", F.lit("")) != "")) | (F.contains(F.lower("text"), F.lit(engine_text)) & (cues >= 2))
    unlike = asked & ~same
    status = F.when(unlike, "needs_review").when(gone > 0, "closed").when(paused > 0, "needs_review").when(shown, "matched").otherwise("needs_review")
    weak = F.least(F.lit(0.59), F.greatest(F.col("name_score"), F.col("address_score") * 0.5))
    confidence = F.when(unlike, weak).when(gone >= 2, 0.98).when(gone > 0, 0.95).when(paused > 0, 0.80).when(shown, 0.65).otherwise(0.20)
    kind = F.when(F.col("asked_place_id").isNotNull(), "place_id_url_v2").otherwise("search_url_v2")
    clear = lambda c: F.when(~unlike, F.col(c)).alias(c)
    kept = [c for c in df.columns if c not in ("text",)]
    return m.select(*kept, status.alias("status"), confidence.alias("confidence"), kind.alias("match_kind"), gone.alias("permanent"), paused.alias("temporary"), cues.alias("cues"), "name_score", "address_score", *[clear(c) for c in ("place_id", "cid", "website", "address", "latitude", "longitude")])


def geocoder_candidates(df: DataFrame) -> DataFrame:
    """Scores of geocoder answers.

    Columns: location_id, name, address (of the place), latitude, longitude,
    match_kind, item (JSON text of the answer).
    """
    j = lambda p: F.nullif(F.get_json_object("item", p), F.lit(""))
    named = F.coalesce(*[j(p) for p in ("$.namedetails.name", "$.name", "$.address.amenity", "$.address.shop", "$.address.leisure")], F.nullif(F.split_part(F.coalesce(j("$.display_name"), F.lit("")), F.lit(","), F.lit(1)), F.lit("")))
    d = df.withColumn("matched_name", named).withColumn("matched_address", j("$.display_name")).withColumn("distance_miles", haversine(F.col("latitude"), F.col("longitude"), j("$.lat").try_cast("double"), j("$.lon").try_cast("double")))
    d = d.withColumn("name_score", search_score(F.col("name"), F.coalesce("matched_name", F.lit("")))).withColumn("address_score", search_score(F.col("address"), F.coalesce("matched_address", F.lit(""))))
    near = F.when(F.col("distance_miles").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.least(F.col("distance_miles"), F.lit(5.0)) / 5.0))
    mix = lambda n, a, s: F.col("name_score") * n + F.col("address_score") * a + near * s
    return d.withColumn("confidence", F.round(F.when(F.col("match_kind") == "reverse", mix(0.45, 0.25, 0.30)).otherwise(mix(0.55, 0.30, 0.15)), 3))


def geocoder_status(df: DataFrame) -> DataFrame:
    """The best answer of each place and its status."""
    from placekeep.operators.matching import best_per

    best = best_per(df, "location_id", F.desc("confidence"), F.coalesce("distance_miles", F.lit(0.0)), F.when(F.col("match_kind") == "name_address", 0).otherwise(1), F.col("match_kind"))
    close = F.col("distance_miles").isNull() | (F.col("distance_miles") <= 0.25)
    status = F.when(F.col("matched_name").isNull() & F.col("matched_address").isNull(), "not_found").when((F.col("name_score") >= 0.72) & close, "matched").when(close & F.col("match_kind").isin("address", "reverse"), "possible_replaced").when(F.col("confidence") >= 0.55, "needs_review").otherwise("not_found")
    return best.withColumn("status", status)


def source_freshness(df: DataFrame) -> DataFrame:
    """Status and confidence of source answers: id, machine_count, date_last_updated, user_submissions_count, ic_active, failed."""
    count = F.coalesce("machine_count", F.lit(0))
    status = F.when(F.col("failed"), "source_error").when(F.col("id").isNull(), "source_not_found").when(count <= 0, "source_no_machines").otherwise("fresh_source")
    more = F.when(F.coalesce("date_last_updated", F.lit("")) >= FRESH_FROM, 0.1).otherwise(0.0) + F.when(F.coalesce("user_submissions_count", F.lit(0)) >= 5, 0.05).otherwise(0.0) + F.when(F.coalesce("ic_active", F.lit(False)), 0.03).otherwise(0.0)
    confidence = F.when(F.col("failed") | F.col("id").isNull(), 0.0).when(count <= 0, 0.65).otherwise(F.least(F.lit(0.99), F.lit(0.82) + more))
    return df.withColumn("status", status).withColumn("confidence", confidence)
