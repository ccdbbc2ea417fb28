"""Rows that the longer jobs start from: what to scan, to read, to link, to reconcile next."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placekeep.functions import predicates as P
from placekeep.functions import text as X
from placekeep.model import Places
from placekeep.operators import matching
from placekeep.plans import cli, rosters

#: States outside the continent.
OVERSEAS = ("AK", "HI")


def selected_states(state: str = "UT", states: str | None = None, continental: bool = False) -> list[str]:
    """Abbreviations of one state, of a comma list (in order, each once) or of all continental ones; ValueError for any other name."""
    if continental:
        return [s for s in X.STATES if s not in OVERSEAS]
    known = {a.lower(): a for a in X.STATES} | {n.lower(): a for a, n in X.STATES.items()} | X.STATE_SPELLINGS
    out: dict[str, None] = {}
    for name in (states or state).split(","):
        if name.strip().lower() not in known:
            raise ValueError(f"unknown state: {name.strip()}")
        out[known[name.strip().lower()]] = None
    return list(out)


def scan_candidates(p: Places, stale_before: str, least_games: int = 0, limit: int = 50) -> DataFrame:
    """Active places never seen or last seen before the time, longest ago first, then by games."""
    last = p.verifications.groupBy("location_id").agg(F.max(F.try_to_timestamp("checked_at")).alias("at"))
    stale = F.col("at").isNull() | (F.col("at") < F.lit(stale_before).cast("timestamp"))
    df = cli.places(p).join(last, "location_id", "left").where(stale & (F.col("game_count") >= least_games))
    return df.orderBy(F.col("at").asc_nulls_first(), F.desc("game_count"), "location_id").limit(limit).select("location_id", "name", "game_count")


def legacy_candidates(p: Places, statuses: Sequence[str] = ("closed", "matched"), path: str = "$.k") -> DataFrame:
    """Places whose latest evidence has one of the statuses, with a place id from the place or from the evidence."""
    last = cli.latest(p.verifications, "location_id", typed=True).where(F.col("status").isin(*statuses))
    place = F.coalesce("google_place_id", F.get_json_object("raw_json", path))
    return last.join(p.locations, "location_id").select("location_id", "name", place.alias("place_id"), "status", "match_kind")


def work_items(candidates: DataFrame, search: str, by_id: str) -> DataFrame:
    """(location_id, kind, query, url) of candidates (location_id, name, street_address, city, state, place_id).

    A known place id is asked for directly, else the place's text; ``search``
    and ``by_id`` are URL beginnings.
    """
    text = F.concat_ws(" ", *[F.nullif(F.trim(c), F.lit("")) for c in ("name", "street_address", "city", "state")])
    known = F.coalesce("place_id", F.lit("")) != ""
    url = F.when(known, F.concat(F.lit(by_id), F.url_encode("place_id"))).otherwise(F.concat(F.lit(search), F.url_encode(text)))
    return candidates.select("location_id", F.when(known, "place_id_url_v2").otherwise("search_url_v2").alias("kind"), text.alias("query"), url.alias("url"))


def roster_candidates(p: Places, least_games: int = 50, limit: int = 25, need_website: bool = True) -> DataFrame:
    """Active places with many listed items, most first, then by name."""
    counts = p.location_games.groupBy("location_id").agg(F.countDistinct("game_id").alias("listed")).where(F.col("listed") >= least_games)
    df = cli.places(p).where((F.coalesce("website_url", F.lit("")) != "") | F.lit(not need_website)).join(counts, "location_id")
    return df.orderBy(F.desc("listed"), cli.nulls_last("name"), "location_id").limit(limit).select("location_id", "name", "state", "game_count", "website_url", "listed")


def roster_names(p: Places) -> DataFrame:
    """Distinct item names of each active place."""
    at = cli.places(p).select("location_id")
    return p.location_games.join(at, "location_id").join(p.games, "game_id").select("location_id", "name").distinct()


def check_list(p: Places, states: Sequence[str], least_games: int = 0, limit: int = 50) -> DataFrame:
    """Places of some states that aren't known to be gone, those with most games first."""
    gone = p.statuses.where(F.col("status").isin(*P.GONE)).select("location_id")
    some = p.locations.where(F.col("state").isin(list(states)) & (F.col("game_count") >= least_games))
    return some.join(gone, "location_id", "left_anti").orderBy(F.desc("game_count"), "location_id").limit(limit).select("location_id", "name", "game_count")


def links_to_validate(p: Places, links: DataFrame, condition: Column | None = None) -> DataFrame:
    """Links of places that aren't gone, with the place's state, where the condition on state and game_count holds."""
    rows = links.join(p.locations.select("location_id", "state", "game_count"), "location_id").join(p.statuses.select("location_id", "status"), "location_id", "left")
    return rows.where(~P.is_gone(F.col("status")) & (F.lit(True) if condition is None else condition)).select("location_id", "source_id", "state")


def mode_of(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most common value of each key that isn't empty, the smallest of equally common ones."""
    counts = df.where(F.coalesce(value, F.lit("")) != "").groupBy(key, value).agg(F.count("*").alias("n"))
    return matching.best_per(counts, key, F.desc("n"), F.col(value))


def unfinished(df: DataFrame, done: Column) -> DataFrame:
    """Rows that a run which was broken off has still to do: those whose detail time is null."""
    return df.where(done.isNull())


def discover_links(p: Places, source: DataFrame | None = None, overrides: Mapping[int, int] | None = None) -> DataFrame:
    """(location_id, source_id, confidence, method): places with a source's page, by URL, by hand, or by likeness.

    ``source`` has the columns of matching.place_matches; ``overrides`` maps
    source ids to places and goes before likeness. Of one pair the last way
    counts. Only likeness from PLACE_ACCEPT on links.
    """
    found = X.id_in_url(F.col("source_url"))
    ways = p.locations.select("location_id", found.alias("source_id"), F.lit(1.0).alias("confidence"), F.lit("source_url").alias("method"), F.lit(0).alias("way")).where("source_id IS NOT NULL")
    if source is not None:
        pairs = [(k, v) for k, v in (overrides or {}).items()]
        by_hand = p.locations.sparkSession.createDataFrame(pairs, "source_id long, location_id long")
        manual = source.select("source_id").distinct().join(by_hand, "source_id").select("location_id", "source_id", F.lit(1.0).alias("confidence"), F.lit("manual_override").alias("method"), F.lit(1).alias("way"))
        matched = matching.place_matches(source.join(by_hand.select("source_id"), "source_id", "left_anti"), p.locations).where("band = 'match'")
        alike = matched.select("location_id", "source_id", F.round("confidence", 3).alias("confidence"), F.lit("csv_fuzzy_name_address").alias("method"), F.lit(1).alias("way"))
        ways = ways.unionByName(manual).unionByName(alike)
    last = ways.groupBy("location_id", "source_id").agg(F.max_by(F.struct("confidence", "method"), F.struct("way", "method")).alias("w"))
    return last.select("location_id", "source_id", "w.confidence", "w.method")


def is_internal(home: Column, url: Column) -> Column:
    """Whether ``url`` is on the site of ``home``."""
    return F.coalesce(X.host(home) == X.host(url), F.lit(False))


def is_trusted(url: Column, hosts: Sequence[str]) -> Column:
    """Whether the URL's host is one of ``hosts`` or below it."""
    h = X.host(url)
    out = F.lit(False)
    for known in hosts:
        out = out | (h == known) | F.endswith(h, F.lit("." + known))
    return F.coalesce(out, F.lit(False))


def pages_to_read(probes: DataFrame, trusted: Sequence[str], known: DataFrame | None = None, read: DataFrame | None = None, limit: int = 3, key: str = "location_id") -> DataFrame:
    """(key, turn, text, url, score): the next roster pages of each place, in order, at most ``limit``.

    ``probes`` has (key, home, rank, text, url, score), the scored links of a
    read homepage. ``known`` links (key, rank, text, url, score) come first and
    wherever they lead; scored ones must be internal or trusted, and are left
    out for places where ``read`` (key, names) shows that a known link already
    gave names. The homepage and repeated URLs are skipped.
    """
    at = lambda u: F.regexp_replace(u, "/+$", "")
    follow = is_internal(F.col("home"), F.col("url")) | is_trusted(F.col("url"), trusted)
    ways = probes.where(follow).select(key, F.lit(1).alias("way"), "rank", "text", "url", "score")
    if read is not None:
        ways = ways.join(read.where("names > 0").select(key).distinct(), key, "left_anti")
    if known is not None:
        ways = known.join(probes.select(key).distinct(), key, "left_semi").select(key, F.lit(0).alias("way"), "rank", "text", "url", "score").unionByName(ways)
    homes = probes.select(key, at(F.col("home")).alias("page")).distinct()
    first = ways.groupBy(key, at(F.col("url")).alias("page")).agg(F.min(F.struct("way", "rank", "text", "url", "score")).alias("w")).join(homes, [key, "page"], "left_anti")
    # Places have a few links each; the turn is the place in their sorted list.
    listed = first.groupBy(key).agg(F.slice(F.array_sort(F.collect_list("w")), 1, limit).alias("ws"))
    return listed.select(key, F.posexplode("ws").alias("turn", "w")).select(key, "turn", "w.text", "w.url", "w.score")


def manifest_rows(places: DataFrame, pages: DataFrame, compared: DataFrame, key: str = "location_id") -> DataFrame:
    """One row per place: counts of its pages and of the comparison, the page with most names, and whether it is a roster.

    ``pages`` has (key, ok, url, title, names, roster_score), ``compared`` the
    buckets of rosters.compare_rosters. A place without a read page keeps its
    game_count as the number of known names.
    """
    best = F.max_by(F.struct("url", "title"), F.struct("names", "roster_score", "url"))
    ok = pages.where("ok").groupBy(key).agg(F.count("*").alias("roster_page_count"), F.sum("names").alias("extracted_name_count"), best.alias("b"))
    df = places.join(ok, key, "left").join(rosters.manifest(compared, key), key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return df.select(
        *places.columns, zero("roster_page_count"), zero("extracted_name_count"), zero("matched"), F.coalesce("known", "game_count").alias("known"), F.coalesce("match_ratio", F.lit(0.0)).alias("match_ratio"), zero("website_only"),
        (F.coalesce("likely_manifest", F.lit(False)) & F.col("roster_page_count").isNotNull()).alias("likely_manifest"), F.coalesce("b.url", F.lit("")).alias("best_roster_url"), F.coalesce("b.title", F.lit("")).alias("best_roster_title"),
    )


def select_manifest(manifest: DataFrame, limit: int = 0, location_id: int | None = None) -> DataFrame:
    """Likely rosters, those with most matched names first, then by games; all of them for a limit of 0 or less."""
    likely = manifest.where("likely_manifest")
    if location_id is not None:
        likely = likely.where(F.col("location_id") == location_id)
    ordered = likely.orderBy(F.desc("matched"), F.desc("game_count"), "location_id")
    return ordered if limit <= 0 else ordered.limit(limit)


def reconciliation_lists(compared: DataFrame, pairs: DataFrame, most: int = 50, key: str = "location_id") -> DataFrame:
    """Names to add, to remove and to rename, and those ignored as noise, of each place; ``most`` of each in order of name."""
    noise = X.is_noise(F.col("name"))
    web, missing = F.col("bucket") == "website_only", F.col("bucket") == "missing"
    sides = pairs.select(key, F.col("website_name").alias("name"), F.lit("website_only").alias("bucket")).unionByName(pairs.select(key, F.col("db_name").alias("name"), F.lit("missing").alias("bucket")))
    tagged = compared.join(sides.withColumn("_paired", F.lit(True)), [key, "name", "bucket"], "left")
    free = F.col("_paired").isNull()
    names = lambda c: F.slice(F.array_sort(F.collect_set(F.when(c, F.col("name")))), 1, most)
    lists = tagged.groupBy(key).agg(names(web & ~noise & free).alias("add_candidates"), names(missing & free).alias("remove_candidates"), names(web & noise).alias("ignored_names"), names(F.col("bucket") == "matched").alias("matched_sample"))
    renames = pairs.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("website_name", "db_name", "similarity"))), 1, most).alias("renames"))
    return lists.join(renames, key, "left")


def review_queue(candidates: DataFrame, members: DataFrame, limit: int = 25) -> DataFrame:
    """Pending candidates (candidate_id, status, priority_score, ...) by priority, each with its members as an array of structs."""
    pending = candidates.where(F.coalesce("status", F.lit("pending")) == "pending").orderBy(F.desc("priority_score"), "candidate_id").limit(limit)
    rest = [c for c in members.columns if c != "candidate_id"]
    nested = members.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("records"))
    return pending.join(nested, "candidate_id", "left").orderBy(F.desc("priority_score"), "candidate_id")


def place_url(website: Column, place_id: Column, name: Column, city: Column, by_id: str, search: str) -> Column:
    """The place's site, else its page by place id, else a search for it."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    found = F.concat(F.lit(search), F.url_encode(F.concat_ws(" ", name, city)))
    return F.when(some(website), X.with_scheme(website)).when(some(place_id), F.concat(F.lit(by_id), F.url_encode(place_id))).otherwise(found)


def top_labels(df: DataFrame, label: str, metric: str, limit: int = 10) -> DataFrame:
    """Greatest metrics first; ties in the order of a reader of the language, without regard to case and accents."""
    return df.orderBy(F.desc(metric), F.collate(F.col(label), "UNICODE_CI_AI"), label).limit(limit)
