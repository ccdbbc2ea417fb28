"""Identity, matching, mutations, sources, pipelines, streaming and the command line on small rows."""

import hashlib
import json
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from placekeep import __main__ as command
from placekeep import model
from placekeep.operators import buckets, identity, matching, upsert
from placekeep.plans import cli, pipelines, render, rosters, snapshot
from placekeep.sources import catalogues, pages
from placekeep.streaming import evidence as stream

ROOT = Path(__file__).resolve().parent.parent


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) if names else tuple(r)) for r in df.collect())


@pytest.fixture
def small(spark):
    """An open, a closed and a foreign place; one item under two ids; a place with two links of one source."""
    make = spark.createDataFrame
    places = [(1, "Alpha", "Bar", "Ogden", "UT", "1 A St", "84401", "a.example", "p1", None, 40.0, -111.0, "u1", 2), (2, "Beta", "Hall", "Ogden", "UT", "2 B St", "84401", None, None, None, 40.1, -111.1, "u2", 1), (3, "Gamma", None, None, "ON", None, None, None, None, None, None, None, "u3", 1), (-1_000_000_004, "Delta", "Bar", "Provo", "UT", None, None, "d.example", None, None, 40.2, -111.2, "u4", None)]
    locations = make(places, "location_id long, name string, type string, city string, state string, street_address string, postal_code string, website_url string, google_place_id string, google_cid string, latitude double, longitude double, source_url string, game_count long")
    games = make([(10, "Galaga", "Midway"), (-2_000_000_010, "Galaga", None), (11, "Funhouse", "Williams")], "game_id long, name string, manufacturer string")
    placed = make([(1, 10, "Video", 1981), (-1_000_000_004, -2_000_000_010, "Video", None), (2, 11, "Pinball", 1990), (3, 10, None, None), (1, 11, "Pinball", 1990)], "location_id long, game_id long, cabinet_type string, year long")
    statuses = make([(2, "closed", None, 0.9, "2024-01-01", "hand", None)], "location_id long, status string, replacement_name string, confidence double, verified_at string, evidence string, notes string")
    checks = make([(1, 1, "2024-01-01T00:00:00", "maps", "matched", "x", 0.5, None), (None, 1, "2024-01-01T00:00:00", "maps", "closed", "x", 0.6, None), (3, 2, "bad", "osm", "closed", "x", 0.7, '{"k":1}')], "verification_id long, location_id long, checked_at string, provider string, status string, match_kind string, confidence double, raw_json string")
    links = make([(-2_000_000_010, 10, 1.0, "exact", "auto")], "alias_game_id long, canonical_game_id long, confidence double, reason string, source string")
    a = make([(1, 100), (1, 101)], "location_id long, source_id long")
    b = make([(1, 5)], "location_id long, source_id long")
    return model.Places(locations, games, placed, statuses, checks, links, a, b, ("UT",))


def test_aliases_collapse(small):
    assert rows(cli.rare_items(small, 1, 10), "game_id", "location_count") == [(11, 1)]
    found = cli.search_items(small, "galaga", "UT", 10).collect()
    assert [(r.game_id, r.source_game_rows, r.location_count, r.state_location_count) for r in found] == [(10, 2, 2, 2)]
    assert rows(cli.where_to_find(small, "galaga", "UT", 10), "location_id") == [(-1_000_000_004,), (1,)]


def test_scope_and_missing_status_table(small):
    assert rows(cli.places(small), "location_id") == [(-1_000_000_004,), (1,)]
    bare = small.without("statuses", "canonical_links")
    assert rows(cli.places(bare), "location_id") == [(-1_000_000_004,), (1,), (2,)]
    assert "status" not in cli.nearby(bare, 40.0, -111.0, 50, 5).columns and "status" in cli.nearby(small, 40.0, -111.0, 50, 5).columns
    assert {r.metric for r in cli.summary(bare, "UT").collect()}.isdisjoint({"canonical_links"})
    assert rows(cli.inactive_places(small, 5), "location_id") == [(2,)]


def test_fan_out_is_kept_unless_asked(small):
    got = {r.state: r.listed_game_count for r in cli.source_coverage(small, 10).collect()}
    once = {r.state: r.listed_game_count for r in cli.source_coverage(small, 10, dedupe_links=True).collect()}
    assert (got["UT"], once["UT"]) == (5, 3)
    assert rows(snapshot.route_locations(small).where("location_id = 1"), "game_count", "source_tags") == [(4, "source A source B")]
    assert rows(snapshot.route_locations(small, dedupe_links=True).where("location_id = 1"), "game_count") == [(2,)]


def test_best_place_steps_back_for_a_gone_one(small):
    assert rows(cli.best_place(small, "Alpha"), "location_id") == [(1,)]
    assert cli.best_place(small, "Beta").collect() == []
    assert rows(cli.best_place(small, "Beta", include_inactive=True), "location_id") == [(2,)]
    assert rows(cli.inventory(small, "Alpha", 10), "game") == [("Funhouse",), ("Galaga",)]


def test_latest_check_breaks_ties(small):
    assert rows(cli.latest(small.verifications, "location_id"), "location_id", "verification_id") == [(1, 1), (2, 3)]
    assert [r.last_checked_at for r in cli.needing_verification(small, small.locations, "2025").where("location_id = 3").collect()] == [None]


def test_only_reading_statements(spark):
    spark.range(3).write.mode("overwrite").saveAsTable("guarded")
    writing = """DROP TABLE guarded
        SELECT 1; SELECT 2
          insert into guarded values (1)
        WITH x AS (SELECT 2 AS id) INSERT INTO guarded SELECT id FROM x
        WITH x AS (SELECT 2 AS id) INSERT OVERWRITE TABLE guarded SELECT id FROM x
        WITH x AS (SELECT 2 AS id) FROM x INSERT OVERWRITE TABLE guarded SELECT id
        WITH x AS (SELECT 2 AS id) FROM x INSERT INTO guarded SELECT id INSERT INTO guarded SELECT id + 1
        FROM guarded INSERT INTO guarded SELECT id
        CREATE TABLE other AS SELECT 1
        CREATE TEMPORARY VIEW v AS SELECT 1
        CACHE TABLE guarded
        SET spark.sql.shuffle.partitions = 3
        TRUNCATE TABLE guarded
        SELECT * FROM guarded; DROP TABLE guarded
        selec 1""".splitlines()
    for bad in writing:
        with pytest.raises(ValueError):
            cli.raw_sql(spark, bad)
        assert sorted(r.id for r in spark.table("guarded").collect()) == [0, 1, 2], bad
    assert cli.raw_sql(spark, "SELECT 1 AS a;", 5).collect()[0].a == 1
    assert cli.raw_sql(spark, "SELECT 'x; y' AS a").collect()[0].a == "x; y"
    assert cli.raw_sql(spark, "WITH x AS (SELECT id FROM guarded) SELECT max(id) AS m FROM x WHERE id IN (SELECT id FROM guarded)").collect()[0].m == 2
    spark.sql("DROP TABLE guarded")


def test_chains_and_cycles(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(50, 50)], "alias_game_id long, canonical_game_id long")
    assert rows(identity.transitive(chain)) == [(i, 12) for i in range(1, 12)]
    with pytest.raises(ValueError):
        identity.transitive(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "alias_game_id long, canonical_game_id long"))
    assert identity.transitive(chain.where("alias_game_id < 0")).collect() == []


def test_ids_are_consecutive(spark):
    new = spark.createDataFrame([(f"n{i}",) for i in range(300)], "name string")
    got = rows(identity.allocate_ids(new, ["name"], spark.createDataFrame([(10_000_005,)], "game_id long")), "game_id")
    assert got == [(10_000_006 + i,) for i in range(300)]


@pytest.mark.parametrize("seed", range(3))
def test_one_to_one_is_greedy(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(15), rng.randrange(15), rng.randrange(6) / 5) for _ in range(90)})
    pairs = list({(a, b): (a, b, s) for a, b, s in pairs}.values())
    got = rows(matching.one_to_one(spark.createDataFrame(pairs, "l long, r long, s double"), "l", "r", F.desc("s"), F.col("l"), F.col("r")), "l", "r")
    want, left, right = [], set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in left and b not in right:
            want.append((a, b))
            left.add(a)
            right.add(b)
    assert got == sorted(want)
    assert matching.one_to_one(spark.createDataFrame([], "l long, r long, s double"), "l", "r", F.desc("s"), F.col("l"), F.col("r")).collect() == []


def items(spark, *given):
    return spark.createDataFrame([(i, n, m, 1, 1) for i, n, m in given], "game_id long, name string, manufacturer string, location_count long, active_location_count long")


def test_title_clusters(spark):
    df = items(spark, (5, "The Addams Family", "Bally"), (-1_000_000_001, "Addams Family", None), (7, "Batman", "Sega"), (8, "Batman", "Stern"), (9, "abc", "X"), (10, "abc", "X"), (20, "Hook", "Data East"), (21, "HOOK", "Data East"))
    assert rows(matching.exact_title_links(df), "alias_game_id", "canonical_game_id") == [(-1_000_000_001, 5), (21, 20)]


def test_spelling(spark):
    df = items(spark, (1, "Centipede Deluxe", ""), (2, "Centipede Delux", ""), (3, "Galaga 88", ""), (4, "Galaga 89", ""), (5, "Terminator Pro", ""), (6, "Terminator Premium", ""))
    links, review = matching.spelling_links(df)
    assert links.collect() == []
    assert {tuple(sorted((r.left_game_id, r.right_game_id))) for r in review.collect()} == {(1, 2), (5, 6)}


def test_place_bands(spark):
    cols = "name string, street_address string, city string, state string, postal_code string"
    source = spark.createDataFrame([(1, "Joe's Arcade", "10 Main St", "Ogden", "UT", "84401"), (2, "Joe's Arcade", "99 Far Rd", "Provo", "UT", "84601"), (3, "Nowhere", "5 X", "Reno", "NV", "89501"), (4, "Joes Arcade", "10 Main Street", "Ogden", None, "84401")], "source_id long, " + cols)
    known = spark.createDataFrame([(10, "Joe's Arcade", "10 Main Street", "Ogden", "ut", "84401")], "location_id long, " + cols)
    got = {r.source_id: (r.location_id, r.band) for r in matching.place_matches(source, known).collect()}
    assert got == {1: (10, "match"), 2: (None, "new"), 3: (None, "new"), 4: (10, "match")}


def test_upsert_policies(spark):
    old = spark.createDataFrame([(1, "a", None), (2, None, "y")], "k long, p string, q string")
    new = spark.createDataFrame([(1, "b", "x"), (2, None, None), (3, "c", None)], "k long, p string, q string")
    assert rows(upsert.upsert(old, new, ["k"], {}).fillna("-")) == [(1, "a", "x"), (2, "-", "y"), (3, "c", "-")]
    assert rows(upsert.upsert(old, new, ["k"], {"p": "new", "q": "prefer_new"}).fillna("-")) == [(1, "b", "x"), (2, "-", "y"), (3, "c", "-")]
    twice = upsert.replace_rows(upsert.replace_rows(old, new, ["k"]), new, ["k"])
    assert rows(twice.fillna("-")) == rows(new.fillna("-"))
    assert rows(upsert.append_if_new(old, new, ["k"]), "k") == [(1,), (2,), (3,)]


def test_status_policies(small, spark):
    fresh = spark.createDataFrame([(1, 0.9, "t", "n"), (2, 0.9, "t", "n")], "location_id long, confidence double, checked_at string, notes string")
    assert rows(upsert.apply_source_status(small.statuses, fresh, "a"), "location_id", "status") == [(1, "matched"), (2, "closed")]
    scans = spark.createDataFrame([(1, "closed", 0.9, "t", "n"), (2, "matched", 0.9, "t", "n"), (3, "odd", 0.1, "t", "n")], "location_id long, status string, confidence double, checked_at string, notes string")
    assert rows(upsert.apply_scan_status(small.statuses, scans, "maps"), "location_id", "status", "evidence") == [(1, "closed", "maps"), (2, "closed", "hand")]
    assert rows(upsert.apply_geocoder_status(small.statuses, scans.where("location_id > 0"), "osm"), "location_id") == [(2,)]


def test_evidence_ids_follow_on(small):
    log = upsert.append_evidence(small.verifications, small.verifications.drop("verification_id"), ["location_id", "checked_at", "provider", "status"])
    assert sorted(r.verification_id for r in log.collect() if r.verification_id) == [1, 3, 4, 5, 6]


def test_source_records(spark):
    make = lambda *r: spark.createDataFrame(r, "source string, source_game_id string, game_id long, source_name string, source_manufacturer string, first_seen_at string, last_seen_at string, legacy_game_id long")
    old = make(("a", "1", 10, "Old", "M", "1", "1", None))
    assert rows(upsert.attach_source_records(old, make(("a", "1", 10, None, "N", "2", "2", 7), ("b", "1", 11, "New", None, "2", "2", None))), "source", "source_name", "first_seen_at", "last_seen_at") == [("a", "Old", "1", "2"), ("b", "New", "2", "2")]
    with pytest.raises(ValueError):
        upsert.attach_source_records(old, make(("a", "1", 12, None, None, "2", "2", None)))


def test_repair_preview_counts_what_repair_does(spark):
    cols = "location_id long, name string, website_url string, street_address string, latitude double, longitude double, google_place_id string, google_cid string"
    base = spark.createDataFrame([(1, "A", "http://a", "s", 1.0, 2.0, None, None), (2, "B (closed)", None, "t", 1.0, 2.0, None, None)], cols)
    now = spark.createDataFrame([(1, "A", "https://maps.m.en/x", "s", 1.0, 2.0, "p", None), (2, "B (closed)", None, "t", 1.0, 2.0, None, None)], cols)
    statuses = spark.createDataFrame([(1, "closed", None, 0.9, "t", "maps", None), (2, "closed", None, 0.9, "t", "maps", None)], "location_id long, status string, replacement_name string, confidence double, verified_at string, evidence string, notes string")
    plan = upsert.repair_plan(now, base, statuses, None, "maps")
    assert {r.metric: r.value for r in upsert.repair_preview(plan).collect()} == {"restored_locations": 1, "cleared_place_ids": 1, "cleared_bogus_websites": 1, "preserved_closures": 1, "demoted_closures": 1}
    locations, after = upsert.repair(now, statuses, plan, "now")
    assert rows(locations) == rows(base) and rows(after, "location_id", "status") == [(1, "needs_review"), (2, "closed")]
    again = upsert.repair_plan(locations, base, after, None, "maps")
    assert {r.value for r in upsert.repair_preview(again).where("metric <> 'preserved_closures'").collect()} == {0}


def test_snapshots_swap(spark, tmp_path):
    store = upsert.Snapshots(spark, str(tmp_path / "db"))
    assert store.current() == {}
    store.commit({"t": spark.range(3), "u": spark.range(1)})
    first = store.current()
    store.commit({"t": store.read("t").where("id > 0")})
    assert store.read("t").count() == 2 and store.read("u").count() == 1 and store.current()["u"] == first["u"] and store.current()["t"] != first["t"]


CSV = "Id,Name,Street,City,State,Zip,Phone,Lat,Lon,Website,Description,Date last updated,Machine count,Name [Location type],Id [Machines],Name [Machines],Manufacturer [Machines],Year [Machines],Machine type [Machines],Machine display [Machines],Ipdb [Machines],Opdb [Machines],Id [Location machine xrefs],Ic enabled [Location machine xrefs]\n"


def test_packed_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text(CSV + '7, Joe ,nil,Ogden,UT,84401,-,40.5,-111,,"two\nlines",2024,2,Pizza Parlor,"1, 2","A, B","Bally",1990,,,,,"11,12","true,nil"\n8,Kim,,,,,,x,,,,,3,,"1,2",A,,,,,,,,\n')
    raw = catalogues.read_packed_csv(spark, str(tmp_path / "x.csv"))
    got = catalogues.unpack(raw, strict=False)
    assert rows(got["locations"], "source_id", "name", "type", "latitude") == [(7, "Joe", "Restaurant", 40.5)]
    assert rows(got["machines"].fillna("-").fillna(0), "machine_id", "name", "manufacturer", "year") == [(1, "A", "Bally", 1990), (2, "B", "-", 0)]
    assert [(r.placement_id, r.ic_enabled) for r in got["placements"].orderBy("placement_id").collect()] == [(11, True), (12, None)]
    assert rows(got["rejects"], "Id") == [("8",)]
    with pytest.raises(Exception):
        catalogues.unpack(raw)["locations"].collect()


def test_nested_json(spark):
    def region(name, deleted):
        refs = [{"id": 1, "deleted_at": None, "ic_enabled": True, "machine": {"id": 5, "name": "M"}}, {"id": 2, "deleted_at": deleted, "machine": {"id": 6, "name": "N"}}]
        return json.dumps({"locations": [{"id": 1, "name": name, "country": "US", "location_machine_xrefs": refs}, {"id": 2, "name": "X", "country": "CA", "location_machine_xrefs": []}]})

    df = spark.createDataFrame([(0, region("old", None)), (1, region("new", "2024"))], "position int, body string")
    got = catalogues.region_bundle(df)
    assert rows(got["locations"], "source_id", "name") == [(1, "new")] and rows(got["placements"], "placement_id") == [(1,)]


def test_directory_json(spark):
    body = json.dumps({"arcades": [{"id": "4", "name": " A ", "subregion": "utah", "machines": [{"id": "9", "condition": "5", "game": {"id": "3", "name": "G"}}, {"id": "x", "game": {"id": "1"}}]}, {"id": "z", "subregion": "UT"}, {"id": "5", "subregion": "Ontario"}]})
    entries = catalogues.directory_entries(spark.createDataFrame([(body,)], "body string"))
    assert rows(entries, "source_id", "name", "state") == [(4, "A", "UT")]
    assert rows(catalogues.directory_machines(entries), "machine_id", "source_game_id", "condition") == [(9, 3, 5)]


def test_jsonl(spark, tmp_path, small):
    df = small.statuses.select("location_id", "status", "notes")
    assert json.loads(catalogues.to_jsonl(df).first().value) == {"location_id": 2, "notes": None, "status": "closed"}
    catalogues.write_jsonl(df, str(tmp_path / "s"))
    assert rows(catalogues.read_jsonl(spark, str(tmp_path / "s"), model.SCHEMAS["location_statuses"]), "location_id", "status") == [(2, "closed")]


def test_cache_age(tmp_path):
    p = tmp_path / "f"
    assert not catalogues.is_fresh(str(p), 5)
    p.write_text("x")
    assert catalogues.is_fresh(str(p), 1) and not catalogues.is_fresh(str(p), 1, now=p.stat().st_mtime + 4000) and catalogues.is_fresh(str(p), 0) and not catalogues.is_fresh(str(p), 0, never_expires=False)


TABLE = """<table id="other"><tr><td>no</td></tr></table><table id="tbl"><tr><th>#</th></tr>
<tr><td>1</td><td><a href="l.aspx?id=42">Joe &amp; Co</a></td><td>1,234 games</td><td>Bar</td><td>Ogden</td><td>UT</td><td>Yes</td><td><a href="http://j.example">site</a><table><tr><td>x</td></tr></table></td></tr></table>
<select id="kinds"><option value="">-</option><option value="3">Bar</option></select><input name="__STATE" value="a&amp;b"><span id="w"><a class=x href='http://w'>w</a></span>"""


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "http://h/", TABLE), (2, "http://h/", None)], "location_id long, url string, html string")
    assert rows(pages.index_rows(df, "tbl"), "location_id", "name", "game_count", "is_public", "website_url") == [(42, "Joe & Co", 1234, 1, "http://j.example")]
    assert [r.options for r in pages.page_options(df, "kinds").orderBy("location_id").collect()] == [["3"], []]
    r = df.where("location_id = 1").select(pages.hidden_field(F.col("html"), "__STATE").alias("s"), pages.span_link(F.col("html"), "w").alias("w")).first()
    assert (r.s, r.w) == ("a&b", "http://w")
    page = '<title>My  list</title><script>x</script><p>1. Pac-Man (working)</p><p>Open 10 am</p><li>PAC MAN</li><p>12 Main St</p><a href="/games">Game list</a><a href="https://facebook.com/games">Games</a>'
    got = pages.page_summaries(spark.createDataFrame([(1, "http://h.example/a", page)], "page_id long, url string, html string"))
    assert got.first().page.title == "My list"
    assert rows(rosters.generic_names(got, "page_id"), "name") == [("Game list Games",), ("My list",), ("Pac-Man",)]
    assert rows(rosters.scored_links(got, "page_id"), "url", "score") == [("http://h.example/games", 5)]


def test_marked_lists(spark):
    text = "Intro\n3 games listed for this location\nGalaga\nSS, 1981\nMachine: Funhouse\nComments\nNot a game"
    df = spark.createDataFrame([(1, "https://www.list.example/x", text)], "page_id long, url string, t string").select("page_id", "url", F.struct(F.col("t").alias("text")).alias("page"))
    form = rosters.ListFormat("list.example", r"(?i)\b\d+\s+games\s+listed\b", r"(?i)^comments$", r"(?i)^(em|ss)\b", r"(?i)^Machine:\s*")
    assert rows(rosters.marked_names(df, "page_id", form), "place", "name") == [(1, "Galaga"), (2, "Funhouse")]


def test_rosters(spark):
    known = spark.createDataFrame([(1, "Galaga"), (1, "Funhouse"), (1, "Tron"), (2, "Galaga")], "location_id long, name string")
    listed = spark.createDataFrame([(1, "GALAGA"), (1, "Fun House"), (1, "Contact us"), (1, "Joust")], "location_id long, name string").withColumn("form", F.lower("name"))
    compared = rosters.compare_rosters(known, listed)
    assert rows(compared, "location_id", "name", "bucket") == [(1, "Contact us", "website_only"), (1, "Funhouse", "matched"), (1, "Galaga", "matched"), (1, "Joust", "website_only"), (1, "Tron", "missing")]
    r = rosters.reconciliation(compared, rosters.pair_names(compared)).first()
    assert (r.matched, r.known, r.add_candidates, r.remove_candidates, r.ignored, r.review_status) == (2, 3, 1, 1, 1, "partial_or_stale")


def test_names_resolve(spark):
    known = items(spark, (1, "Medieval Madness (Remake)", "CGC"), (2, "The Addams Family", "Bally"), (3, "Rapid Fire", "Bally"), (4, "Rapid Fire", "Other"))
    names = spark.createDataFrame([("Addams Family, The",), ("addamsfamily the",), ("Rapid Fire",), ("Zzz",), ("Addams",)], "name string")
    got = {r.listed_name: (r.game_id, round(r.score, 2)) for r in rosters.resolve_names(names, known).collect()}
    assert got["Addams Family, The"] == (2, 0.99)
    assert got["Rapid Fire"] == (3, 1.01) and "Zzz" not in got and got["Addams"] == (2, 0.95)


def test_machine_merge(small, spark):
    links = spark.createDataFrame([(1, 5), (-1_000_000_004, 6)], "location_id long, source_id long")
    machines = spark.createDataFrame([(5, 1, 70, "Fun House", "Pinball"), (5, 2, 71, "Funhouse", "Pinball"), (5, 3, 72, "Brand New Thing", "Video"), (6, 4, 73, "Brand New Thing", "Video"), (6, 5, 74, "Funhouse", "Pinball")], "source_id long, machine_id long, source_game_id long, name string, genre string")
    got = {r.machine_id: (r.game_id, r.method) for r in pipelines.merge_machines(links, machines, small.location_games, small.games).collect()}
    assert got[2] == (11, "duplicate_local_inventory") and got[5] == (11, "matched_existing_game") and got[4][1] == "source_only_game" and got[3][1] == "matched_existing_game" and got[3][0] == got[4][0] == -2_000_000_073
    after = pipelines.apply_machines(small, pipelines.merge_machines(links, machines, small.location_games, small.games), "now")
    assert rows(after["games"].where("game_id = -2000000073"), "name") == [("Brand New Thing",)]
    assert {r.location_id: r.game_count for r in after["locations"].collect()}[-1_000_000_004] == 3


def test_import_fills_only(small, spark):
    bundle = {
        "locations": spark.createDataFrame([(1, "Alpha", "1 A St", "Ogden", "UT", "84401", "555", None), (9, "Brand New", "9 Z", "Logan", "UT", "84301", None, "n.example")], "source_id long, name string, street_address string, city string, state string, postal_code string, phone string, website_url string"),
        "machines": spark.createDataFrame([(3, "Funhouse", "Williams", 1990), (4, "Unheard Of", "Nobody", 2001)], "machine_id long, name string, manufacturer string, year long"),
        "placements": spark.createDataFrame([(1, 1, 3), (2, 9, 4)], "placement_id long, source_id long, machine_id long"),
    }
    out = pipelines.import_bundle(small, bundle, spark.createDataFrame([], model.SCHEMAS["a_links"]), "now")
    assert rows(out["locations"].where("location_id IN (1, -1000000009)"), "location_id", "website_url") == [(-1_000_000_009, "n.example"), (1, "a.example")]
    assert rows(out["games"].where("game_id = -1000000004"), "name") == [("Unheard Of",)]
    assert rows(out["links"], "location_id", "source_id") == [(-1_000_000_009, 9), (1, 1)]
    assert out["location_games"].count() == small.location_games.count() + 1
    assert {r.metric: r.value for r in out["stats"].collect()} == {"locations_matched": 1, "locations_inserted": 1, "games_matched": 1, "games_inserted": 1, "placements_inserted": 1}


def test_import_prefers_native_rows(small, spark):
    """Only positive ids are candidates; ids given by hand go first; ids made before are used again; doubtful places are new unless asked."""
    from dataclasses import replace

    def more(df, like, **values):
        return df.unionByName(df.where(like).limit(1).withColumns({k: F.lit(v).cast(dict(df.dtypes)[k]) for k, v in values.items()}))

    games = more(more(small.games, "game_id = 11", game_id=-2_000_000_005, name="Medieval Madness"), "game_id = 11", game_id=7, name="Medieval Madnes")
    places = more(small.locations, "location_id = 1", location_id=-2_000_000_001)
    places = more(places, "location_id = 1", location_id=-1_000_000_077, name="Made Before", street_address="7 Far", city="Elsewhere", postal_code="1")
    p = replace(small, games=games, locations=places)
    cols = "source_id long, name string, street_address string, city string, state string, postal_code string"
    bundle = {
        "locations": spark.createDataFrame([(1, "Alpha", "1 A St", "Ogden", "UT", "84401"), (77, "Zzz Qqq", None, "Nowhere", "UT", None), (78, "By Hand", None, "Nowhere", "UT", None), (79, "Unknown Hand", None, "Nowhere", "UT", None)], cols),
        "machines": spark.createDataFrame([(3, "Medieval Madness", "Williams", 1990)], "machine_id long, name string, manufacturer string, year long"),
        "placements": spark.createDataFrame([(1, 1, 3)], "placement_id long, source_id long, machine_id long"),
    }
    by_hand = spark.createDataFrame([(78, 2), (79, 555_555)], "source_id long, location_id long")
    out = pipelines.import_bundle(p, bundle, spark.createDataFrame([], model.SCHEMAS["a_links"]), "now", overrides=by_hand)
    links = {r.source_id: (r.location_id, r.method) for r in out["links"].collect()}
    assert links[1] == (1, "fuzzy_name_address") and links[78] == (2, "manual_override") and links[77][0] == -1_000_000_077 and links[79][0] == -1_000_000_079
    assert out["location_games"].where("location_id = 1 AND game_id = 7").count() == 1
    stats = {r.metric: r.value for r in out["stats"].collect()}
    assert stats["locations_reused"] == 1 and stats["locations_matched"] == 2 and stats["locations_inserted"] == 1
    kept = pipelines.import_bundle(p, bundle, spark.createDataFrame([], model.SCHEMAS["a_links"]), "now", overrides=by_hand, insert_locations=False)
    assert {r.source_id for r in kept["links"].collect()} == {1, 77, 78}


def test_roster_apply(small, spark):
    actions = spark.createDataFrame([(1, "add", "Never Heard"), (1, "remove", "Funhouse"), (1, "add", "Galaga")], "location_id long, action string, name string")
    out = pipelines.apply_roster(small, actions, "now")
    assert rows(out["location_games"].where("location_id = 1"), "game_id") == [(-4_000_000_000,), (10,)] and rows(out["audit"], "action", "name") == [("add", "Galaga"), ("add", "Never Heard"), ("remove", "Funhouse")]


def test_manual_links_win(small):
    proposed = small.canonical_links.select("alias_game_id", F.lit(11).cast("long").alias("canonical_game_id"), "confidence", "reason")
    assert rows(upsert.apply_links(small.canonical_links, proposed), "canonical_game_id") == [(11,)]
    manual = small.canonical_links.withColumn("source", F.lit("manual"))
    assert rows(upsert.apply_links(manual, proposed), "canonical_game_id") == [(10,)]


def test_steps():
    steps = pipelines.plan_steps(("UT", "NV"), apply=True, skip=("validation",))
    assert {s.phase for s in steps} == {"source-sync", "curation", "maintenance", "build"} and steps[0].arguments == ("--states", "UT,NV", "--apply")


def test_stream_keeps_the_latest(spark, tmp_path):
    schema = "verification_id long, location_id long, provider string, confidence double, ts timestamp"
    log = str(tmp_path / "log")
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    add = lambda data: spark.createDataFrame(data, "verification_id long, location_id long, provider string, confidence double, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(log)
    add([(1, 7, "a", 0.5, day(1)), (2, 8, "a", 0.5, day(2)), (2, 8, "a", 0.5, day(2))])
    store = buckets.BucketStore(spark, str(tmp_path / "db"))
    from pyspark.sql.types import StructType

    run = lambda: stream.keep_latest(stream.once_each(stream.read_log(spark, log, StructType.fromDDL(schema))), store, "latest", str(tmp_path / "cp")).awaitTermination()
    run()
    add([(3, 7, "a", 0.9, day(3))])
    run()
    assert rows(store.read("latest"), "location_id", "verification_id") == [(7, 3), (8, 2)]


def test_rendering(small):
    result = render.QueryResult("T", small.games.orderBy("game_id"), ["note"])
    assert json.loads(render.render(result, "json"))["rows"][0]["game_id"] == -2_000_000_010
    assert render.render(result, "csv").splitlines()[0] == "game_id,name,manufacturer"
    assert "| Galaga " in render.render(result) and "_No rows._" in render.render(render.QueryResult("T", small.games.where("false")))


def test_flags_may_stand_anywhere():
    assert command.hoisted(["rare", "--limit", "3", "5", "--include-inactive", "--data=x"]) == ["--limit", "3", "--include-inactive", "--data=x", "rare", "5"]
    a = command.parser().parse_args(command.hoisted(["games", "pac", "--data", "d"]))
    assert (a.question, a.words, a.data) == ("games", ["pac"], "d")


def test_entry_works_without_the_text_operators(tmp_path):
    import shutil

    shutil.copytree(ROOT / "placekeep", tmp_path / "placekeep", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and s and not any(n.startswith('op') for n in q) and 'pipeline' not in q; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr


def test_owned_tables_evolve(spark):
    df = model.evolve(spark.createDataFrame([(1, "x")], "game_id long, extra string"), "games")
    assert df.columns == ["game_id", "name", "manufacturer", "extra"] and all(model.empty(spark, n).count() == 0 for n in model.SCHEMAS)


def test_captured_pages(spark):
    body = "<title>Caf\u00e9</title><a href='/list'>List</a><p>One</p>"
    schema = "url string, final_url string, status int, content_type string, body binary, error string"
    given = [
        ("h.example", "https://h.example/home", 200, "text/html; Charset=latin-1", body.encode("latin-1"), None),
        ("https://h.example/long", None, 200, "text/html", b"<p>abc</p><p>cut off here", ""),
        ("https://h.example/odd", None, 200, "text/html; charset=nosuch", body.encode(), None),
        ("https://h.example/gone", "https://h.example/x", 404, "text/html", b"<p>not here</p>", None),
        (" http://late.example ", None, None, None, None, "timed out"),
        (None, None, None, None, None, None),
    ]
    got = pages.captured_pages(spark.createDataFrame(given, schema), most_bytes=60).collect()
    assert [(r.ok, r.url, r.status, r.error) for r in got] == [
        (True, "https://h.example/home", 200, ""), (True, "https://h.example/long", 200, ""), (True, "https://h.example/odd", 200, ""),
        (False, "https://h.example/gone", 404, "HTTP 404"), (False, "http://late.example", None, "timed out"), (True, None, None, ""),
    ]
    assert got[0].page.title == got[2].page.title == "Caf\u00e9" and [tuple(x) for x in got[0].page.links] == [("List", "https://h.example/list")]
    assert got[0].cache_key == hashlib.sha256(b"https://h.example").hexdigest()[:24] and got[3].cache_key is None
    assert got[3].page.text == "" and got[4].page.text == "" and got[5].page.text == ""
    short = pages.captured_pages(spark.createDataFrame(given[1:2], schema), most_bytes=10).first()
    assert short.page.text == "abc"


def test_publishing_counts_rows(spark, tmp_path, small):
    store = upsert.Snapshots(spark, str(tmp_path / "store"))
    assert store.manifest() == {}
    made = pipelines.publish(small, store, "2024-05-01T00:00:00")
    assert made["generated_at"] == "2024-05-01T00:00:00" and set(made["files"]) == {"route_locations", "location_games"}
    assert made["counts"] == {n: store.read(n).count() for n in made["files"]} and made["files"] == store.current()
    store.commit({"other": small.statuses})
    assert store.manifest() == made and set(store.current()) == {"route_locations", "location_games", "other"}


def test_pages_are_parsed_in_small_parts(spark):
    """A batch of many pages leaves a worker in parts of about SLICE bytes, so its parsed values don't grow with the batch."""
    import pyarrow as pa

    texts = [None, "", *["<p>" + "x" * 100_000] * 60, "y" * 3_000_000, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "html"])
    parts = list(pages._slices(batch, 1))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= pages.SLICE for p in parts) and len(parts) >= 7
    assert list(pages._slices(batch.slice(0, 0), 1)) == []


def test_parts_follow_the_rows(spark, monkeypatch):
    """Counts of items and appended placements are grouped in parts of a bounded number of rows, whatever the session's partitions."""
    from placekeep import catalogue, session

    monkeypatch.setattr(session, "TASK_ROWS", 50)
    assert session.by_rows(spark.range(5000), "id").rdd.getNumPartitions() == 100
    p = model.bind(spark, "/root/testdata/sf0.001")
    parts = -(-p.location_games.count() // 50)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [game_id" in (text := plan(identity.items_with_counts(p))) and f", {parts}" in text
    appended = plan(catalogue.queries()["appended_if_new"](spark, "/root/testdata/sf0.001"))
    assert "RepartitionByExpression [location_id" in appended and f", {parts}" in appended
