"""Matchers against comparing all pairs, merges against the plain loop, ids and snapshots."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from placekeep.functions import similarity as S
from placekeep.functions import text as X
from placekeep.operators import identity, matching, upsert
from placekeep.plans import pipelines, rosters

from .test_blocking import names


def forms(spark, texts, form):
    """The normal form of each text."""
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return {r.t: r.f for r in df.select("t", form(F.col("t")).alias("f")).collect()}


def laddered(a, b, inside):
    if not a or not b:
        return 0.0
    return 1.0 if a == b else inside if a in b or b in a else SequenceMatcher(None, a, b).ratio()


def test_items_lose_no_match(spark):
    rng = random.Random(3)
    makers = ["Williams", "Bally", "", None]
    known_pairs = ("Kalaga", "Pong", "XMen"), ("Galaga", "Superpong", "X-Men")
    left, right = ([(i, n, "Williams" if n in own else rng.choice(makers)) for i, n in enumerate([*names(rng, 120), *own])] for own in known_pairs)
    form, maker = forms(spark, {n for _, n, _ in left + right}, X.import_name), forms(spark, ["Williams", "Bally", ""], X.import_maker) | {None: ""}
    want = {}
    for i, n, m in left:
        best = (0, 0)
        for j, k, o in right:
            a, b = maker[m] or "", maker[o] or ""
            same = (1.0 if a == b else 0.0) if a and b else 0.5
            score = max(0.0, laddered(form[n], form[k], 0.9) * 0.82 + same * 0.18 - (0.12 if same == 0 else 0))
            best = max(best, (round(score, 9), -j))
        if best[0] >= 0.86:
            want[i] = (-best[1], best[0])
    source = spark.createDataFrame(left, "source_id long, name string, manufacturer string")
    known = spark.createDataFrame(right, "game_id long, name string, manufacturer string")
    got = {r.source_id: (r.game_id, round(r.confidence, 9)) for r in matching.item_matches(source, known).collect()}
    assert got == want and len(want) > 30 and all(i in got for i, n, _ in left if n in known_pairs[0])


def places(rng, n, key):
    cities, states = ["Ogden", "Ogdan", "South Ogden", "Salt Lake City", "Provo", "Logan", "", None], ["UT", "ut", "NV", None, ""]
    out = []
    for i in range(n):
        name = rng.choice(["Star", "Galaxy", "Fun", "Pin", "Arcade"]) + " " + rng.choice(["World", "Palace", "Wrld", "Zone", "Arcade"])
        street = rng.choice([f"{rng.randint(1, 30)} Main Street", f"{rng.randint(1, 30)} Main St", f"{rng.randint(1, 30)} Oak Ave", None])
        out.append((i, name, street, rng.choice(cities), rng.choice(states), rng.choice(["84401", "84402", "84101", "", None]), 40.0 + rng.random() * 0.05, -112.0 + rng.random() * 0.05))
    return out, f"{key} long, name string, street_address string, city string, state string, postal_code string, latitude double, longitude double"


def test_places_lose_no_match(spark):
    rng = random.Random(8)
    source, known = spark.createDataFrame(*places(rng, 90, "source_id")), spark.createDataFrame(*places(rng, 110, "location_id"))
    cols = ("name", "street_address", "city", "state", "postal_code")
    a, b = source.select("source_id", *[F.col(c).alias(f"a_{c}") for c in cols]), known.select("location_id", *[F.col(c).alias(f"b_{c}") for c in cols])
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    every = S.place_match_score(a.crossJoin(b).where(none("a_state") | none("b_state") | (F.upper("a_state") == F.upper("b_state")))).collect()
    want = {}
    for r in every:
        if r.confidence >= matching.PLACE_REVIEW:
            want[r.source_id] = max(want.get(r.source_id, (0, 0)), (r.confidence, -r.location_id))
    got = {r.source_id: (r.confidence, -r.location_id) if r.band != "new" else None for r in matching.place_matches(source, known).collect()}
    assert got == {i: want.get(i) for i in range(90)} and 20 < len(want)


def test_directories_lose_no_pair(spark):
    rng = random.Random(9)
    source, local = (spark.createDataFrame(*places(rng, n, key)).withColumn("state", F.upper(F.coalesce("state", F.lit("UT")))) for n, key in ((90, "source_id"), (110, "location_id")))
    cols = ("name", "city", "street_address", "latitude", "longitude")
    a, b = source.select("source_id", "state", *[F.col(c).alias(f"a_{c}") for c in cols]), local.select("location_id", "state", *[F.col(c).alias(f"b_{c}") for c in cols])
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(matching._directory_scores(a.join(b, "state")))
    assert rows(matching.directory_pairs(source, local)) == want and len(want) > 50


def test_rosters_resolve_no_less(spark):
    rng = random.Random(5)
    listed = [*names(rng, 80), "Tron", "MM Remake", "Star", "The"]
    known = [*names(rng, 80), "Electron", "Medieval Madness (CGC)", "A Star"]
    items = spark.createDataFrame([(i, n, "", 1) for i, n in enumerate(known, 1)], "game_id long, name string, manufacturer string, location_count long")
    df = spark.createDataFrame([(n,) for n in listed], "name string")
    every = df.select(F.col("name").alias("l")).crossJoin(items.select("game_id", "name")).withColumn("score", rosters.resolve_score(F.col("l"), F.col("name"))).where("score >= 0.9").collect()
    want = {}
    for r in every:
        want[r.l] = max(want.get(r.l, 0), r.score)
    got = {r.listed_name: r.score for r in rosters.resolve_names(df, items).collect()}
    assert got == want and "Tron" in got and "MM Remake" in got


def merged(machines, inventory, games, score):
    """The merge by a loop over places and machines."""
    every, out = [(g, n) for g, n in games], {}
    for place in sorted({m[0] for m in machines}):
        here = [g for g in every if g[0] in inventory.get(place, ())]
        for _, machine, source_game, name in sorted(m for m in machines if m[0] == place):
            best = max(((score(name, n), -i) for i, (_, n) in enumerate(here)), default=(0, 0))
            if best[0] >= pipelines.MERGE:
                out[machine] = (here[-best[1]][0], "duplicate_local_inventory")
                continue
            best = max(((score(name, n), -i) for i, (_, n) in enumerate(every)), default=(0, 0))
            if best[0] >= pipelines.MERGE:
                item, method = every[-best[1]], "matched_existing_game"
            else:
                item, method = (-2_000_000_000 - source_game, name), "source_only_game"
                every.append(item)
            out[machine] = (item[0], method)
            here.append(item)
    return out


def test_merges_follow_the_loop(spark):
    rng = random.Random(7)
    base = ["Brand New Thing", "Brand New Thng", "Brand New Things", "Galaga Arrangement", "Galaga Arangement", "Lightning", "Star Trek Voyager", "Star Trek Voyagers", "Voyager Star Trek", "Dance Machine Super", "Dance Machine Super 2"]
    games = [(i, n) for i, n in enumerate(["Galaga Arrangement", "Star Trek Voyager", "Lightning", "Dance Machine Super"], 1)]
    machines = [(rng.randint(1, 12), m, 100 + m, rng.choice(base)) for m in range(60)]
    inventory = {p: {rng.randint(1, 4)} for p in range(1, 13) if p % 2}
    pairs = spark.createDataFrame([(a, b) for a in base for b in base], "a string, b string").withColumn("s", matching.merge_score(F.col("a"), F.col("b"))).collect()
    score = {(r.a, r.b): r.s for r in pairs}
    want = merged(machines, inventory, games, lambda a, b: score[(a, b)])
    links = spark.createDataFrame([(p, p) for p in range(1, 13)], "location_id long, source_id long")
    rows = spark.createDataFrame([(p, m, g, n, "Video") for p, m, g, n in machines], "source_id long, machine_id long, source_game_id long, name string, genre string")
    placed = spark.createDataFrame([(p, g) for p, own in inventory.items() for g in own], "location_id long, game_id long")
    got = {r.machine_id: (r.game_id, r.method) for r in pipelines.merge_machines(links, rows, placed, spark.createDataFrame(games, "game_id long, name string")).collect()}
    assert got == want and len({m for _, m in want.values()}) == 3


def test_page_text_matches_titles(spark):
    known = spark.createDataFrame([(1, "Attack From Mars"), (1, "Mars"), (1, "Zed"), (1, "Total Carnage"), (2, "Mars")], "location_id long, name string")
    listed = spark.createDataFrame([(1, 0, 1, "Our Attack"), (1, 0, 2, "From Mars and more games"), (1, 1, 1, "Zed!")], "location_id long, page int, place int, name string").withColumn("form", X.roster_name(F.col("name")))
    pages = spark.createDataFrame([(1, 0, "Total Carnage and more"), (1, 1, None)], "location_id long, page int, title string")
    got = {(r.bucket, r.name) for r in rosters.compare_rosters(known, listed, pages=pages).collect()}
    assert {("matched", "Attack From Mars"), ("matched", "Mars"), ("matched", "Zed"), ("matched", "Total Carnage")} <= got
    assert ("website_only", "Our Attack") in got


def test_ids_follow_the_order(spark):
    rng = random.Random(1)
    words = [f"{rng.random():.9f}" for _ in range(500)]
    new = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "name string, n long").repartition(7)
    taken = spark.createDataFrame([(10_000_100,)], "game_id long")
    got = {r.name: r.game_id for r in identity.allocate_ids(new, ["name"], taken).collect()}
    assert got == {w: 10_000_101 + i for i, w in enumerate(sorted(words))}
    assert identity.allocate_ids(new.where("false"), ["name"], taken).collect() == []


class Stop(Exception):
    pass


@pytest.mark.parametrize("step", ["write", "create", "getUri"])
def test_a_crash_leaves_the_old_version(spark, tmp_path, step):
    first = upsert.Snapshots(spark, str(tmp_path / "s"))
    assert first.current() == {}
    first.commit({"a": spark.range(3), "b": spark.range(1)})

    class Broken:
        """The file system until the step at which the process ends."""

        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            if name == step:
                raise Stop
            return getattr(self.fs, name)

    store = upsert.Snapshots(spark, str(tmp_path / "s"))
    store.pointers.fs = Broken(store.pointers.fs)
    bad = spark.range(9)
    tables = {"a": bad, "b": bad.select(F.raise_error(F.lit("stop")).alias("id"))} if step == "write" else {"a": bad}
    with pytest.raises(Exception):
        store.commit(tables)
    again = upsert.Snapshots(spark, str(tmp_path / "s"))
    assert again.read("a").count() == 3 and again.read("b").count() == 1
    again.commit({"a": spark.range(5)})
    assert again.read("a").count() == 5 and again.read("b").count() == 1 and first.read("a").count() == 5


def test_two_snapshot_writers(spark, tmp_path):
    one, two = (upsert.Snapshots(spark, str(tmp_path / "s")) for _ in range(2))
    one.commit({"a": spark.range(3), "b": spark.range(1)})
    base = one.version()
    two.commit({"b": spark.range(4)})
    one.commit({"a": spark.range(5)}, since=base)
    assert one.read("a").count() == 5 and one.read("b").count() == 4
    with pytest.raises(upsert.Conflict):
        two.commit({"a": spark.range(9)}, since=base)
    assert one.read("a").count() == 5 and one.version() == 3


def numbered(spark, n, key):
    """Places of one city, far apart, each with a code that few share."""
    rows = [(i, f"Hall {i:05d}", "7 Main Street", "Ogden", "UT", f"{i % (n // 4):05d}", 25.0 + i * 37 % 2400 / 100, -124.0 + i * 53 % 5700 / 100) for i in range(n)]
    return spark.createDataFrame(rows, f"{key} long, name string, street_address string, city string, state string, postal_code string, latitude double, longitude double")


def counting(monkeypatch, module, name):
    """Counts the rows that go into a function of DataFrames."""
    seen, real = [], getattr(module, name)

    def counted(df):
        seen.append(df.count())
        return real(df)

    monkeypatch.setattr(module, name, counted)
    return seen


def test_places_of_one_city_with_codes_meet_few(spark, monkeypatch):
    n = 200
    seen = counting(monkeypatch, matching.S, "place_match_score")
    got = matching.place_matches(numbered(spark, n, "source_id"), numbered(spark, n, "location_id")).collect()
    assert all(r.source_id == r.location_id for r in got) and len(got) == n
    assert sum(seen) <= 4 * n


def test_entries_of_one_city_far_apart_meet_few(spark, monkeypatch):
    n = 200
    seen = counting(monkeypatch, matching, "_directory_scores")
    source, local = numbered(spark, n, "source_id"), numbered(spark, n, "location_id")
    got = matching.directory_matches(source, local).collect()
    assert all(r.source_id == r.location_id for r in got) and len(got) == n
    assert sum(seen) <= 12 * n


def test_directories_with_and_without_coordinates_lose_no_pair(spark):
    rng = random.Random(19)
    out = []
    for n, key in ((80, "source_id"), (90, "location_id")):
        list_, kind = places(rng, n, key)
        # Some have no coordinates, others lie far away.
        list_ = [(*r[:6], *((None, r[7]) if r[0] % 4 == 0 else (r[6] + r[0] % 4 * 3.0, r[7] * 3 if r[0] % 8 == 1 else r[7]))) for r in list_]
        out.append(spark.createDataFrame(list_, kind).withColumn("state", F.upper(F.coalesce("state", F.lit("UT")))))
    cols = ("name", "city", "street_address", "latitude", "longitude")
    a, b = (df.select(key, "state", *[F.col(c).alias(f"{p}_{c}") for c in cols]) for df, key, p in zip(out, ("source_id", "location_id"), "ab"))
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(matching._directory_scores(a.join(b, "state")).select("source_id", "location_id", "confidence", "distance_miles"))
    assert rows(matching.directory_pairs(*out).select("source_id", "location_id", "confidence", "distance_miles")) == want and len(want) > 50


def test_rosters_read_their_tables_few_times(spark):
    """Known and listed names are read into checkpoints; the later steps don't compute their tables again."""
    reads = spark.sparkContext.accumulator(0)

    def seen(i):
        reads.add(1)
        return f"name {i}"

    known = spark.range(60).select((F.col("id") % 7).alias("location_id"), F.udf(seen)("id").alias("name"))
    compared = rosters.compare_rosters(known, known.withColumn("form", F.lower("name"))).collect()
    assert {r.bucket for r in compared} == {"matched"} and len(compared) == 60
    assert reads.value <= 60 * 5
