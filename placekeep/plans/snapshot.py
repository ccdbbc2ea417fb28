"""The published snapshot, the dashboard on it, and browsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placekeep.functions import predicates as P
from placekeep.model import Places
from placekeep.operators.identity import one_hop
from placekeep.plans.cli import nulls_last, places

#: Places below which an item is rare, and the bins of the histogram.
RARE = 10
BINS = ((1, 5, "1-5"), (6, 10, "6-10"), (11, 25, "11-25"), (26, 50, "26-50"), (51, 100, "51-100"), (101, 250, "101-250"), (251, 500, "251-500"), (501, 10_000, "501+"))
#: Cabinet types and words of rhythm items.
RHYTHM_TYPES, RHYTHM_WORDS = ("music game", "rhythm"), ("dance", "pump it up", "sound voltex")


def route_locations(p: Places, dedupe_links: bool = False) -> DataFrame:
    """Active places with coordinates and placements.

    As published, a place with several links counts its placements once for
    each pair of them; ``dedupe_links`` counts them once.
    """
    named = one_hop(p.games, p.canonical_links)
    lower = F.lower(F.coalesce("source_name", F.lit("")))
    rhythm = F.lower(F.coalesce("cabinet_type", F.lit(""))).isin(*RHYTHM_TYPES)
    for w in RHYTHM_WORDS:
        rhythm = rhythm | F.contains(lower, F.lit(w))
    placed = p.location_games.join(named, "game_id", "left")
    # Placements are counted per place before links are joined; the links' fan-out is a factor.
    counts = placed.groupBy("location_id").agg(F.count("game_id").alias("_n"), F.countDistinct("canonical_game_id").alias("unique_game_count"), F.sum(F.when(F.col("cabinet_type") == "Pinball", 1).otherwise(0)).alias("_pinball"), F.sum(F.when(rhythm, 1).otherwise(0)).alias("_rhythm"))
    df = places(p).where("latitude IS NOT NULL AND longitude IS NOT NULL").drop("game_count").join(counts.where("_n > 0"), "location_id")
    for links, name in ((p.a_links, "_a"), (p.b_links, "_b")):
        if links is not None:
            df = df.join(links.groupBy("location_id").agg(F.count("*").alias(name)), "location_id", "left")
        else:
            df = df.withColumn(name, F.lit(None).cast("long"))
    times = F.lit(1) if dedupe_links else F.coalesce("_a", F.lit(1)) * F.coalesce("_b", F.lit(1))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return df.select(
        "location_id",
        "name",
        *[text(c) for c in ("city", "state", "street_address", "website_url", "google_place_id", "google_cid")],
        F.col("latitude").cast("float").alias("latitude"),
        F.col("longitude").cast("float").alias("longitude"),
        F.col("status") if "status" in df.columns else F.lit("active").alias("status"),
        (F.col("_n") * times).alias("game_count"),
        "unique_game_count",
        (F.col("_pinball") * times).alias("pinball_games"),
        (F.col("_rhythm") * times).alias("rhythm_games"),
        F.concat_ws(" ", F.when(F.col("_a").isNotNull(), "source A"), F.when(F.col("_b").isNotNull(), "source B")).alias("source_tags"),
    )


def location_games(p: Places, rare: int = RARE) -> DataFrame:
    """Placements at active places with national and state counts and flags."""
    named = one_hop(p.games, p.canonical_links)
    rows = p.location_games.join(places(p).select("location_id", F.col("state").alias("location_state")), "location_id").join(named, "game_id")
    pairs = rows.select("canonical_game_id", "location_state", "location_id").distinct()
    national = pairs.groupBy("canonical_game_id").agg(F.countDistinct("location_id").alias("us_location_count"))
    by_state = pairs.groupBy("canonical_game_id", "location_state").agg(F.countDistinct("location_id").alias("state_location_count"))
    df = rows.join(national, "canonical_game_id", "left").join(by_state, ["canonical_game_id", "location_state"], "left")
    us, st = F.coalesce("us_location_count", F.lit(0)), F.coalesce("state_location_count", F.lit(0))
    return df.select(
        "location_id",
        "location_state",
        "game_id",
        F.col("source_name").alias("name"),
        F.coalesce("source_manufacturer", F.lit("")).alias("manufacturer"),
        "canonical_game_id",
        "canonical_name",
        F.coalesce("cabinet_type", F.lit("")).alias("cabinet_type"),
        us.alias("us_location_count"),
        st.alias("state_location_count"),
        F.when(us < rare, 1).otherwise(0).alias("rare_us"),
        F.when(st == 1, 1).otherwise(0).alias("unique_state"),
    )


def metrics(p: Places, rare: int = RARE) -> DataFrame:
    """Machines, distinct items, pinball and rare items of each active place."""
    at = places(p)
    named = one_hop(p.games, p.canonical_links).select("game_id", "canonical_game_id")
    rows = p.location_games.join(at.select("location_id"), "location_id").join(named, "game_id")
    national = rows.groupBy("canonical_game_id").agg(F.countDistinct("location_id").alias("_places"))
    counts = (
        rows.join(national, "canonical_game_id", "left")
        .groupBy("location_id")
        .agg(F.count("canonical_game_id").alias("machine_count"), F.countDistinct("canonical_game_id").alias("unique_game_count"), F.count_if(F.coalesce("cabinet_type", F.lit("")) == "Pinball").alias("pinball_count"), F.countDistinct(F.when(F.col("_places") < rare, F.col("canonical_game_id"))).alias("rare_us_count"))
    )
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return at.join(counts, "location_id", "left").select("location_id", "name", *[text(c) for c in ("city", "state", "street_address", "website_url", "google_place_id", "google_cid")], "latitude", "longitude", *[zero(c) for c in ("machine_count", "unique_game_count", "pinball_count", "rare_us_count")])


def _rolled(df: DataFrame, *keys: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("arcades"), F.sum("machine_count").alias("machines"), F.sum("rare_us_count").alias("rare_us_machines"), F.sum("pinball_count").alias("pinball_machines"))


def dashboard_cities(m: DataFrame) -> DataFrame:
    known = F.when(F.trim("city") == "", "Unknown").otherwise(F.trim("city")).alias("city")
    return _rolled(m.where("machine_count > 0"), known, F.col("state")).withColumn("label", F.concat_ws(", ", "city", "state"))


def dashboard_states(m: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    df = _rolled(m.where("machine_count > 0"), F.col("state"))
    label = F.coalesce(F.create_map(*[F.lit(v) for kv in (names or {"": ""}).items() for v in kv])[F.col("state")], F.col("state"))
    return df.withColumn("label", label)


def dashboard_totals(m: DataFrame) -> DataFrame:
    df = m.where("machine_count > 0")
    known = F.when(F.trim("city") == "", "Unknown").otherwise(F.trim("city"))
    return df.agg(F.count("*").alias("arcades"), F.countDistinct(known, "state").alias("cities"), F.countDistinct("state").alias("states"), F.coalesce(F.sum("machine_count"), F.lit(0)).alias("machines"), F.coalesce(F.sum("rare_us_count"), F.lit(0)).alias("rare_us_machines"))


def histogram(m: DataFrame) -> DataFrame:
    """Places by machines, empty bins included."""
    bins = m.sparkSession.createDataFrame([(label, low, high) for low, high, label in BINS], "label string, min int, max int")
    bin_of = F.when(F.lit(False), "")
    for low, high, label in BINS:
        bin_of = bin_of.when(F.col("machine_count").between(low, high), label)
    counts = m.withColumn("label", bin_of).where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("arcades"), F.sum("machine_count").alias("machines"), F.sum("rare_us_count").alias("rare_us_machines"))
    return bins.join(counts, "label", "left").select("label", "min", "max", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("arcades", "machines", "rare_us_machines")])


def largest(m: DataFrame, n: int = 100) -> DataFrame:
    """The top places by machines and by rare items; of one name, city and state, one stays: of the rare list if it is there."""
    df = m.where("machine_count > 0")
    top = lambda c: df.orderBy(F.desc(c), "name", "location_id").limit(n)
    both = top("machine_count").withColumn("_list", F.lit(0)).unionByName(top("rare_us_count").withColumn("_list", F.lit(1)))
    best = both.groupBy("name", "city", "state").agg(F.max(F.struct("_list", F.when(F.col("_list") == 0, -F.col("machine_count")).otherwise(-F.col("rare_us_count")).alias("o"), "location_id", "machine_count", "unique_game_count", "rare_us_count", "pinball_count", "latitude", "longitude")).alias("b"))
    return best.select("name", "city", "state", "b.location_id", F.col("b.machine_count").alias("machines"), F.col("b.unique_game_count").alias("unique_games"), F.col("b.rare_us_count").alias("rare_us_machines"), F.col("b.pinball_count").alias("pinball_machines"), F.col("b.latitude").alias("lat"), F.col("b.longitude").alias("lon"))


def heat_points(m: DataFrame, box: tuple[float, float, float, float] = (24.396308, 49.384358, -124.848974, -66.885444)) -> DataFrame:
    return m.where(F.col("machine_count") > 0).where(P.in_box(F.col("latitude"), F.col("longitude"), box)).select("location_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("machine_count").alias("machines"), F.col("rare_us_count").alias("rare"))


def quality(p: Places) -> DataFrame:
    """Coverage of each state by coordinates, sites and place ids."""
    k = F.col("location_id")
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return places(p).groupBy("state").agg(
        F.countDistinct(k).alias("locations"),
        F.countDistinct(F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), k)).alias("with_coordinates"),
        F.countDistinct(F.when(some("website_url"), k)).alias("with_website"),
        F.countDistinct(F.when(some("google_place_id"), k)).alias("with_place_id"),
        F.countDistinct(F.when(P.in_source_a(k) | P.in_source_b(k), k)).alias("other_source_locations"),
    )


def _kind(kind: str) -> Column:
    pinball = F.lower("cabinet_type") == "pinball"
    return pinball if kind == "pinball" else ~pinball


def _maker() -> Column:
    return F.coalesce(F.nullif(F.col("manufacturer"), F.lit("")), F.lit("Unknown"))


def browse_kinds(lg: DataFrame) -> DataFrame:
    return lg.groupBy(F.when(F.lower("cabinet_type") == "pinball", "pinball").otherwise("arcade").alias("kind")).agg(F.countDistinct("canonical_game_id").alias("games"))


def browse_makers(lg: DataFrame, kind: str, limit: int = 80) -> DataFrame:
    df = lg.where(_kind(kind)).groupBy(_maker().alias("manufacturer")).agg(F.countDistinct("canonical_game_id").alias("games"), F.sum("rare_us").alias("rare_hits"))
    return df.orderBy(F.desc("games"), "manufacturer").limit(limit)


def browse_items(lg: DataFrame, kind: str, maker: str, limit: int = 120) -> DataFrame:
    df = lg.where(_kind(kind) & (_maker() == maker)).groupBy("canonical_game_id", "canonical_name")
    out = df.agg(F.when(F.lower(F.min("cabinet_type")) == "pinball", "pinball").otherwise("video").alias("machine_kind"), F.min("us_location_count").alias("us_location_count"), F.countDistinct("location_id").alias("listed_locations"), F.max("rare_us").alias("rare_us"))
    return out.orderBy("us_location_count", nulls_last("canonical_name"), "canonical_game_id").limit(limit)


_FOUND = ("canonical_name", "cabinet_type", "us_location_count", "state_location_count", "rare_us", "location_name", "city", "state", "street_address", "game_count")


def _found(lg: DataFrame, rl: DataFrame) -> DataFrame:
    return lg.join(rl.select("location_id", F.col("name").alias("location_name"), "city", "state", "street_address", "game_count"), "location_id")


def browse_places(lg: DataFrame, rl: DataFrame, name: str, limit: int = 120) -> DataFrame:
    df = _found(lg.where(F.col("canonical_name") == name), rl)
    return df.orderBy("state", "city", "location_name", "location_id", "game_id", "cabinet_type").limit(limit).select(*_FOUND)


def search_snapshot(lg: DataFrame, rl: DataFrame, query: str, limit: int = 80) -> DataFrame:
    df = _found(lg.where(P.contains_text([F.col("name"), F.col("canonical_name")], query)), rl)
    return df.orderBy("us_location_count", F.desc("game_count"), "location_id", "game_id", "cabinet_type").limit(limit).select(*_FOUND)


def games_at(lg: DataFrame, ids: DataFrame) -> DataFrame:
    """Placements of each place in display order, as one array."""
    item = F.struct((-F.col("rare_us")).alias("r"), (-F.col("unique_state")).alias("u"), "cabinet_type", "name", "game_id", "us_location_count")
    return lg.join(ids.select("location_id"), "location_id", "left_semi").groupBy("location_id").agg(F.array_sort(F.collect_list(item)).alias("games")).select("location_id", F.transform("games", lambda g: F.struct(g["name"].alias("name"), g["cabinet_type"].alias("cabinet_type"), g["us_location_count"].alias("us_location_count"))).alias("games"))
