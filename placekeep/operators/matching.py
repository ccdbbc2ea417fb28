"""Blocking, argmax and one-to-one assignment of scored pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placekeep.functions import similarity as S
from placekeep.functions import text as X
from placekeep.functions.geo import haversine
from placekeep.operators.blocking import alike_candidates
from placekeep.operators.identity import source_rank
from placekeep.operators.spatial import within_miles
from placekeep.session import checkpointed, spread

#: Thresholds.
PLACE_ACCEPT, PLACE_REVIEW, ITEM_ACCEPT = 0.78, 0.65, 0.86
AUTO_LINK, REVIEW_LINK = 0.995, 0.90
CLUSTER_LEAST, TITLE_LEAST = 72.0, 86.0
#: Words of variants and generic titles in duplicate review.
REVIEW_VARIANTS = ("2p", "4p", "6p", "dx", "plus", "premium", "pro", "se", "le", "deluxe", "limited", "edition", "remix", "super", "world", "version")
GENERIC_TITLES = ("batman", "basketball", "black hole", "circus", "defender", "dragon", "galaxy", "godzilla", "hook", "pinball", "flipper", "rampage", "star wars", "street fighter ii", "the simpsons", "touchdown")
#: Titles too short to merge by likeness.
SHORT_TITLES = ("0", "24", "baby pac man", "batman", "galaxy", "ghostbusters", "hockey table", "lightning", "pac man", "paradise lost", "pool table", "rampage", "simpsons", "star wars", "the act", "the end", "the simpsons")


def best_per(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def one_to_one(pairs: DataFrame, left: str, right: str, *order: Column) -> DataFrame:
    """Greedy assignment: pairs in the given strict order, each if both its sides are free.

    A pair that comes first for both its sides is taken by the greedy pass
    whatever else happens, so rounds of taking all such pairs and dropping
    those that share a side give the same assignment, without one task seeing
    all pairs. ``order`` must not tie.
    """
    rest = checkpointed(pairs)
    taken: DataFrame | None = None
    while not rest.isEmpty():
        a, b = Window.partitionBy(left).orderBy(*order), Window.partitionBy(right).orderBy(*order)
        first = checkpointed(rest.withColumn("_a", F.row_number().over(a)).withColumn("_b", F.row_number().over(b)).where("_a = 1 AND _b = 1").drop("_a", "_b"))
        taken = first if taken is None else taken.unionByName(first)
        rest = checkpointed(rest.join(first.select(left), left, "left_anti").join(first.select(right), right, "left_anti"))
    return rest if taken is None else taken


#: Likeness of cities from which places may be one; below it only a common postal code counts.
CITY_LEAST = 0.75
#: More than a pair of places without one postal code can score.
NO_CODE_MOST = 0.9 + 1e-9
#: Miles from which distance lowers a directory entry's score, and likeness of names that the score needs from there on, and where no distance or city helps.
FAR_MILES, FAR_NAME, NAME_LEAST = 20.0, 0.93, 0.84


def _city_pairs(a: DataFrame, b: DataFrame, ratio, least: float) -> DataFrame:
    """Distinct (a_city_form, b_city_form) whose likeness is at least ``least``; cities are compared once each."""
    forms = lambda df, c: df.select(F.col(c).alias("form"), F.lit(0).alias("part"))
    pairs = alike_candidates(forms(a, "a_city_form"), forms(b, "b_city_form"), least).select(F.col("a").alias("a_city_form"), F.col("b").alias("b_city_form"))
    return checkpointed(pairs.withColumn("like", ratio(F.col("a_city_form"), F.col("b_city_form"))).where(F.col("like") >= least).drop("like"))


def place_matches(source: DataFrame, known: DataFrame) -> DataFrame:
    """Best known place of each source place and the score, from PLACE_REVIEW on; below it a place is new.

    Both sides have name, street_address, city, state, postal_code; ids are
    source_id and location_id. A null state matches all states. Places can only
    reach the band with like cities or one postal code. They first meet on the
    code; a source place whose best score there is more than any other place can
    have is done. The others meet places of like cities and other codes; pairs
    whose lengths already rule the band out aren't compared.
    """
    cols = ("name", "street_address", "city", "state", "postal_code")
    texts = ("name", "street_address", "city")
    side = lambda df, key, p: df.select(key, *[F.col(c).alias(f"{p}_{c}") for c in cols], *[X.match_form(F.col(c)).alias(f"{p}_{c}_form") for c in texts])
    # Forms are columns of a checkpoint, so that no expression repeats them.
    a, b = checkpointed(side(source, "source_id", "a")), checkpointed(side(known, "location_id", "b"))
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""

    def met(x: DataFrame, key: str, other: str, on: Column) -> DataFrame:
        """Pairs of one state, or where a side has none; the state is a key of the join where both have one."""
        # Either side may be broadcast, so both are spread.
        mine, theirs = spread(x.where(~none("a_state")), F.col(key), F.upper("a_state")), spread(b.where(~none("b_state")), F.col(other), F.upper("b_state"))
        one = mine.join(theirs, on & (F.upper("a_state") == F.upper("b_state")))
        no_a, no_b = x.where(none("a_state")).join(b, on), x.where(~none("a_state")).join(b.where(none("b_state")), on)
        return one.unionByName(no_a).unionByName(no_b).select(*a.columns, *b.columns)

    same_code = F.col("a_postal_code") == F.col("b_postal_code")

    def most(c: str) -> Column:
        """No less than the likeness of column ``c``: one text may hold the other, else lengths bound the ratio."""
        x, y = F.col(f"a_{c}_form"), F.col(f"b_{c}_form")
        n, m = F.length(x), F.length(y)
        bound = F.least(n, m) * 2.0 / F.greatest(n + m, F.lit(1))
        return F.when((x == "") | (y == ""), 0.0).otherwise(F.when(F.contains(x, y) | F.contains(y, x), F.greatest(bound, F.lit(0.92))).otherwise(bound))

    one_code = F.when(~none("a_postal_code") & (F.col("a_postal_code") == F.col("b_postal_code")), 0.1).otherwise(0.0)
    other_codes = F.when(~none("a_postal_code") & ~none("b_postal_code") & (F.col("a_postal_code") != F.col("b_postal_code")), 0.15).otherwise(0.0)
    # Strong names and cities count whatever the codes.
    likely = (most("name") >= 0.88) | (most("name") * 0.4 + most("street_address") * 0.25 + 0.25 + one_code - other_codes >= PLACE_REVIEW)

    def best_of(pairs: DataFrame) -> DataFrame:
        scored = S.place_match_score(pairs.where(likely)).where(F.col("confidence") >= PLACE_REVIEW)
        return best_per(scored.select("source_id", "location_id", "confidence"), "source_id", F.desc("confidence"), F.col("location_id"))

    by_code = checkpointed(best_of(met(a.where(~none("a_postal_code")), "a_postal_code", "b_postal_code", same_code)))
    rest = checkpointed(a.join(by_code.where(F.col("confidence") > NO_CODE_MOST), "source_id", "left_anti"))
    best = by_code
    if not rest.isEmpty():
        cities = _city_pairs(rest, b, lambda x, y: S.laddered(x, y, F.lit(0.92)), CITY_LEAST)
        by_city = met(rest.join(cities.withColumnRenamed("b_city_form", "_city"), "a_city_form"), "_city", "b_city_form", F.col("_city") == F.col("b_city_form"))
        by_city = by_city.where(none("a_postal_code") | ~F.coalesce(same_code, F.lit(False)))
        best = best_per(by_code.unionByName(best_of(by_city)), "source_id", F.desc("confidence"), F.col("location_id"))
    band = F.when(F.col("confidence") >= PLACE_ACCEPT, "match").when(F.col("confidence").isNotNull(), "review").otherwise("new")
    return source.select("source_id").distinct().join(best, "source_id", "left").select("source_id", "location_id", "confidence", band.alias("band"))


def item_matches(source: DataFrame, known: DataFrame) -> DataFrame:
    """Best known item of each source item by name and maker, at least ITEM_ACCEPT.

    Normal names are compared once each, and only candidates that can be alike
    enough for some maker to lift them to the threshold; none of those is left
    out.
    """
    least = (ITEM_ACCEPT - 0.18) / 0.82
    forms = lambda df: df.select(X.import_name(F.col("name")).alias("form"), F.lit(0).alias("part"))
    pairs = alike_candidates(forms(source), forms(known), least).select(F.col("a").alias("a_form"), F.col("b").alias("b_form"))
    alike = pairs.withColumn("likeness", S.laddered(F.col("a_form"), F.col("b_form"), F.lit(0.9))).where(F.col("likeness") * 0.82 + 0.18 >= ITEM_ACCEPT)
    side = lambda df, key, p: df.select(key, X.import_name(F.col("name")).alias(f"{p}_form"), X.import_maker(F.col("manufacturer")).alias(f"{p}_maker"))
    # Known items of one name and maker score alike: the smallest id stands for them.
    b = side(known, "game_id", "b").groupBy("b_form", "b_maker").agg(F.min("game_id").alias("game_id"))
    scored = side(source, "source_id", "a").join(checkpointed(alike), "a_form").join(b, "b_form")
    scored = scored.withColumn("confidence", S.item_score(F.col("likeness"), F.col("a_maker"), F.col("b_maker"))).where(F.col("confidence") >= ITEM_ACCEPT)
    return best_per(scored, "source_id", F.desc("confidence"), F.col("game_id")).select("source_id", "game_id", "confidence")


def directory_ratio(a: Column, b: Column) -> Column:
    """Directory likeness of normal texts: the ratio, shared words or containment, whichever is most."""
    empty, equal = (a == "") | (b == ""), a == b
    overlap = S.token_overlap(a, b) * 0.96
    inside = (F.length(a) >= 5) & (F.length(b) >= 5) & (F.contains(a, b) | F.contains(b, a))
    return F.when(empty, 0.0).when(equal, 1.0).otherwise(F.greatest(S.ratio_if(~empty & ~equal, a, b), overlap, F.when(inside, 0.94).otherwise(0.0)))


def directory_pairs(source: DataFrame, local: DataFrame) -> DataFrame:
    """Scored pairs of directory entries and places of one state; the weak ones are dropped.

    A pair of places that both have coordinates can only reach the least score
    within ``FAR_MILES``, or with names alike from ``FAR_NAME`` on. Where a side has
    none, like cities or names alike from ``NAME_LEAST`` on are needed. Pairs meet
    on those.
    """
    cols = ("name", "city", "street_address", "latitude", "longitude")

    def side(df: DataFrame, key: str, p: str) -> DataFrame:
        words = lambda c, drop=False: X.directory_words(F.col(c), drop)
        lat, lon = F.col("latitude").cast("double"), F.col("longitude").cast("double")
        placed = F.coalesce(lat.between(-90, 90) & ~F.isnan(lon), F.lit(False))
        return df.select(key, "state", *[F.col(c).alias(f"{p}_{c}") for c in cols], words("city").alias(f"{p}_city_form"), F.array_distinct(F.array(words("name", True), words("name"))).alias(f"{p}_forms"), placed.alias("_placed"))

    a, b = side(source, "source_id", "a"), side(local, "location_id", "b")
    ids = ("source_id", "location_id")
    a1, b1 = a.where("_placed"), b.where("_placed")
    points = a1.select("source_id", "state", F.col("a_latitude").alias("point_lat"), F.col("a_longitude").alias("point_lon"))
    places = b1.select("location_id", F.col("state").alias("_state"), F.col("b_latitude").alias("latitude"), F.col("b_longitude").alias("longitude"))
    near = within_miles(points, places, FAR_MILES).where("state = _state").select(*ids)
    met = near.unionByName(_alike_names(a1, b1, FAR_NAME))
    a0, b0 = checkpointed(a.where("NOT _placed")), checkpointed(b.where("NOT _placed"))
    for x, y in ((a0, b), (a1, b0)):
        if not (a0 if x is a0 else b0).isEmpty():
            cities = _city_pairs(x, y, directory_ratio, 0.72)
            met = met.unionByName(x.join(cities, "a_city_form").join(y, ["b_city_form", "state"]).select(*ids)).unionByName(_alike_names(x, y, NAME_LEAST))
    drop = lambda df: df.drop("_placed")
    return _directory_scores(met.distinct().join(drop(a), "source_id").join(drop(b), ["location_id", "state"]))


def _alike_names(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(source_id, location_id) of entries and places of one state whose names may be alike by ``least``: by a ratio, a shared word (the overlap must be nearly all words) or one within the other."""
    form = lambda df, p: df.select("state", F.explode(f"{p}_forms").alias("form")).where("form <> ''").distinct()
    parted = lambda df, p: form(df, p).withColumnRenamed("state", "part")
    near = spread(alike_candidates(parted(a, "a"), parted(b, "b"), least)).where(directory_ratio(F.col("a"), F.col("b")) >= least)
    lists = lambda df, p: form(df, p).withColumn("words", F.array_distinct(F.filter(F.split("form", " "), lambda w: w != "")))
    word = lambda df, p: lists(df, p).select("state", F.col("form").alias(p), F.explode("words").alias("word"), F.size("words").alias(f"{p}_n"))
    shared = _overlapping(word(a, "a"), word(b, "b"), least / 0.96)
    forms = near.select(F.col("part").alias("state"), "a", "b").unionByName(shared).distinct()
    named = lambda df, key, p: df.select(key, "state", F.explode(f"{p}_forms").alias(p))
    return forms.join(named(a, "source_id", "a"), ["state", "a"]).join(named(b, "location_id", "b"), ["state", "b"]).select("source_id", "location_id")


def _directory_scores(pairs: DataFrame) -> DataFrame:
    """The score of each pair of an entry (a_*) and a place (b_*)."""

    def like(c: str, drop: bool = False) -> Column:
        return directory_ratio(X.directory_words(F.col(f"a_{c}"), drop), X.directory_words(F.col(f"b_{c}"), drop))

    df = pairs.withColumn("name_score", F.greatest(like("name", True), like("name"))).withColumn("city_score", like("city")).withColumn("address_score", like("street_address"))
    df = df.withColumn("distance", haversine(F.col("a_latitude"), F.col("a_longitude"), F.col("b_latitude"), F.col("b_longitude")))
    bonus = F.when(F.col("distance") <= 0.15, 0.12).when(F.col("distance") <= 1.0, 0.05).when(F.col("distance") >= 20.0, -0.2).otherwise(0.0)
    score = F.col("name_score") * 0.62 + F.col("city_score") * 0.23 + F.col("address_score") * 0.15 + bonus - F.when(F.col("city_score") < 0.72, 0.08).otherwise(0.0)
    df = df.withColumn("score", F.greatest(F.lit(0.0), F.least(score, F.lit(0.99))))
    method = F.when(F.col("score") >= 0.92, "name_city_address").when(F.col("score") >= 0.84, "probable_name_city").when(F.col("score") >= 0.76, "possible_name_city")
    return df.withColumn("method", method).where("method IS NOT NULL").select("source_id", "location_id", "state", F.round("score", 3).alias("confidence"), "method", F.round("distance", 3).alias("distance_miles"), F.round("name_score", 3).alias("name_score"), F.round("address_score", 3).alias("address_score"))


def _overlapping(x: DataFrame, y: DataFrame, least: float) -> DataFrame:
    """Distinct (state, a, b) of texts that share at least that part of the smaller one's words.

    All but a few of the smaller text's words are shared, so one of its rarest
    few is; those words are joined with all words of the other side.
    """
    uses = checkpointed(x.select("state", "word").unionByName(y.select("state", "word")).groupBy("state", "word").agg(F.count("*").alias("uses")))

    def rare(df: DataFrame, p: str) -> DataFrame:
        w = Window.partitionBy("state", p).orderBy("uses", "word")
        return df.join(uses, ["state", "word"]).withColumn("n", F.row_number().over(w)).where(F.col("n") <= F.floor(F.col(f"{p}_n") * (1 - least) + 1e-9) + 1).drop("n", "uses")

    pairs = rare(x, "a").join(y, ["state", "word"]).where("a_n <= b_n").unionByName(x.join(rare(y, "b"), ["state", "word"]).where("b_n <= a_n"), allowMissingColumns=True)
    return pairs.select("state", "a", "b").distinct()


def directory_matches(source: DataFrame, local: DataFrame) -> DataFrame:
    """One-to-one assignment of directory entries to places, by confidence."""
    return one_to_one(directory_pairs(source, local), "source_id", "location_id", F.desc("confidence"), F.col("source_id"), F.col("location_id"))


def exact_title_links(items: DataFrame) -> DataFrame:
    """Links of items whose titles have one key, where the cluster is safe.

    Safe is a cluster whose items all have one known maker, or whose title has
    twelve letters or three words.
    """
    df = items.withColumn("key", X.title_key(F.col("name"))).withColumn("maker", X.maker_key(F.col("manufacturer"))).withColumn("text", X.title_text(F.col("name")))
    df = df.where(F.length("key") >= 4)
    clusters = df.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("maker").alias("makers"), F.count_if(F.col("maker") == "").alias("bare"), F.min("text").alias("text"))
    safe = clusters.where((F.col("n") >= 2) & (((F.col("makers") == 1) & (F.col("bare") == 0)) | (F.length("text") >= 12) | (F.size(F.split("text", " ")) >= 3)))
    # The canonical item is a minimum in the election's order, so that clusters are pre-aggregated and none is sorted in one task.
    best = df.groupBy("key").agg(F.min(F.struct(source_rank(F.col("game_id")).alias("r"), (-F.col("active_location_count")).alias("a"), (-F.col("location_count")).alias("l"), F.lower("name").alias("n"), F.abs("game_id").alias("i"), F.col("game_id"), F.col("name"))).alias("b"))
    linked = df.join(safe.select("key"), "key").join(best.select("key", F.col("b.game_id").alias("canonical_game_id"), F.col("b.name").alias("canonical_name")), "key")
    return linked.where("game_id <> canonical_game_id").select(F.col("game_id").alias("alias_game_id"), "canonical_game_id", F.lit(1.0).alias("confidence"), F.lit("exact_compact_title").alias("reason"), F.col("name").alias("alias_name"), "canonical_name")


def spelling_pairs(items: DataFrame) -> DataFrame:
    """Pairs of items of one title beginning, compatible makers and unlike keys, with both likenesses."""
    df = items.withColumn("key", X.title_key(F.col("name"))).where(F.length("key") >= 4).withColumn("block", F.substring("key", 1, 4)).withColumn("maker", X.maker_key(F.col("manufacturer")))
    # Items of one name and maker score alike: texts are compared once.
    names = df.select("block", "key", "maker", "name").distinct()
    a, b = names.alias("a"), names.alias("b")
    open_maker = (F.col("a.maker") == "") | (F.col("b.maker") == "") | (F.col("a.maker") == F.col("b.maker"))
    pairs = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.key") < F.col("b.key")) & open_maker).select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("name", "maker")])
    scored = pairs.withColumn("confidence", S.title_similarity(F.col("a_name"), F.col("b_name"))).withColumn("loose", S.loose_similarity(F.col("a_name"), F.col("b_name")))
    same = (X.digit_tokens(F.col("a_name")) == X.digit_tokens(F.col("b_name"))) & (X.variant_tokens(F.col("a_name")) == X.variant_tokens(F.col("b_name")))
    kind = F.when((F.col("confidence") >= AUTO_LINK) & same, "link").when(F.col("loose") >= REVIEW_LINK, "review")
    return scored.withColumn("kind", kind).where("kind IS NOT NULL")


def spelling_links(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links for near-equal spellings, and pairs for review."""
    kept = checkpointed(spelling_pairs(items))
    keyed = items.withColumn("maker", X.maker_key(F.col("manufacturer")))
    sides = kept
    for s in "ab":
        sides = sides.join(keyed.select(*[F.col(c).alias(f"{s}_{c}") for c in ("name", "maker", "game_id", "location_count", "active_location_count")]), [f"{s}_name", f"{s}_maker"])

    def order(s: str) -> Column:
        return F.struct(source_rank(F.col(f"{s}_game_id")), -F.col(f"{s}_active_location_count"), -F.col(f"{s}_location_count"), F.lower(f"{s}_name"), F.abs(f"{s}_game_id"))

    first = order("a") <= order("b")
    links = sides.where("kind = 'link'").select(*[F.when(first, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(n) for x, y, c, n in (("b", "a", "game_id", "alias_game_id"), ("a", "b", "game_id", "canonical_game_id"), ("b", "a", "name", "alias_name"), ("a", "b", "name", "canonical_name"))], "confidence", F.lit("high_confidence_spelling").alias("reason"))
    review = sides.where("kind = 'review'").select(F.col("a_game_id").alias("left_game_id"), F.col("b_game_id").alias("right_game_id"), F.col("loose").alias("confidence"), F.lit("possible_variant_or_edition").alias("reason"), F.col("a_name").alias("left_name"), F.col("b_name").alias("right_name"), F.col("a_active_location_count").alias("left_locations"), F.col("b_active_location_count").alias("right_locations"))
    return links, review


def proposed_links(items: DataFrame) -> DataFrame:
    """The best link of each alias."""
    links = exact_title_links(items).unionByName(spelling_links(items)[0])
    return best_per(links, "alias_game_id", F.desc("confidence"), source_rank(F.col("canonical_game_id")), F.col("canonical_game_id"))


def merge_score(a: Column, b: Column) -> Column:
    """Cautious likeness of item names for merging machines."""
    return merge_form_score(X.merge_name(a), X.merge_name(b), S.item_similarity(a, b))


def with_merge_score(df: DataFrame, a: str, b: str, x: str, y: str) -> DataFrame:
    """Adds ``score`` for names ``a`` and ``b`` with merge forms ``x`` and ``y``; forms and ratio are columns of their own, which keeps the expression small."""
    df = df.withColumn("_ia", X.import_name(F.col(a))).withColumn("_ib", X.import_name(F.col(b)))
    df = df.withColumn("_seq", S.laddered(F.col("_ia"), F.col("_ib"), F.lit(0.9)))
    return df.withColumn("score", merge_form_score(F.col(x), F.col(y), F.col("_seq"))).drop("_ia", "_ib", "_seq")


def merge_form_score(x: Column, y: Column, sequence: Column) -> Column:
    """The same from merge forms and the ratio of the names."""
    wx, wy = F.array_distinct(X.words(x)), F.array_distinct(X.words(y))
    least, most = F.least(F.size(wx), F.size(wy)), F.greatest(F.size(wx), F.size(wy))
    shared = F.size(F.array_intersect(wx, wy))
    overlap, jaccard = shared / F.greatest(least, F.lit(1)), shared / F.greatest(F.size(F.array_union(wx, wy)), F.lit(1))
    inside = (F.contains(x, y) | F.contains(y, x)) & (overlap >= 0.9) & (jaccard >= 0.8)
    return (
        F.when((x == "") | (y == ""), 0.0)
        .when(x == y, 1.0)
        .when(x.isin(*SHORT_TITLES) | y.isin(*SHORT_TITLES), 0.0)
        .when((least == 1) & (most > 2), 0.0)
        .when(inside, 0.94)
        .when(((overlap < 0.5) | (jaccard < 0.5)) & (sequence < 0.97), 0.0)
        .otherwise(F.greatest(sequence, sequence * 0.65 + jaccard * 0.35))
    )


def review_score(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Likeness from 0 to 100 of two items; keys name, manufacturer, cabinet_types (array)."""
    x, y = X.review_text(a["name"]), X.review_text(b["name"])
    ma, mb = X.review_text(a["manufacturer"]), X.review_text(b["manufacturer"])
    both_types = (F.size(a["cabinet_types"]) > 0) & (F.size(b["cabinet_types"]) > 0)
    shared = F.arrays_overlap(a["cabinet_types"], b["cabinet_types"])
    open_maker = (ma == "") | (mb == "") | (ma == mb)
    never = (x == "") | (y == "") | (both_types & ~shared) | ~open_maker
    equal = X.review_key(a["name"]) == X.review_key(b["name"])
    title = F.when(equal, 100.0).otherwise(S.ratio_if(~never & ~equal, x, y) * 100)
    digits = lambda t: F.regexp_extract_all(t, F.lit(r"(\d+)"), F.lit(1))
    variants = lambda t: F.array_sort(F.array_intersect(F.split(t, " "), F.array(*[F.lit(w) for w in REVIEW_VARIANTS])))
    score = title + F.when((ma != "") & (mb != ""), F.when(ma == mb, 6).otherwise(-18)).otherwise(0) + F.when(both_types, F.when(shared, 6).otherwise(-20)).otherwise(0)
    score = score - F.when(digits(x) != digits(y), 22).otherwise(0) - F.when(variants(x) != variants(y), 16).otherwise(0)
    return F.when(never | (title < TITLE_LEAST), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def duplicate_groups(items: DataFrame) -> DataFrame:
    """Members of candidate clusters: items of one compact title under several identities, all alike enough.

    Items have game_id, canonical_game_id, name, manufacturer, cabinet_types,
    active_placement_count. Each identity sends its best placed item. Titles of
    a cluster are equal in compact form, so a pair's score depends only on
    name, maker and types; those are compared once for each distinct profile.
    """
    df = items.withColumn("key", X.review_key(F.col("name"))).where(F.length("key") >= 4)
    reps = best_per(df.withColumn("_who", F.concat_ws("\u0001", "key", F.col("canonical_game_id").cast("string"))), "_who", F.desc("active_placement_count"), F.col("game_id")).drop("_who")
    reps = checkpointed(reps)
    sizes = reps.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("game_id", X.review_text(F.col("name")).alias("t"))).alias("f"))
    several = sizes.where((F.col("size") >= 2) & ~F.col("f.t").isin(*GENERIC_TITLES)).select("key")
    reps = reps.join(several, "key")
    profile = reps.groupBy("key", "name", "manufacturer", "cabinet_types").agg(F.count("*").alias("copies")).withColumn("p", F.xxhash64("name", "manufacturer", "cabinet_types"))
    a, b = profile.alias("a"), profile.alias("b")
    on = (F.col("a.key") == F.col("b.key")) & ((F.col("a.p") < F.col("b.p")) | ((F.col("a.p") == F.col("b.p")) & (F.col("a.copies") > 1)))
    side = lambda s: {c: F.col(f"{s}.{c}") for c in ("name", "manufacturer", "cabinet_types")}
    scores = a.join(b, on).select(F.col("a.key").alias("key"), review_score(side("a"), side("b")).alias("score")).groupBy("key").agg(F.min("score").alias("min_score"))
    return reps.join(scores.where(F.col("min_score") >= CLUSTER_LEAST), "key")


def review_candidates(groups: DataFrame) -> DataFrame:
    """One row per cluster with id, score, affected placements and priority."""
    from placekeep.operators.identity import source_id, source_name

    tagged = groups.withColumn("tag", F.concat_ws(":", source_name(F.col("game_id")), source_id(F.col("game_id")).cast("string")))
    rows = tagged.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("active_placement_count")).alias("o"), "game_id", "tag"))).alias("m"), F.min("min_score").alias("s"), F.sum("active_placement_count").alias("affected"))
    key = F.array_join(F.transform("m", lambda x: x["tag"]), ":")
    score = F.round("s", 1)
    return rows.select(X.hashed_id(key).alias("candidate_id"), key.alias("cluster_key"), F.size("m").alias("members"), score.alias("match_score"), F.col("affected").alias("affected_placements"), F.round(score * (1 + F.sqrt("affected")), 2).alias("priority_score"))


