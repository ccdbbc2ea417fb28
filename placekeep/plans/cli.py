"""Canned questions about places and items. Each takes a ``Places`` and returns a DataFrame.

Orders put nulls last and end in an id, so that limits are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placekeep.functions import predicates as P
from placekeep.functions.geo import within_radius
from placekeep.functions.similarity import search_score
from placekeep.model import Places
from placekeep.operators.identity import one_hop
from placekeep.operators.text_index import TextIndex

#: Least scores of the fuzzy tiers, and of a resolved place.
PLACE_SCORE, ITEM_SCORE, RESOLVED_SCORE, GONE_MARGIN = 0.62, 0.68, 0.72, 0.08
#: Fixed value: places of this size stay in the review queue.
QUEUE_SIZE = 25


def nulls_last(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def with_status(p: Places, df: DataFrame) -> DataFrame:
    """Adds status and replacement_name where there is a status table."""
    if p.statuses is None:
        return df
    return df.join(p.statuses.select("location_id", "status", "replacement_name"), "location_id", "left").withColumn("status", F.coalesce("status", F.lit("active")))


def places(p: Places, include_inactive: bool = False) -> DataFrame:
    """Places in scope, active ones unless asked otherwise."""
    df = with_status(p, p.locations.where(P.in_scope(F.col("state"), p.scope)))
    return df if include_inactive or p.statuses is None else df.where(P.is_active(F.col("status")))


def _status_columns(p: Places) -> list[str]:
    return [] if p.statuses is None else ["status", "replacement_name"]


def summary(p: Places, state: str, include_inactive: bool = False) -> DataFrame:
    """Counts as (metric, value); one aggregation for each table."""
    active = places(p, include_inactive).select("location_id", F.lit(1).alias("_on"))
    marked = p.locations.select("location_id", "state").join(active, "location_id", "left")
    on, here = F.col("_on").isNotNull(), F.col("state") == state
    pinball = F.col("cabinet_type") == "Pinball"
    placed = p.location_games.join(active, "location_id", "left")

    def counts(df: DataFrame, **metrics: Column) -> DataFrame:
        row = df.agg(*[F.count_if(c).alias(n) for n, c in metrics.items()])
        return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics])).alias("m")).select("m.metric", "m.value")

    every = F.lit(True)
    out = counts(
        marked,
        locations=every,
        active_locations=on,
        locations_in_state=here,
        active_locations_in_state=on & here,
        source_a_locations=P.in_source_a(F.col("location_id")),
        source_b_locations=P.in_source_b(F.col("location_id")),
    )
    out = out.unionByName(counts(p.games, games=every, source_a_games=P.in_source_a(F.col("game_id")), source_b_games=P.in_source_b(F.col("game_id"))))
    out = out.unionByName(counts(placed, location_games=every, active_location_games=on, pinball_rows=pinball, active_pinball_rows=pinball & on))
    return out if p.canonical_links is None else out.unionByName(counts(p.canonical_links, canonical_links=every))


def city_summary(p: Places, state: str, limit: int, include_inactive: bool = False) -> DataFrame:
    df = places(p, include_inactive).where(F.col("state") == state).groupBy(F.coalesce("city", F.lit("")).alias("city"), "state")
    out = df.agg(F.count("*").alias("locations"), F.sum(F.coalesce("game_count", F.lit(0))).alias("listed_games"), F.count_if(F.col("location_id") < 0).alias("other_source_locations"))
    return out.orderBy(F.desc("listed_games"), F.desc("locations"), "city").limit(limit)


PLACE_COLUMNS = ["location_id", "name", "type", "city", "state", "street_address", "postal_code", "game_count", "source_url"]


def _place_texts() -> list[Column]:
    """What a fuzzy search compares: the name, and the name with its city and street."""
    name, city, street = (F.coalesce(c, F.lit("")) for c in ("name", "city", "street_address"))
    return [name, F.concat_ws(" ", name, city, street)]


def _item_texts() -> list[Column]:
    name, maker = (F.coalesce(c, F.lit("")) for c in ("name", "manufacturer"))
    return [name, F.concat_ws(" ", name, maker)]


def place_index(p: Places, folder: str, include_inactive: bool = False) -> TextIndex:
    """Stored index for :func:`search_places` over the same places, with or without inactive ones."""
    return TextIndex.build(places(p, include_inactive), ["location_id"], _place_texts(), folder)


def item_index(p: Places, folder: str) -> TextIndex:
    """Stored index for :func:`search_items` over the canonical items."""
    items = one_hop(p.games, p.canonical_links).select(F.col("canonical_game_id").alias("game_id"), F.col("canonical_name").alias("name"), F.col("canonical_manufacturer").alias("manufacturer"))
    return TextIndex.build(items.distinct(), ["game_id", "name", "manufacturer"], _item_texts(), folder)


def _fuzzy(rest: DataFrame, query: str, texts: list[Column], least: float, limit: int, index: TextIndex | None) -> DataFrame:
    """Rows of ``rest`` of at least that score, as ``_score``; with an index its best ones, at least ``limit`` if fewer than that were found exactly."""
    if index is None:
        return rest.withColumn("_score", F.greatest(*[search_score(F.lit(query), t) for t in texts])).where(F.col("_score") >= least)
    asked = rest.sparkSession.range(1).select(F.col("id").alias("question_id"), F.lit(query).alias("question"))
    near = index.search(asked, 2 * limit, least).drop("question_id").withColumnRenamed("score", "_score")
    same = F.lit(True)
    for key in index.keys:
        near = near.withColumnRenamed(key, f"_{key}")
        same &= rest[key].eqNullSafe(near[f"_{key}"])
    return rest.join(near, same).drop(*[f"_{k}" for k in index.keys])


def search_places(p: Places, query: str, limit: int, include_inactive: bool = False, fuzzy: bool = True, index: TextIndex | None = None) -> DataFrame:
    """Places whose name, city or street contain the query; alike ones fill up to the limit.

    An ``index`` of :func:`place_index` spares scoring all places; the rows are the same.
    """
    df = places(p, include_inactive).select(*PLACE_COLUMNS, *_status_columns(p))
    hit = P.contains_text([F.col("name"), F.col("city"), F.col("street_address")], query) & F.col("name").isNotNull()
    exact = F.when(F.lower("name") == query.lower(), 0).otherwise(1)
    tiers = df.where(hit).withColumn("_tier", exact).withColumn("_score", F.lit(1.0))
    if fuzzy:
        tiers = tiers.unionByName(_fuzzy(df.where(~hit), query, _place_texts(), PLACE_SCORE, limit, index).withColumn("_tier", F.lit(2)))
    return tiers.orderBy("_tier", F.desc("_score"), F.col("game_count").desc_nulls_last(), nulls_last("name"), "location_id").limit(limit).drop("_tier", "_score")


def items_with_places(p: Places, state: str, include_inactive: bool = False) -> DataFrame:
    """Canonical items with the placements (not places) at active places."""
    at = p.location_games.join(places(p, include_inactive).select("location_id", F.col("state").alias("_state"), F.lit(True).alias("_on")), "location_id", "left")
    counts = at.groupBy("game_id").agg(F.count_if("_on").alias("_all"), F.count_if(F.col("_on") & (F.col("_state") == state)).alias("_here"))
    return one_hop(p.games, p.canonical_links).join(counts, "game_id", "left")


def _grouped_items(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("canonical_game_id").alias("game_id"), F.col("canonical_name").alias("name"), F.col("canonical_manufacturer").alias("manufacturer")).agg(
        F.countDistinct("game_id").alias("source_game_rows"), F.coalesce(F.sum("_all"), F.lit(0)).alias("location_count"), F.coalesce(F.sum("_here"), F.lit(0)).alias("state_location_count")
    )


def search_items(p: Places, query: str, state: str, limit: int, include_inactive: bool = False, fuzzy: bool = True, index: TextIndex | None = None) -> DataFrame:
    """Canonical items whose names or makers contain the query; alike ones fill up to the limit.

    An ``index`` of :func:`item_index` spares scoring all items; the rows are the same.
    """
    df = items_with_places(p, state, include_inactive)
    hit = P.contains_text([F.col(c) for c in ("source_name", "canonical_name", "source_manufacturer", "canonical_manufacturer")], query)
    tiers = _grouped_items(df.where(hit)).withColumn("_tier", F.lit(0)).withColumn("_score", F.lit(1.0))
    if fuzzy:
        rest = _grouped_items(df).join(tiers.select("game_id"), "game_id", "left_anti")
        alike = _fuzzy(rest, query, _item_texts(), ITEM_SCORE, limit, index)
        tiers = tiers.unionByName(alike.withColumn("_tier", F.lit(1)), allowMissingColumns=True)
    return tiers.orderBy("_tier", F.desc("_score"), F.desc("state_location_count"), F.desc("location_count"), nulls_last("name"), "game_id").limit(limit).drop("_tier", "_score")


def where_to_find(p: Places, query: str, home_state: str, limit: int, state: str | None = None, include_inactive: bool = False, candidates: int = 8, fuzzy: bool = True) -> DataFrame:
    """Placements of the best matching items."""
    wanted = search_items(p, query, home_state, candidates, include_inactive, fuzzy).select(F.col("game_id").alias("canonical_game_id"))
    at = places(p, include_inactive)
    at = at if state is None else at.where(F.col("state") == state)
    found = one_hop(p.games, p.canonical_links).join(wanted, "canonical_game_id", "left_semi")
    rows = p.location_games.join(found, "game_id").join(at.withColumnRenamed("name", "location").select("location_id", "location", "city", "state", "street_address", "source_url", *_status_columns(p)), "location_id")
    return (
        rows.orderBy(*[nulls_last(c) for c in ("state", "city", "location", "canonical_name", "location_id", "game_id", "year", "cabinet_type")])
        .limit(limit)
        .select("location_id", "location", "city", "state", "street_address", F.col("canonical_name").alias("game"), F.col("canonical_manufacturer").alias("manufacturer"), F.col("source_name").alias("source_game"), "year", "cabinet_type", "source_url", *_status_columns(p))
    )


def best_place(p: Places, query: str, include_inactive: bool = False) -> DataFrame:
    """The place that the query names (one row or none).

    A gone place that fits clearly better means none.
    """

    def best(df: DataFrame) -> DataFrame:
        scored = df.withColumn("score", search_score(F.lit(query), F.coalesce("name", F.lit(""))))
        return scored.orderBy(F.desc("score"), F.coalesce("game_count", F.lit(0)).desc(), "location_id").limit(1)

    found = best(search_places(p, query, 10, include_inactive)).where(F.col("score") >= RESOLVED_SCORE)
    if include_inactive or p.statuses is None:
        return found
    gone = best(search_places(p, query, 10, True).where(~P.is_active(F.col("status")))).select(F.col("score").alias("_gone"))
    # Both sides have one row at most.
    return found.join(F.broadcast(gone), F.col("_gone") > F.col("score") + GONE_MARGIN, "left_anti")


def inventory_of(p: Places, place: DataFrame, limit: int) -> DataFrame:
    """Source items at the places of ``place`` (location_id), pinball first."""
    rows = p.location_games.join(F.broadcast(place.select("location_id")), "location_id").join(p.games.withColumnRenamed("name", "game"), "game_id")
    first = F.when(F.col("cabinet_type") == "Pinball", 0).otherwise(1)
    return rows.orderBy(first, *[nulls_last(c) for c in ("game", "game_id", "year", "cabinet_type")]).limit(limit).select("game", "manufacturer", "year", "cabinet_type", "game_id")


def inventory(p: Places, query: str, limit: int, include_inactive: bool = False) -> DataFrame:
    return inventory_of(p, best_place(p, query, include_inactive), limit)


def compare_places(p: Places, left: DataFrame, right: DataFrame, limit: int) -> DataFrame:
    """Shared and unshared placements of two places (location_id); repeated placements stay repeated."""
    named = one_hop(p.games, p.canonical_links).select("game_id", F.col("canonical_game_id").alias("_id"), F.col("canonical_name").alias("name"), F.col("canonical_manufacturer").alias("manufacturer"))

    def games_of(place: DataFrame) -> DataFrame:
        return p.location_games.join(F.broadcast(place.select("location_id")), "location_id", "left_semi").join(named, "game_id").select(F.col("_id").alias("game_id"), "name", "manufacturer")

    a, b = games_of(left), games_of(right)
    parts = [a.join(b, "game_id", "left_semi").withColumn("bucket", F.lit("shared")), a.join(b, "game_id", "left_anti").withColumn("bucket", F.lit("only_left")), b.join(a, "game_id", "left_anti").withColumn("bucket", F.lit("only_right"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("bucket", "name", "manufacturer", "game_id").orderBy("bucket", nulls_last("name"), "game_id").limit(limit)


def rare_items(p: Places, most: int, limit: int, state: str | None = None, include_inactive: bool = False) -> DataFrame:
    """Canonical items at ``most`` or fewer distinct places in scope."""
    at = places(p, include_inactive)
    at = at if state is None else at.where(F.col("state") == state)
    named = one_hop(p.games, p.canonical_links)
    scoped = p.location_games.select("location_id", "game_id").join(at.select("location_id"), "location_id").join(named, "game_id")
    counted = scoped.groupBy(F.col("canonical_game_id").alias("game_id"), F.col("canonical_name").alias("name"), F.col("canonical_manufacturer").alias("manufacturer")).agg(F.countDistinct("location_id").alias("location_count"))
    return counted.where(F.col("location_count") <= most).orderBy("location_count", nulls_last("name"), "game_id").limit(limit)


def nearby(p: Places, lat: float, lon: float, miles: float, limit: int, include_inactive: bool = False) -> DataFrame:
    near = within_radius(places(p, include_inactive), lat, lon, miles).withColumn("miles", F.round("exact_miles", 2))
    out = near.orderBy("miles", F.coalesce("game_count", F.lit(0)).desc(), nulls_last("name"), "location_id").limit(limit)
    return out.select("miles", "location_id", "name", "type", "city", "state", "street_address", "game_count", "source_url", *_status_columns(p))


def read_only(sql: str) -> str:
    """The statement without blanks around it; ValueError unless it begins as a reading statement does."""
    text = sql.strip()
    if not text.lower().startswith(("select", "with", "pragma")):
        raise ValueError("the statement must start with SELECT, WITH or PRAGMA")
    return text


#: Kinds of parsed nodes that write, set or cache, with all that extend them.
WRITING = ("org.apache.spark.sql.catalyst.plans.logical.Command", "org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")


def checked_statement(spark: SparkSession, sql: str) -> str:
    """The statement, if the session's parser finds one that only reads; ValueError else.

    Nothing is run: ``spark.sql`` would carry out a command before its plan
    could be looked at. Every node is looked at, those of common tables as well.
    """
    text = read_only(sql)
    try:
        todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(text)]
    except Exception as e:
        raise ValueError(f"not one reading statement: {str(e).splitlines()[0]}") from e
    loader = spark._jvm.Thread.currentThread().getContextClassLoader()
    writing = [loader.loadClass(c) for c in WRITING]
    while todo:
        node = todo.pop()
        if any(kind.isInstance(node) for kind in writing):
            raise ValueError(f"the statement must read, not {node.nodeName()}")
        for below in (node.children(), node.innerChildren(), node.subqueries()):
            todo += [x for x in (below.apply(i) for i in range(below.size())) if hasattr(x, "innerChildren")]
    return text


def raw_sql(spark: SparkSession, sql: str, limit: int | None = None) -> DataFrame:
    """Runs one reading statement; all others are refused before anything is run."""
    df = spark.sql(checked_statement(spark, sql))
    return df if limit is None else df.limit(limit)


def inactive_places(p: Places, limit: int, state: str | None = None) -> DataFrame:
    """Places with a status off the allow-list; not limited to the scope."""
    rows = p.statuses.where(~F.col("status").isin(*P.ACTIVE)).join(p.locations, "location_id")
    rows = rows if state is None else rows.where(F.col("state") == state)
    return rows.orderBy(*[nulls_last(c) for c in ("state", "city", "name", "location_id")]).limit(limit).select("location_id", "name", "city", "state", "street_address", "game_count", "status", "replacement_name", "confidence", "verified_at", "evidence")


def latest(verifications: DataFrame, *keys: str, typed: bool = False) -> DataFrame:
    """The latest evidence of each group; ``typed`` compares times instead of texts."""
    at = F.try_to_timestamp("checked_at") if typed else F.col("checked_at")
    w = Window.partitionBy(*keys).orderBy(at.desc_nulls_last(), F.col("verification_id").desc_nulls_last())
    return verifications.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def verification_report(p: Places, limit: int, state: str | None = None) -> DataFrame:
    last = latest(p.verifications, "location_id").withColumnRenamed("status", "_last").withColumnRenamed("confidence", "_confidence")
    rows = last.join(p.locations, "location_id").join(p.statuses.select("location_id", F.col("status").alias("_curated"), "replacement_name"), "location_id", "left")
    rows = rows if state is None else rows.where(F.col("state") == state)
    rows = rows.withColumn("status", F.coalesce("_curated", "_last"))
    out = rows.orderBy(P.status_rank(F.col("status")), F.col("_confidence").desc_nulls_last(), nulls_last("name"), "location_id").limit(limit)
    return out.select("location_id", "name", "city", "state", "street_address", "status", "provider", "match_kind", F.col("_confidence").alias("confidence"), "checked_at", "replacement_name")


def source_coverage(p: Places, limit: int, state: str | None = None, dedupe_links: bool = False) -> DataFrame:
    """Places by source and state. As in the canned question, a place with several links counts its items once for each, unless ``dedupe_links``."""
    key = F.col("location_id")

    def ids(links: DataFrame, name: str) -> DataFrame:
        df = links.select("location_id", F.col("location_id").alias(name))
        return df.distinct() if dedupe_links else df

    rows = p.locations if state is None else p.locations.where(F.col("state") == state)
    rows = rows.join(ids(p.a_links, "_a"), "location_id", "left").join(ids(p.b_links, "_b"), "location_id", "left")
    out = rows.groupBy("state").agg(
        F.countDistinct(key).alias("locations"),
        F.countDistinct(F.when(key > 0, key)).alias("native_locations"),
        F.countDistinct(F.when(P.in_source_a(key), key)).alias("source_a_only_locations"),
        F.countDistinct(F.when(P.in_source_b(key), key)).alias("source_b_only_locations"),
        F.countDistinct("_a").alias("source_a_linked_locations"),
        F.countDistinct("_b").alias("source_b_linked_locations"),
        F.sum(F.coalesce("game_count", F.lit(0))).alias("listed_game_count"),
    )
    return out.orderBy(F.desc("locations"), nulls_last("state")).limit(limit)


def duplicate_leads(active: DataFrame, limit: int, state: str | None = None) -> DataFrame:
    """Pairs of active places in one city that share a name or a street address."""
    rows = active.where(F.coalesce("state", F.lit("")) != "")
    rows = rows if state is None else rows.where(F.col("state") == state)
    a, b = rows.alias("a"), active.alias("b")
    text = lambda c: F.coalesce(c, F.lit(""))
    near = (text(F.col("a.state")) == text(F.col("b.state"))) & (text(F.col("a.city")) == text(F.col("b.city"))) & (F.col("b.location_id") > F.col("a.location_id"))
    same = lambda c: F.lower(f"a.{c}") == F.lower(f"b.{c}")
    sides = [F.col(f"{s}.{c}").alias(f"{t}_{n}") for s, t in (("a", "left"), ("b", "right")) for c, n in (("location_id", "id"), ("name", "name"), ("street_address", "address"))]
    pairs = lambda on: a.join(b, near & on).select("a.state", "a.city", *sides)
    # Two joins on equal values; pairs of both kinds come from the first.
    out = pairs(same("name")).unionByName(pairs(same("street_address") & ~F.coalesce(same("name"), F.lit(False))))
    return out.orderBy(*[nulls_last(c) for c in ("state", "city", "left_name", "left_id", "right_id")]).limit(limit)


def review_queue(p: Places, limit: int, state: str | None = None) -> DataFrame:
    """Active places that were never checked or are large, unchecked ones first."""
    last = latest(p.verifications, "location_id", "provider").groupBy("location_id").agg(F.max("checked_at").alias("last_checked_at"), F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("verification_sources"))
    rows = places(p) if state is None else places(p).where(F.col("state") == state)
    rows = rows.join(last, "location_id", "left").where(F.col("last_checked_at").isNull() | (F.coalesce("game_count", F.lit(0)) >= QUEUE_SIZE))
    rows = rows.withColumn("verification_sources", F.when(F.col("verification_sources") != "", F.col("verification_sources")))
    unchecked = F.when(F.col("last_checked_at").isNull(), 0).otherwise(1)
    out = rows.orderBy(unchecked, F.coalesce("game_count", F.lit(0)).desc(), nulls_last("state"), nulls_last("city"), nulls_last("name"), "location_id").limit(limit)
    return out.select("location_id", "name", "city", "state", "game_count", "status", "last_checked_at", "verification_sources")


def item_aliases(p: Places, limit: int, query: str | None = None) -> DataFrame:
    alias = p.games.select(F.col("game_id").alias("alias_game_id"), F.col("name").alias("alias_name"), F.col("manufacturer").alias("_am"))
    canon = p.games.select(F.col("game_id").alias("canonical_game_id"), F.col("name").alias("canonical_name"), F.col("manufacturer").alias("_cm"))
    rows = p.canonical_links.join(alias, "alias_game_id").join(canon, "canonical_game_id")
    if query:
        rows = rows.where(P.contains_text([F.col("alias_name"), F.col("canonical_name"), F.col("_am"), F.col("_cm")], query))
    out = rows.orderBy(F.col("confidence").desc_nulls_last(), nulls_last("canonical_name"), nulls_last("alias_name"), "alias_game_id").limit(limit)
    return out.select("alias_game_id", "alias_name", "canonical_game_id", "canonical_name", "confidence", "reason", "source")


def needing_verification(p: Places, ids: DataFrame, cutoff: str) -> DataFrame:
    """Those of ``ids`` whose latest check is missing or older than ``cutoff`` (texts are compared)."""
    last = p.verifications.groupBy("location_id").agg(F.max("checked_at").alias("last_checked_at"))
    return ids.select("location_id").distinct().join(last, "location_id", "left").where(F.col("last_checked_at").isNull() | (F.col("last_checked_at") < cutoff))
