"""Chains of operators: imports, machine merges, scans, rosters, publication, and their order."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placekeep.functions import text as X
from placekeep.model import Places
from placekeep.operators import blocking, identity, matching, upsert
from placekeep.plans import rosters, snapshot
from placekeep.session import checkpointed, ship_package

#: Thresholds of the machine merge.
MERGE = 0.96


@dataclass(frozen=True)
class Step:
    name: str
    phase: str
    arguments: tuple[str, ...] = ()


PHASES = ("source-sync", "validation", "curation", "maintenance", "build")


def plan_steps(states: tuple[str, ...] = (), apply: bool = False, skip: tuple[str, ...] = (), sources: tuple[str, ...] = ("source_a", "source_b")) -> list[Step]:
    """The steps of a full run in order; nothing is run."""
    scope = ("--states", ",".join(states)) if states else ("--all-states",)
    do = ("--apply",) if apply else ()
    steps = [Step(f"import_{s}", "source-sync", (*scope, *do)) for s in sources]
    steps += [Step(f"validate_{s}", "validation", (*scope, *do)) for s in sources]
    steps += [Step("merge_machines", "curation", (*scope, *do)), Step("canonicalize", "curation", do), Step("review_duplicates", "curation", do)]
    steps += [Step("compact", "maintenance", do), Step("export", "maintenance", ())]
    steps += [Step("snapshot", "build", ()), Step("dashboard", "build", ())]
    return [s for s in steps if s.phase not in skip and s.name not in skip]


def import_bundle(
    p: Places,
    bundle: dict[str, DataFrame],
    links: DataFrame,
    at: str,
    offset=identity.a_id,
    overrides: DataFrame | None = None,
    skip_ambiguous: bool = True,
    insert_locations: bool = True,
    insert_games: bool = True,
) -> dict[str, DataFrame]:
    """Next locations, games, location_games and links after an import, with ``review`` and ``stats`` (metric, value).

    A place is linked by ``overrides`` (source_id, location_id) to a known
    place, else by earlier links, else by a match among places of positive ids;
    else it gets the id made from its source id, whether that is known already
    or new. Candidates in the review band are ``review`` and, unless
    ``skip_ambiguous`` is false, left out. Items match those of positive ids.
    Existing values are filled, never overwritten; counts of known places stay.
    """
    incoming = bundle["locations"].dropDuplicates(["source_id"])
    native = p.locations.where("location_id > 0")
    known_ids = p.locations.select(F.col("location_id").alias("_made"), F.lit(True).alias("_there"))
    earlier = links.groupBy("source_id").agg(F.min("location_id").alias("_linked"))
    known = incoming.join(earlier, "source_id", "left")
    if overrides is None:
        known = known.withColumn("_hand", F.lit(None).cast("long"))
    else:
        by_hand = overrides.join(p.locations.select("location_id"), "location_id", "left_semi").groupBy("source_id").agg(F.min("location_id").alias("_hand"))
        known = known.join(by_hand, "source_id", "left")
    matches = matching.place_matches(known.where("_linked IS NULL AND _hand IS NULL").drop("_linked", "_hand"), native)
    placed = known.join(matches.select("source_id", F.col("location_id").alias("_match"), "confidence", "band"), "source_id", "left")
    placed = placed.withColumn("_made", offset(F.col("source_id"))).join(known_ids, "_made", "left")
    fate = (
        F.when(F.col("_hand").isNotNull(), "manual_override")
        .when(F.col("_linked").isNotNull(), "linked")
        .when(F.col("band") == "match", "fuzzy_name_address")
        .when((F.col("band") == "review") & F.lit(skip_ambiguous), "skipped")
        .when(F.col("_there"), "reused")
        .otherwise("new" if insert_locations else "skipped")
    )
    target = F.when(F.col("method") == "fuzzy_name_address", F.col("_match")).otherwise(F.coalesce("_hand", "_linked", "_made"))
    placed = checkpointed(placed.withColumn("method", fate).withColumn("location_id", target))
    review = placed.where("band = 'review'").select("source_id", F.col("_match").alias("location_id"), "confidence")
    placed, skipped = placed.where("method <> 'skipped'"), placed.where("method = 'skipped'")
    columns = [c for c in p.locations.columns if c in placed.columns and c != "game_count"]
    locations = upsert.upsert(p.locations, placed.select(*columns).dropDuplicates(["location_id"]), ["location_id"], {})
    machines = bundle["machines"].dropDuplicates(["machine_id"])
    found = matching.item_matches(machines.select(F.col("machine_id").alias("source_id"), "name", "manufacturer"), p.games.where("game_id > 0"))
    own = machines.join(found.select(F.col("source_id").alias("machine_id"), F.col("game_id").alias("_match")), "machine_id", "left").withColumn("_made", offset(F.col("machine_id")))
    own = own.join(p.games.select(F.col("game_id").alias("_made"), F.lit(True).alias("_there")), "_made", "left")
    kind = F.when(F.col("_match").isNotNull(), "matched").when(F.col("_there"), "reused").otherwise("inserted" if insert_games else "skipped")
    own = checkpointed(own.withColumn("kind", kind).withColumn("game_id", F.coalesce("_match", "_made")))
    machines = own.where("kind <> 'skipped'")
    games = upsert.upsert(p.games, machines.select("game_id", "name", "manufacturer").dropDuplicates(["game_id"]), ["game_id"], {})
    at_places = bundle["placements"].join(placed.select("source_id", "location_id"), "source_id").join(machines.select("machine_id", "game_id", "year"), "machine_id")
    rows = at_places.select("location_id", "game_id", F.lit("Pinball").alias("cabinet_type"), "year").dropDuplicates(["location_id", "game_id"])
    fresh = checkpointed(rows.join(p.location_games, ["location_id", "game_id"], "left_anti"))
    new_links = placed.select("location_id", "source_id", F.when(F.col("method") == "fuzzy_name_address", F.col("confidence")).otherwise(1.0).alias("confidence"), "method", F.lit(at).alias("linked_at"))
    all_links = upsert.upsert(links, new_links, ["location_id", "source_id"], {}, default="old")
    fates = {"manual_override": "matched", "linked": "matched", "fuzzy_name_address": "matched", "reused": "reused", "new": "inserted", "skipped": "skipped"}
    named = F.create_map(*[F.lit(x) for kv in fates.items() for x in kv])
    places = placed.select("method").unionByName(skipped.select("method")).select(F.concat(F.lit("locations_"), named[F.col("method")]).alias("metric"))
    counted = places.unionByName(own.select(F.concat(F.lit("games_"), "kind").alias("metric"))).unionByName(fresh.select(F.lit("placements_inserted").alias("metric")))
    stats = counted.groupBy("metric").agg(F.count("*").alias("value"))
    return {"locations": locations, "games": games, "location_games": p.location_games.unionByName(fresh.select(*p.location_games.columns)), "links": all_links, "review": review, "stats": stats}


#: Ratio of names below which no share of words lifts the score to MERGE.
MERGE_RATIO = (MERGE - 0.35) / 0.65


def _merge_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct (name, known, score) of names (name, form, plain) whose merge score is at least MERGE; none is left out."""
    plain = lambda df: df.select(F.col("plain").alias("form"), F.lit(0).alias("part"))
    a, b = left.select(*[F.col(c).alias(f"a_{c}") for c in ("name", "form", "plain")]), right.select(*[F.col(c).alias(f"b_{c}") for c in ("name", "form", "plain")])
    equal = a.join(b, F.col("a_form") == F.col("b_form")).where("a_form <> ''").select(F.col("a_name").alias("name"), F.col("b_name").alias("known"), F.lit(1.0).alias("score"))
    near = blocking.alike_candidates(plain(left), plain(right), MERGE_RATIO, contained=False).select(F.col("a").alias("a_plain"), F.col("b").alias("b_plain"))
    met = checkpointed(a.join(near, "a_plain").join(b, "b_plain").where("a_form <> b_form"))
    alike = matching.with_merge_score(met, "a_name", "b_name", "a_form", "b_form").where(F.col("score") >= MERGE)
    return checkpointed(equal.unionByName(alike.select(F.col("a_name").alias("name"), F.col("b_name").alias("known"), "score")).distinct())


def _made_names(first: DataFrame, pairs: DataFrame) -> DataFrame:
    """Names that become items of their own: in order of first appearance, those that no earlier such name is like.

    Rounds decide all names whose earlier likes are decided, so that no task
    sees all names; there are as many rounds as a chain of likes is long.
    """
    rest = checkpointed(first.select("name", "at"))
    ahead = pairs.join(first.select("name", "at"), "name").join(first.select(F.col("name").alias("known"), F.col("at").alias("before")), "known").where("before < at").select("name", "known")
    ahead = checkpointed(ahead)
    made = first.select("name").where("false")
    while not rest.isEmpty():
        open_ahead = ahead.join(rest.select(F.col("name").alias("known")), "known", "left_semi")
        fresh = checkpointed(rest.join(open_ahead.select("name").distinct(), "name", "left_anti").select("name"))
        made = made.unionByName(fresh)
        covered = ahead.join(fresh.select(F.col("name").alias("known")), "known", "left_semi").select("name").distinct()
        rest = checkpointed(rest.join(fresh, "name", "left_anti").join(covered, "name", "left_anti"))
    return checkpointed(made)


def _decide(rows: pd.DataFrame) -> pd.DataFrame:
    """Decisions for the machines of one place, in order; what is placed joins the inventory."""
    placed: set[int] = set()
    out = []
    for r in rows.sort_values("machine_id").itertuples(index=False):
        known = [(c["score"], not c["here"], c["order"], c["game_id"]) for c in r.candidates if c["here"] or c["game_id"] in placed]
        if known:
            best = min(known, key=lambda c: (-c[0], *c[1:]))
            out.append((best[3], best[0], "duplicate_local_inventory"))
            continue
        best = min(((-c["score"], c["order"], c["game_id"]) for c in r.candidates), default=None)
        if best is None:
            out.append((r.own, 1.0, "source_only_game"))
        else:
            out.append((best[2], -best[0], "matched_existing_game"))
        placed.add(out[-1][0])
    decided = pd.DataFrame(out, columns=["game_id", "confidence", "method"], index=rows.sort_values("machine_id").index)
    keep = ["location_id", "source_id", "machine_id", "source_game_id", "name", "cabinet_type"]
    return pd.concat([rows.loc[decided.index, keep], decided], axis=1)


def merge_machines(links: DataFrame, machines: DataFrame, placements: DataFrame, games: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """Decision for each machine of linked directory entries.

    ``links``: location_id, source_id; ``machines``: source_id, machine_id,
    source_game_id, name, genre. In order of place and machine: a machine whose
    name is like one in the place's inventory is a duplicate; else the best
    known item is taken, among them those made for earlier machines; else the
    directory's own item is made. What is placed joins the place's inventory.
    Likeness is found once for each name; places are decided side by side, each
    in a group of its own machines.
    """
    rows = links.select("location_id", "source_id").join(machines, "source_id")
    if merged is not None:
        rows = rows.join(merged.select("location_id", "machine_id"), ["location_id", "machine_id"], "left_anti")
    rows = checkpointed(rows)
    forms = lambda df: df.select("name").where("name IS NOT NULL").distinct().withColumn("form", X.merge_name(F.col("name"))).withColumn("plain", X.import_name(F.col("name")))
    wanted = checkpointed(forms(rows))
    known = _merge_pairs(wanted, forms(games))
    unknown = wanted.join(known.select("name").distinct(), "name", "left_anti")
    first = rows.groupBy("name").agg(F.min(F.struct("location_id", "machine_id", "source_game_id")).alias("at")).join(unknown.select("name"), "name", "left_semi")
    among = _merge_pairs(unknown, unknown)
    made = _made_names(first, among.where("name <> known")).join(first, "name").select("name", "at", identity.b_id(F.col("at.source_game_id")).alias("game_id"))
    # Items of one source id are one item, made at its first machine.
    made = made.groupBy("game_id").agg(F.min("at").alias("at"), F.collect_set("name").alias("names")).select("game_id", "at", F.explode("names").alias("known"))
    old = known.join(games.select("game_id", F.col("name").alias("known")), "known").select("name", "game_id", "score", F.lit(None).cast("struct<location_id:bigint,machine_id:bigint,source_game_id:bigint>").alias("since"))
    likes_made = _merge_pairs(wanted, forms(made.select(F.col("known").alias("name")))).join(made, "known").select("name", "game_id", "score", F.col("at").cast("struct<location_id:bigint,machine_id:bigint,source_game_id:bigint>").alias("since"))
    every = old.unionByName(likes_made).groupBy("name", "game_id").agg(F.max("score").alias("score"), F.min("since").alias("since"))
    here = placements.select("location_id", "game_id", F.lit(True).alias("here")).distinct()
    at = F.struct(F.col("location_id").cast("long").alias("location_id"), F.col("machine_id").cast("long").alias("machine_id"))
    since = F.struct("since.location_id", "since.machine_id")
    # Known items come before made ones, those before later made ones.
    order = F.when(F.col("since").isNull(), F.struct(F.lit(-(2**62)).alias("l"), F.lit(0).cast("long").alias("m"), "game_id")).otherwise(F.struct(F.col("since.location_id").alias("l"), F.col("since.machine_id").alias("m"), "game_id"))
    met = rows.select("location_id", "machine_id", "name").distinct().join(every, "name").where(F.col("since").isNull() | (since < at)).join(here, ["location_id", "game_id"], "left")
    found = met.select("location_id", "machine_id", "name", F.struct("game_id", "score", F.coalesce("here", F.lit(False)).alias("here"), order.alias("order")).alias("c"))
    # All items that a name is like go along, also those elsewhere: which of them count depends on what the place has got by then.
    lists = found.groupBy("location_id", "machine_id", "name").agg(F.array_sort(F.collect_list("c")).alias("candidates"))
    lists = lists.withColumn("candidates", F.expr("transform(candidates, (c, i) -> named_struct('game_id', c.game_id, 'score', c.score, 'here', c.here, 'order', cast(size(filter(candidates, x -> x.order < c.order)) as bigint)))"))
    empty = F.from_json(F.lit("[]"), "array<struct<game_id:bigint,score:double,here:boolean,order:bigint>>")
    full = rows.join(lists, ["location_id", "machine_id", "name"], "left").select("location_id", "source_id", "machine_id", "source_game_id", "name", F.col("genre").alias("cabinet_type"), F.coalesce(F.col("candidates").cast("array<struct<game_id:bigint,score:double,here:boolean,order:bigint>>"), empty).alias("candidates"), identity.b_id(F.col("source_game_id")).alias("own"))
    kinds = dict(full.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("location_id", "source_id", "machine_id", "source_game_id", "name", "cabinet_type")) + ", game_id long, confidence double, method string"
    ship_package(full.sparkSession)
    return full.groupBy("location_id").applyInPandas(_decide, schema).withColumn("confidence", F.round("confidence", 3))


def apply_machines(p: Places, decisions: DataFrame, at: str) -> dict[str, DataFrame]:
    """Next snapshots of games, placements and places after a merge."""
    made = decisions.where("method = 'source_only_game'").groupBy("game_id").agg(F.min("name").alias("name")).withColumn("manufacturer", F.lit(None).cast("string"))
    games = upsert.append_if_new(p.games, made, ["game_id"])
    rows = decisions.where("method <> 'duplicate_local_inventory'").groupBy("location_id", "game_id").agg(F.min("cabinet_type").alias("cabinet_type")).withColumn("year", F.lit(None).cast("long"))
    placements = upsert.append_if_new(p.location_games, rows, ["location_id", "game_id"])
    links = decisions.select("location_id", F.col("source_id").alias("source_location_id"), F.col("machine_id").alias("source_machine_id"), "source_game_id", "game_id", "confidence", "method", F.lit(at).alias("linked_at"))
    return {"games": games, "location_games": placements, "locations": upsert.recount(p.locations, placements), "links": links}


def apply_roster(p: Places, actions: DataFrame, at: str) -> dict[str, DataFrame]:
    """Adds and removes placements as rosters say, with audit rows.

    ``actions``: location_id, action (add or remove), name. Names to add are
    resolved to known items, else new items get ids below all owner-roster ones.
    """
    items = identity.items_with_counts(p)
    adds = actions.where("action = 'add'").select("location_id", "name").distinct()
    resolved = rosters.resolve_names(adds, items)
    named = adds.withColumnRenamed("name", "listed_name").join(resolved.select("listed_name", "game_id", "score"), "listed_name", "left")
    new = named.where("game_id IS NULL").select(F.col("listed_name").alias("name")).distinct()
    floor = min(-4_000_000_000, (p.games.agg(F.min("game_id")).first()[0] or 0) - 1)
    made = identity.allocate_ids(new, ["name"], p.games.where("false")).withColumn("game_id", F.lit(floor) - (F.col("game_id") - identity.FIRST_ID))
    games = p.games.unionByName(made.withColumn("manufacturer", F.lit(None).cast("string")).select(*p.games.columns))
    placed = named.join(made.select(F.col("name").alias("listed_name"), F.col("game_id").alias("_new")), "listed_name", "left").withColumn("game_id", F.coalesce("game_id", "_new"))
    mode = matching.best_per(p.location_games.where(F.coalesce("cabinet_type", F.lit("")) != "").groupBy("game_id", "cabinet_type").count(), "game_id", F.desc("count"), F.col("cabinet_type")).select("game_id", "cabinet_type")
    rows = placed.select("location_id", "game_id").distinct().join(mode, "game_id", "left").withColumn("year", F.lit(None).cast("long"))
    removed = actions.where("action = 'remove'").join(p.games, "name").select("location_id", "game_id").distinct()
    kept = p.location_games.join(removed, ["location_id", "game_id"], "left_anti")
    placements = upsert.append_if_new(kept.select(*p.location_games.columns), rows, ["location_id", "game_id"])
    audit = placed.select("location_id", F.lit("add").alias("action"), F.col("listed_name").alias("name"), "game_id", "score", F.lit(at).alias("applied_at")).unionByName(
        actions.where("action = 'remove'").join(p.games, "name").select("location_id", F.lit("remove").alias("action"), "name", "game_id", F.lit(None).cast("double").alias("score"), F.lit(at).alias("applied_at"))
    )
    return {"games": games, "location_games": placements, "locations": upsert.recount(p.locations, placements), "audit": audit}


def canonicalize(p: Places) -> DataFrame:
    """The canonical links after proposing and applying new ones."""
    proposed = matching.proposed_links(identity.items_with_counts(p)).select("alias_game_id", "canonical_game_id", "confidence", "reason")
    return upsert.apply_links(p.canonical_links, proposed)


def publish(p: Places, store: upsert.Snapshots, at: str) -> dict:
    """Writes the published snapshot in one step; gives its manifest: time, folders and rows of each table."""
    store.commit({"route_locations": snapshot.route_locations(p), "location_games": snapshot.location_games(p)}, at)
    return store.manifest()
