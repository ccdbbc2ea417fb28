"""Canonical identity of items, and of their source records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placekeep.functions.predicates import A_RANGE, B_RANGE, is_active
from placekeep.model import A_OFFSET, B_OFFSET, Places
from placekeep.session import by_rows, checkpointed

#: Fixed value: least id that the sequence allocates.
FIRST_ID = 10_000_000


def one_hop(games: DataFrame, links: DataFrame | None) -> DataFrame:
    """game_id with canonical_game_id, canonical_name, canonical_manufacturer, source_name, source_manufacturer."""
    source = games.select("game_id", F.col("name").alias("source_name"), F.col("manufacturer").alias("source_manufacturer"))
    if links is None:
        return source.select("game_id", F.col("game_id").alias("canonical_game_id"), F.col("source_name").alias("canonical_name"), F.col("source_manufacturer").alias("canonical_manufacturer"), "source_name", "source_manufacturer")
    hop = links.select(F.col("alias_game_id").alias("game_id"), F.col("canonical_game_id").alias("_to"))
    target = games.select(F.col("game_id").alias("_to"), F.col("name").alias("_name"), F.col("manufacturer").alias("_maker"))
    return source.join(hop, "game_id", "left").join(target, "_to", "left").select("game_id", F.coalesce("_to", "game_id").alias("canonical_game_id"), F.coalesce("_name", "source_name").alias("canonical_name"), F.coalesce("_maker", "source_manufacturer").alias("canonical_manufacturer"), "source_name", "source_manufacturer")


def transitive(links: DataFrame) -> DataFrame:
    """(alias_game_id, canonical_game_id): the end of each chain of links.

    Pointers jump to their target's target until none moves, which takes as
    many rounds as the logarithm of the longest chain. A cycle has no end; it
    raises ValueError. An alias with several links follows the smallest.
    """
    now = checkpointed(links.where("alias_game_id <> canonical_game_id").groupBy("alias_game_id").agg(F.min("canonical_game_id").alias("canonical_game_id")))
    # A chain of n links ends within log2(n) rounds; what still moves then is a cycle.
    rounds = now.count().bit_length() + 1
    while True:
        ahead = now.select(F.col("alias_game_id").alias("canonical_game_id"), F.col("canonical_game_id").alias("_next"))
        moved = now.join(ahead, "canonical_game_id", "left")
        if moved.where("_next IS NOT NULL").isEmpty():
            return now.select("alias_game_id", "canonical_game_id")
        now = checkpointed(moved.select("alias_game_id", F.coalesce("_next", "canonical_game_id").alias("canonical_game_id")))
        rounds -= 1
        if not rounds or not now.where("alias_game_id = canonical_game_id").isEmpty():
            raise ValueError("cycle in canonical links")


def source_rank(key: Column) -> Column:
    """0 for native ids, 1 and 2 for the two other sources, 3 for all else."""
    return F.when(key > 0, 0).when(key.between(*A_RANGE), 1).when(key.between(*B_RANGE), 2).otherwise(3)


def source_name(key: Column) -> Column:
    return F.when(key > 0, "native").when(key.between(*A_RANGE), "source_a").when(key.between(*B_RANGE), "source_b").otherwise("owner_roster")


def source_id(key: Column) -> Column:
    """The id in its own source."""
    return F.when(key.between(*A_RANGE), -key - A_OFFSET).when(key.between(*B_RANGE), -key - B_OFFSET).otherwise(F.abs(key))


def a_id(key: Column) -> Column:
    return -(key.cast("long") + F.lit(A_OFFSET))


def b_id(key: Column) -> Column:
    return -(key.cast("long") + F.lit(B_OFFSET))


def items_with_counts(p: Places) -> DataFrame:
    """Each item with the places that have it, and the active ones of them."""
    at = p.location_games.select("game_id", "location_id").where("location_id IS NOT NULL")
    status = at if p.statuses is None else at.join(p.statuses.select("location_id", "status"), "location_id", "left")
    on = F.lit(True) if p.statuses is None else is_active(F.col("status"))
    # Pairs stay in the parts of their items, so the rows are shuffled once.
    pairs = by_rows(status.select("game_id", "location_id", on.alias("_on")), "game_id", counted=p.location_games).groupBy("game_id", "location_id").agg(F.max("_on").alias("_on"))
    counts = pairs.groupBy("game_id").agg(F.count("*").alias("location_count"), F.count_if("_on").alias("active_location_count"))
    return (
        p.games.where(F.col("name").isNotNull() & (F.col("name") != ""))
        .join(counts, "game_id", "left")
        .select("game_id", "name", F.coalesce("manufacturer", F.lit("")).alias("manufacturer"), F.coalesce("location_count", F.lit(0)).alias("location_count"), F.coalesce("active_location_count", F.lit(0)).alias("active_location_count"))
    )


def election_order() -> list[Column]:
    """The canonical item of a group comes first: native, widely found, then by name and id."""
    return [source_rank(F.col("game_id")), F.desc("active_location_count"), F.desc("location_count"), F.lower("name"), F.abs("game_id")]


def elect(df: DataFrame, *keys: str) -> DataFrame:
    """Adds canonical_game_id and canonical_name of each group."""
    w = Window.partitionBy(*keys).orderBy(*election_order()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("canonical_game_id", F.first("game_id").over(w)).withColumn("canonical_name", F.first("name").over(w))


def allocate_ids(new: DataFrame, order: list[str], taken: DataFrame, key: str = "game_id") -> DataFrame:
    """Adds ``key``: consecutive ids after the greatest taken one, in the given order, at least FIRST_ID.

    Rows are divided into ranges of the order, numbered within each range, and
    moved on by the counts of the ranges before, so no task numbers all rows.
    Rows that tie in ``order`` follow in the order of their hash.
    """
    base = max(FIRST_ID - 1, taken.agg(F.max(key)).first()[0] or 0)
    ranged = new.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = checkpointed(ranged.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in new.columns])))
    counts = ranged.groupBy("_range").count().withColumn("_base", F.sum("count").over(Window.orderBy("_range")) - F.col("count")).drop("count")
    numbered = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(*order, "_tie"))).join(F.broadcast(counts), "_range")
    return numbered.withColumn(key, F.lit(base) + F.col("_base") + F.col("_n")).drop("_range", "_base", "_n", "_tie")
