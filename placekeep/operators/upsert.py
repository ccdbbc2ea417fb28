"""Mutations as new snapshots.

Plain Parquet tables can't be merged into; each operator takes the current
rows and the changes and returns all rows of the next snapshot. ``Snapshots``
writes them and swaps a pointer, so readers see the old or the new one whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placekeep.functions.predicates import GONE, differs
from placekeep.operators.buckets import Conflict, Pointers
from placekeep.operators.identity import source_id, source_name, transitive


def replace_rows(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete by key, then insert."""
    return target.join(changes.select(*keys).distinct(), list(keys), "left_anti").select(*target.columns).unionByName(changes.select(*target.columns))


def append_if_new(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING."""
    return target.unionByName(changes.join(target.select(*keys), list(keys), "left_anti").select(*target.columns))


#: How an upsert treats a column of a row that exists.
POLICIES = {
    "new": lambda old, new: new,
    "old": lambda old, new: old,
    "fill": lambda old, new: F.coalesce(old, new),
    "prefer_new": lambda old, new: F.coalesce(new, old),
}


def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str], policies: Mapping[str, str], default: str = "fill") -> DataFrame:
    """Inserts new keys; existing rows change column by column.

    ``policies`` names for each column new, old, fill (null only) or prefer_new
    (unless null). Columns that the changes lack stay.
    """
    given = [c for c in changes.columns if c not in keys]
    old = target.withColumn("_had", F.lit(True))
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in given]).withColumn("_got", F.lit(True))
    both = old.join(new, list(keys), "full_outer")

    def value(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c not in given:
            return F.col(c)
        held = POLICIES[policies.get(c, default)](F.col(c), F.col(f"_new_{c}"))
        return F.when(F.col("_got").isNull(), F.col(c)).when(F.col("_had").isNull(), F.col(f"_new_{c}")).otherwise(held).alias(c)

    return both.select(*[value(c) for c in target.columns])


def attach_source_records(records: DataFrame, changes: DataFrame) -> DataFrame:
    """Provenance upsert: names are kept unless new ones come, first_seen_at stays. A record that would change its item raises ValueError."""
    keys = ["source", "source_game_id"]
    if not records.join(changes.select(*keys, F.col("game_id").alias("_to")), keys).where(differs(F.col("game_id"), F.col("_to"))).isEmpty():
        raise ValueError("a source record already belongs to another item")
    return upsert(records, changes, keys, {"game_id": "new", "last_seen_at": "new", "first_seen_at": "old"}, default="prefer_new")


def backfill_source_records(records: DataFrame, games: DataFrame, links: DataFrame, at: str) -> DataFrame:
    """A source record for every item, pointing to the end of its chain of links."""
    ends = transitive(links)
    k = F.col("game_id")
    rows = games.join(ends.withColumnRenamed("alias_game_id", "game_id"), "game_id", "left").select(
        source_name(k).alias("source"), source_id(k).cast("string").alias("source_game_id"), F.coalesce("canonical_game_id", "game_id").alias("game_id"), F.col("name").alias("source_name"), F.col("manufacturer").alias("source_manufacturer"),
        F.lit(at).cast("timestamp").alias("first_seen_at"), F.lit(at).cast("timestamp").alias("last_seen_at"), k.alias("legacy_game_id"),
    )
    return attach_source_records(records, rows)


def apply_links(links: DataFrame, proposed: DataFrame) -> DataFrame:
    """Automatic links of the proposed aliases are replaced; manual ones win over proposals."""
    manual = links.where("source <> 'auto'")
    kept = links.join(proposed.select("alias_game_id"), "alias_game_id", "left_anti").unionByName(manual.join(proposed.select("alias_game_id"), "alias_game_id", "left_semi"), allowMissingColumns=True)
    new = proposed.join(manual.select("alias_game_id"), "alias_game_id", "left_anti").withColumn("source", F.lit("auto"))
    return kept.unionByName(new.select([c for c in links.columns if c in new.columns]), allowMissingColumns=True)


def apply_source_status(statuses: DataFrame, fresh: DataFrame, source: str) -> DataFrame:
    """Fresh source evidence marks a place matched, unless it is gone; notes of others stay."""
    old = statuses.withColumn("_had", F.lit(True))
    both = old.join(fresh.select("location_id", F.col("confidence").alias("_c"), F.col("checked_at").alias("_t"), F.col("notes").alias("_n"), F.lit(True).alias("_got")), "location_id", "full_outer")
    open_ = F.col("_got").isNotNull() & ~F.coalesce(F.col("status").isin(*GONE), F.lit(False))
    own = F.col("_had").isNull() | F.col("evidence").isNull() | (F.col("evidence") == source)
    pick = lambda c, new: F.when(open_, new).otherwise(F.col(c)).alias(c)
    return both.select("location_id", pick("status", F.lit("matched")), "replacement_name", pick("confidence", F.col("_c")), pick("verified_at", F.col("_t")), F.when(open_ & own, F.col("_n")).otherwise(F.col("notes")).alias("notes"), pick("evidence", F.lit(source)))


def apply_geocoder_status(statuses: DataFrame, checks: DataFrame, source: str) -> DataFrame:
    """Matched and needs_review results are taken over, unless the place is gone."""
    taken = checks.where(F.col("status").isin("matched", "needs_review"))
    return _overwrite(statuses, taken, source, lambda: ~F.coalesce(F.col("status").isin(*GONE), F.lit(False)))


def apply_scan_status(statuses: DataFrame, scans: DataFrame, source: str) -> DataFrame:
    """Scan results are taken over where no other source has given evidence."""
    taken = scans.where(F.col("status").isin("closed", "matched", "needs_review"))
    return _overwrite(statuses, taken, source, lambda: F.col("_had").isNull() | F.col("evidence").isNull() | (F.col("evidence") == source))


def _overwrite(statuses: DataFrame, taken: DataFrame, source: str, allowed) -> DataFrame:
    old = statuses.withColumn("_had", F.lit(True))
    new = taken.select("location_id", F.col("status").alias("_s"), F.col("confidence").alias("_c"), F.col("checked_at").alias("_t"), F.col("notes").alias("_n"), F.lit(True).alias("_got"))
    both = old.join(new, "location_id", "full_outer")
    on = F.col("_got").isNotNull() & allowed()
    pick = lambda c, v: F.when(on, v).otherwise(F.col(c)).alias(c)
    return both.select("location_id", pick("status", F.col("_s")), "replacement_name", pick("confidence", F.col("_c")), pick("verified_at", F.col("_t")), pick("evidence", F.lit(source)), pick("notes", F.col("_n")))


def append_evidence(log: DataFrame, rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Appends evidence with ids after the greatest, in the given order, as identity.allocate_ids deals them."""
    from placekeep.operators.identity import allocate_ids

    base = log.agg(F.max("verification_id")).first()[0] or 0
    numbered = allocate_ids(rows, list(order), log.select("verification_id"), "verification_id")
    least = numbered.agg(F.min("verification_id")).first()[0]
    shifted = numbered if least is None else numbered.withColumn("verification_id", F.col("verification_id") - F.lit(least - base - 1))
    return log.unionByName(shifted.select([c for c in log.columns if c in shifted.columns]), allowMissingColumns=True)


def update_metadata(locations: DataFrame, found: DataFrame, overwrite: bool = False) -> DataFrame:
    """Place ids, site, address and coordinates from a scan; nulls never overwrite."""
    known = [c for c in ("google_place_id", "google_cid", "website_url", "street_address", "latitude", "longitude") if c in found.columns and c in locations.columns]
    df = locations.join(found.select("location_id", *[F.col(c).alias(f"_f_{c}") for c in known]), "location_id", "left")
    both = (lambda c: F.coalesce(F.col(f"_f_{c}"), F.col(c))) if overwrite else (lambda c: F.coalesce(F.col(c), F.col(f"_f_{c}")))
    return df.select(*[both(c).alias(c) if c in known else F.col(c) for c in locations.columns])


def recount(locations: DataFrame, placements: DataFrame) -> DataFrame:
    """game_count and unique_game_count of every place from its placements."""
    counts = placements.groupBy("location_id").agg(F.count("*").alias("_n"), F.countDistinct("game_id").alias("_u"))
    df = locations.join(counts, "location_id", "left")
    new = {"game_count": F.coalesce("_n", F.lit(0).cast("long")), "unique_game_count": F.coalesce("_u", F.lit(0).cast("long"))}
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in locations.columns])


RESTORED = ("website_url", "street_address", "latitude", "longitude")


def repair_plan(current: DataFrame, baseline: DataFrame, statuses: DataFrame, verifications: DataFrame | None, source: str, bogus: str = "maps.m.en", preserve: Sequence[int] = ()) -> dict[str, DataFrame]:
    """Rows that a repair of scan damage would change, by effect. A preview counts them; ``repair`` applies them."""
    proven = None if verifications is None else verifications.where((F.col("provider") == source) & F.col("match_kind").isin("search_url_v2", "place_id_url_v2")).select("location_id").distinct()
    free = lambda df: df if proven is None else df.join(proven, "location_id", "left_anti")
    base = baseline.select("location_id", *[F.col(c).alias(f"_b_{c}") for c in RESTORED]).withColumn("_b_website_url", F.when(~F.contains(F.lower(F.coalesce("_b_website_url", F.lit(""))), F.lit(bogus)), F.col("_b_website_url")))
    unlike = F.lit(False)
    for c in RESTORED:
        unlike = unlike | differs(F.col(c), F.col(f"_b_{c}"))
    closed = free(statuses.where((F.col("status") == "closed") & (F.col("evidence") == source)).join(current.select("location_id", "name"), "location_id"))
    keep = F.contains(F.lower("name"), F.lit("(closed)")) | (F.col("location_id").isin(list(preserve)) if preserve else F.lit(False))
    has_ids = [c for c in ("google_place_id", "google_cid") if c in current.columns]
    some = F.lit(False)
    for c in has_ids:
        some = some | F.col(c).isNotNull()
    return {
        "restored_locations": free(current.join(base, "location_id").where(unlike)),
        "cleared_place_ids": free(current.where(some)),
        "cleared_bogus_websites": current.where(F.contains(F.lower(F.coalesce("website_url", F.lit(""))), F.lit(bogus))),
        "preserved_closures": closed.where(keep),
        "demoted_closures": closed.where(~keep),
    }


def repair_preview(plan: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in plan.items():
        row = df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
        out = row if out is None else out.unionByName(row)
    return out


def repair(current: DataFrame, statuses: DataFrame, plan: dict[str, DataFrame], at: str) -> tuple[DataFrame, DataFrame]:
    """Restores columns, clears ids and bogus sites, and sends demoted closures to review."""
    restored = plan["restored_locations"].select("location_id", *[F.col(f"_b_{c}").alias(f"_r_{c}") for c in RESTORED], F.lit(True).alias("_restore"))
    cleared = plan["cleared_place_ids"].select("location_id", F.lit(True).alias("_clear"))
    bogus = plan["cleared_bogus_websites"].select("location_id", F.lit(True).alias("_bogus"))
    df = current.join(restored, "location_id", "left").join(cleared, "location_id", "left").join(bogus, "location_id", "left")

    def value(c: str) -> Column:
        v = F.when(F.col("_restore"), F.col(f"_r_{c}")).otherwise(F.col(c)) if c in RESTORED else F.col(c)
        if c in ("google_place_id", "google_cid"):
            v = F.when(F.col("_clear").isNull(), v)
        if c == "website_url":
            v = F.when(F.col("_bogus") & F.col("_restore").isNull(), F.lit(None)).otherwise(v)
        return v.alias(c)

    demoted = plan["demoted_closures"].select("location_id", F.lit(True).alias("_demote"))
    s = statuses.join(demoted, "location_id", "left")
    on = F.col("_demote").isNotNull()
    new = {"status": F.lit("needs_review"), "verified_at": F.lit(at)}
    return df.select(*[value(c) for c in current.columns]), s.select(*[F.when(on, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in statuses.columns])


def record_decision(candidates: DataFrame, decisions: DataFrame, candidate_id: int, decision: str, at: str, notes: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A review decision: M merges, U is unrelated, N needs more; the log grows by a row."""
    status = {"M": "merge", "U": "unrelated", "N": "needs_more"}[decision]
    spark = candidates.sparkSession
    row = spark.createDataFrame([(candidate_id, decision, notes, at)], "candidate_id long, decision string, notes string, decided_at string").withColumn("decided_at", F.col("decided_at").cast("timestamp"))
    return candidates.withColumn("status", F.when(F.col("candidate_id") == candidate_id, status).otherwise(F.col("status"))), decisions.unionByName(row.select(*decisions.columns))


def latest_wins(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key, the last in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


class Snapshots:
    """Versions of whole tables under one folder of any Hadoop file system, with a numbered pointer to each.

    ``commit`` writes all given tables into a new folder and then puts the
    version's pointer in place, which happens at most once for each number.
    Pointers and folders never change afterwards; the greatest pointer is the
    current version, so a failure at any step leaves the old one current. A
    writer whose tables another one has changed meanwhile gets a ``Conflict``;
    with other tables both land. ``buckets.BucketStore`` rewrites parts of tables.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.pointers = Pointers(spark, root)

    def version(self) -> int:
        return max([0, *self.pointers.numbers()])

    def current(self) -> dict[str, str]:
        """Folder of each table."""
        version = self.version()
        return self.pointers.read(version)["tables"] if version else {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.current()[name])

    def manifest(self) -> dict:
        """Time, folders and rows of the newest published tables; empty if none were published with a time."""
        for n in reversed(self.pointers.numbers()):
            found = self.pointers.read(n)["manifest"]
            if found:
                return found
        return {}

    def commit(self, tables: Mapping[str, DataFrame], at: str | None = None, since: int | None = None) -> dict[str, str]:
        """Folder of each table after ``tables`` are written; with a time, a manifest with their rows goes with them.

        ``since`` is the version that the tables were made from, the current
        one if not given.
        """
        base = self.version() if since is None else since
        old = self.pointers.read(base)["tables"] if base else {}
        folder = f"{self.root}/v{base + 1}-{uuid.uuid4().hex}"
        new = {name: f"{folder}/{name}" for name in tables}
        for name, df in tables.items():
            df.write.option("compression", "zstd").mode("error").parquet(new[name])
        # Counts come from the footers of what was written.
        manifest = None if at is None else {"generated_at": at, "files": new, "counts": {name: self.spark.read.parquet(new[name]).count() for name in tables}}
        while True:
            version = self.version()
            now = self.pointers.read(version)["tables"] if version else {}
            changed = sorted(n for n in tables if now.get(n) != old.get(n))
            if changed:
                raise Conflict(f"another commit has written {', '.join(changed)}")
            if self.pointers.claim(version + 1, {"tables": now | new, "manifest": manifest}):
                return now | new
