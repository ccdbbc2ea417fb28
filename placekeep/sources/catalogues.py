"""Catalogue imports: packed CSV lists, nested JSON, directory JSON, JSONL, and cached files."""

from __future__ import annotations

import os
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from placekeep.functions import text as X
from placekeep.operators.identity import a_id

#: List columns of the packed CSV, and their names in the result.
MACHINE_LISTS = {"Id [Machines]": "machine_id", "Name [Machines]": "name", "Manufacturer [Machines]": "manufacturer", "Year [Machines]": "year", "Machine type [Machines]": "machine_type", "Machine display [Machines]": "machine_display", "Ipdb [Machines]": "ipdb", "Opdb [Machines]": "opdb"}
PLACEMENT_LISTS = {"Id [Location machine xrefs]": "placement_id", "Ic enabled [Location machine xrefs]": "ic_enabled"}
#: Location types that are renamed.
TYPES = {"family fun center": "Family Center", "movie theater": "Cinema", "pizza parlor": "Restaurant", "restaurant": "Restaurant"}


def read_packed_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def unpack(rows: DataFrame, strict: bool = True) -> dict[str, DataFrame]:
    """locations, machines, placements and rejects of a packed CSV.

    The lists of a row are zipped by position; positions that a list lacks are
    null. Rows whose count of ids differs from the declared count are rejected;
    ``strict`` makes reading the others fail on them.
    """
    lists = rows.select("*", *[X.split_list(F.col(f"`{c}`")).alias(f"_{n}") for c, n in (MACHINE_LISTS | PLACEMENT_LISTS).items()])
    count = F.coalesce(F.col("`Machine count`").try_cast("int"), F.lit(0))
    good = (F.size("_machine_id") == count) & F.size("_placement_id").isin(0) | (F.size("_machine_id") == count) & (F.size("_placement_id") == count)
    rejects = lists.where(~good)
    kept = lists.where(F.when(good, True).otherwise(F.assert_true(good, F.concat(F.lit("list length at location "), F.col("Id"))).isNull())) if strict else lists.where(good)
    kind = F.lower(F.coalesce(X.clean(F.col("`Name [Location type]`")), F.lit("")))
    types = F.create_map(*[F.lit(v) for kv in TYPES.items() for v in kv])
    locations = kept.select(
        F.col("Id").cast("long").alias("source_id"), F.trim("Name").alias("name"), X.clean(F.col("Street")).alias("street_address"), X.clean(F.col("City")).alias("city"), X.clean(F.col("State")).alias("state"), X.clean(F.col("Zip")).alias("postal_code"),
        X.clean(F.col("Phone")).alias("phone"), X.clean(F.col("Website")).alias("website_url"), X.clean(F.col("Description")).alias("description"), X.number(F.col("Lat")).alias("latitude"), X.number(F.col("Lon")).alias("longitude"),
        F.coalesce(types[kind], X.clean(F.col("`Name [Location type]`"))).alias("type"), count.alias("machine_count"), X.clean(F.col("`Date last updated`")).alias("updated_text"),
    )
    names = list((MACHINE_LISTS | PLACEMENT_LISTS).values())
    flat = kept.select(F.col("Id").cast("long").alias("source_id"), F.posexplode(F.arrays_zip(*[F.col(f"_{n}") for n in names])).alias("position", "x"))
    flat = flat.select("source_id", "position", *[F.col(f"x._{n}").alias(n) for n in names]).withColumn("machine_id", F.col("machine_id").cast("long"))
    machines = merge_first(
        flat.select("source_id", "position", "machine_id", "name", X.clean(F.col("manufacturer")).alias("manufacturer"), X.whole_number(F.col("year")).alias("year"), *[X.clean(F.col(c)).alias(c) for c in ("machine_type", "machine_display", "ipdb", "opdb")]), "machine_id", ["source_id", "position"]
    )
    placements = flat.select(F.coalesce(F.col("placement_id").cast("long"), a_id(F.col("machine_id"))).alias("placement_id"), "source_id", "machine_id", X.truth(F.col("ic_enabled")).alias("ic_enabled"))
    return {"locations": locations, "machines": machines, "placements": placements, "rejects": rejects}


def merge_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key; each column's first value that isn't null, empty or zero."""
    o = F.struct(*order)
    rest = [c for c in df.columns if c not in (key, *order)]

    def first(c: str) -> Column:
        kept = F.col(c).isNotNull() & (F.col(c).cast("string") != "") & (F.col(c).cast("string") != "0")
        return F.min_by(F.col(c), F.when(kept, o)).alias(c)

    return df.groupBy(key).agg(*[first(c) for c in rest])


#: Shape of the nested region payload.
REGION = (
    "struct<locations:array<struct<id:bigint,name:string,street:string,city:string,state:string,zip:string,phone:string,country:string,lat:string,lon:string,website:string,description:string,location_type_id:bigint,"
    "machine_count:bigint,date_last_updated:string,location_machine_xrefs:array<struct<id:bigint,deleted_at:string,ic_enabled:boolean,machine:struct<id:bigint,name:string,manufacturer:string,year:bigint,machine_type:string,machine_display:string,ipdb_id:string,opdb_id:string>>>>>>"
)


def region_bundle(payloads: DataFrame, types: DataFrame | None = None, body: str = "body", order: str = "position") -> dict[str, DataFrame]:
    """locations, machines and placements of nested region payloads (JSON texts in ``body``).

    Foreign places and deleted placements are dropped; of one id the last
    payload wins.
    """
    rows = payloads.select(order, F.explode(F.from_json(F.col(body), REGION)["locations"]).alias("l")).where(F.upper(F.coalesce("l.country", F.lit("US"))).isin("US", "USA") & F.col("l.id").isNotNull())
    last = rows.withColumn("_n", F.row_number().over(Window.partitionBy("l.id").orderBy(F.desc(order)))).where("_n = 1").select("l.*")
    locations = last.select(
        F.col("id").alias("source_id"), F.trim("name").alias("name"), *[X.clean(F.col(a)).alias(b) for a, b in (("street", "street_address"), ("city", "city"), ("state", "state"), ("zip", "postal_code"), ("phone", "phone"), ("website", "website_url"), ("description", "description"))],
        X.number(F.col("lat")).alias("latitude"), X.number(F.col("lon")).alias("longitude"), "location_type_id", F.coalesce("machine_count", F.size("location_machine_xrefs").cast("long")).alias("machine_count"), F.col("date_last_updated").alias("updated_text"),
    )
    if types is not None:
        locations = locations.join(types.select(F.col("id").alias("location_type_id"), F.col("name").alias("type")), "location_type_id", "left")
    flat = last.select(F.col("id").alias("source_id"), F.posexplode("location_machine_xrefs").alias("position", "x")).where("x.deleted_at IS NULL AND x.machine.id IS NOT NULL")
    machines = merge_first(
        flat.select("source_id", "position", F.col("x.machine.id").alias("machine_id"), *[F.col(f"x.machine.{c}").alias(c) for c in ("name", "manufacturer", "year", "machine_type", "machine_display")], F.col("x.machine.ipdb_id").alias("ipdb"), F.col("x.machine.opdb_id").alias("opdb")), "machine_id", ["source_id", "position"]
    )
    placements = flat.select(F.col("x.id").alias("placement_id"), "source_id", F.col("x.machine.id").alias("machine_id"), F.col("x.ic_enabled").alias("ic_enabled"))
    return {"locations": locations, "machines": machines, "placements": placements}


DIRECTORY = (
    "struct<arcades:array<struct<id:string,name:string,city:string,subregion:string,addressLine1:string,addressLine2:string,postalCode:string,latitude:string,longitude:string,website:string,lastUpdateTime:string,"
    "machines:array<struct<id:string,condition:string,game:struct<id:string,name:string,genre:string>>>>>>"
)


def directory_entries(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Entries of a directory payload with a known state and an integer id, and their machines."""
    rows = payloads.select(F.explode(F.from_json(F.col(body), DIRECTORY)["arcades"]).alias("a")).select("a.*")
    t = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")).alias(c)
    df = rows.select(
        F.col("id").try_cast("bigint").alias("source_id"), t("name"), t("city"), X.state_code(F.col("subregion")).alias("state"), t("addressLine1").alias("street_address"), t("addressLine2").alias("address_line2"), t("postalCode").alias("postal_code"),
        X.number(F.col("latitude")).alias("latitude"), X.number(F.col("longitude")).alias("longitude"), t("website").alias("website_url"), F.col("lastUpdateTime").alias("updated_text"), "machines",
    )
    return df.where("source_id IS NOT NULL AND state IS NOT NULL")


def directory_machines(entries: DataFrame) -> DataFrame:
    """Machines of directory entries; bad ids are dropped, conditions kept only if they are digits."""
    m = entries.select("source_id", F.explode_outer("machines").alias("m"))
    df = m.select("source_id", F.col("m.id").try_cast("bigint").alias("machine_id"), F.col("m.game.id").try_cast("bigint").alias("source_game_id"), F.trim("m.game.name").alias("name"), F.col("m.game.genre").alias("genre"), F.when(F.col("m.condition").rlike(r"^\d+$"), F.col("m.condition").cast("long")).alias("condition"))
    return df.where("machine_id IS NOT NULL AND source_game_id IS NOT NULL")


def to_jsonl(df: DataFrame) -> DataFrame:
    """Rows in order of all columns, as JSON with sorted keys and nulls."""
    names = sorted(df.columns)
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in df.columns]).select(F.to_json(F.struct(*names), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Part files whose order is that of the rows; ``one_file`` lets one task write them all, for small tables."""
    lines = to_jsonl(df)
    (lines.coalesce(1) if one_file else lines).write.mode("overwrite").text(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of a JSONL export; columns that the file lacks are null."""
    return spark.read.schema(schema).json(path)


def parquet_views(spark: SparkSession, **paths: str) -> None:
    """Temporary views over Parquet snapshots."""
    for name, path in paths.items():
        spark.read.parquet(path).createOrReplaceTempView(name)


def is_fresh(path: str, hours: float, now: float | None = None, never_expires: bool = True) -> bool:
    """Whether a cached file may be used; ``hours`` of 0 or less mean always or never."""
    if not os.path.exists(path):
        return False
    if hours <= 0:
        return never_expires
    return (now or time.time()) - os.path.getmtime(path) <= hours * 3600


def run_script(spark: SparkSession, script: str) -> list[DataFrame]:
    """Statements of a script, split at semicolons."""
    return [spark.sql(s) for s in (p.strip() for p in script.split(";")) if s]


def has_table(spark: SparkSession, name: str) -> bool:
    return any(t.name.lower() == name.lower() for t in spark.catalog.listTables())


