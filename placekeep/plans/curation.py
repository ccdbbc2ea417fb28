"""Runs of several steps: a national import and merge, publishing and rebuilding curated tables, reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placekeep.model import Places
from placekeep.operators import matching, upsert
from placekeep.plans import pipelines
from placekeep.plans.render import QueryResult, render
from placekeep.session import checkpointed
from placekeep.sources import catalogues

#: Keys by which curated tables are replaced; tables without a key grow. Link tables have this package's names.
REPLACE_KEYS = {
    "game_source_records": ("source", "source_game_id"),
    "duplicate_review_candidates": ("candidate_id",),
    "duplicate_review_records": ("candidate_id", "game_id"),
    "location_statuses": ("location_id",),
    "a_links": ("location_id", "source_id"),
    "b_links": ("location_id", "source_id"),
}
#: Confidence from which a directory match is sure.
SURE = 0.84
#: Rows of a report, at most.
REPORT_ROWS = 500


def run_steps(steps: Iterable[pipelines.Step], actions: Mapping[str, Callable[[pipelines.Step], object]], apply: bool = False) -> list[tuple[str, str]]:
    """Runs the steps in order: (name, outcome) of each, planned, done or failed; nothing runs after a failure or without ``apply``."""
    out: list[tuple[str, str]] = []
    for step in steps:
        if not apply or step.name not in actions:
            out.append((step.name, "planned" if not apply else "no action"))
            continue
        try:
            actions[step.name](step)
        except Exception as e:
            out.append((step.name, f"failed: {e}"))
            break
        out.append((step.name, "done"))
    return out


@dataclass
class Curated:
    """Next snapshots and the counts that a run reports."""

    tables: dict[str, DataFrame]
    directory: DataFrame
    counts: dict[str, int]


def curate(p: Places, states: list[str], at: str, directory: DataFrame | None = None, bundle: Mapping[str, DataFrame] | None = None) -> Curated:
    """A national run: directory entries are matched and their machines merged, then a source's bundle is imported.

    ``directory`` has the columns of catalogues.directory_entries, ``bundle``
    those of catalogues.region_bundle; either may be left out. Both are cut to
    ``states``. Sure directory matches are linked, the others are left for
    review. Nothing is written: callers commit the returned tables.
    """
    tables = {"locations": p.locations, "games": p.games, "location_games": p.location_games}
    matches = None
    counts: dict[str, int] = {}
    if directory is not None:
        entries = directory.where(F.col("state").isin(states))
        matches = checkpointed(matching.directory_matches(entries, p.locations))
        sure = matches.where(F.col("confidence") >= SURE)
        machines = catalogues.directory_machines(entries)
        decisions = checkpointed(pipelines.merge_machines(sure.select("location_id", "source_id"), machines, p.location_games, p.games))
        merged = pipelines.apply_machines(p, decisions, at)
        tables |= {k: merged[k] for k in ("games", "location_games", "locations")}
        tables["machine_links"] = merged["links"]
        counts |= {"directory_sure": sure.count(), "directory_possible": matches.count() - sure.count(), "machines": decisions.count()}
        p = Places(**{**p.__dict__, "locations": checkpointed(tables["locations"]), "games": checkpointed(tables["games"]), "location_games": checkpointed(tables["location_games"])})
    if bundle is not None:
        own = {"locations": bundle["locations"].where(F.col("state").isin(states)), "machines": bundle["machines"], "placements": bundle["placements"]}
        imported = pipelines.import_bundle(p, own, p.a_links, at)
        # One row for each kind of outcome.
        counts |= {r.metric: r.value for r in imported.pop("stats").collect()} | {"imported_review": imported["review"].count()}
        tables |= imported
    return Curated(tables, matches, counts)


def export_curation(tables: Mapping[str, DataFrame | None], folder: str, spark: SparkSession, at: str) -> dict:
    """Writes each table as sorted JSON lines and a manifest with their counts; folders of absent or empty tables go."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    counts = {}
    for name, df in tables.items():
        at_name = f"{folder.rstrip('/')}/{name}.jsonl"
        counts[name] = 0 if df is None else df.count()
        if counts[name]:
            catalogues.write_jsonl(df, at_name)
        elif fs.exists(path(at_name)):
            fs.delete(path(at_name), True)
    manifest = {"format": "placekeep-curation-v1", "generated_at": at, "files": {n: f"{n}.jsonl" for n, c in counts.items() if c}, "counts": counts}
    out = fs.create(path(f"{folder.rstrip('/')}/manifest.json"), True)
    out.write(bytearray((json.dumps(manifest, indent=2, sort_keys=True) + "\n").encode()))
    out.close()
    return manifest


def replace_from(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal keys; without keys the rows are added.

    Columns that ``new`` lacks are null in its rows; of several new rows of one key one stays.
    """
    own = new.select(*[F.col(f"`{c}`") if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns])
    if not keys:
        return old.unionByName(own)
    own = own.dropDuplicates(list(keys))
    return upsert.replace_rows(old, own, list(keys))


def rebuild_curation(tables: Mapping[str, DataFrame], folder: str, spark: SparkSession, keys: Mapping[str, tuple[str, ...]] = REPLACE_KEYS) -> dict[str, DataFrame]:
    """The tables after an export's rows were put in; tables that the export lacks stay as they are."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    out = dict(tables)
    for name, df in tables.items():
        at_name = f"{folder.rstrip('/')}/{name}.jsonl"
        if fs.exists(path(at_name)):
            out[name] = replace_from(df, catalogues.read_jsonl(spark, at_name, df.schema), keys.get(name, ()))
    return out


def write_report(results: Iterable[QueryResult], folder: str, name: str, spark: SparkSession, at: str) -> list[str]:
    """A report as Markdown and JSON files, and a CSV file of its first table; REPORT_ROWS rows of each table at most."""
    results = list(results)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    texts = {
        "md": "\n\n".join([f"# {name}", f"Generated: {at}", *(render(r, "markdown", REPORT_ROWS) for r in results)]) + "\n",
        "json": json.dumps({"generated_at": at, "tables": [json.loads(render(r, "json", REPORT_ROWS)) for r in results]}, indent=2, ensure_ascii=False) + "\n",
    }
    if results:
        texts["csv"] = render(results[0], "csv", REPORT_ROWS)
    written = []
    for kind, text in texts.items():
        written.append(f"{folder.rstrip('/')}/{name}.{kind}")
        out = fs.create(path(written[-1]), True)
        out.write(bytearray(text.encode()))
        out.close()
    return written


def scan_batches(candidates: DataFrame, scanned: DataFrame | None, size: int) -> DataFrame:
    """The next ``size`` candidates that no batch has scanned yet, in order of id."""
    rest = candidates if scanned is None else candidates.join(scanned.select("location_id"), "location_id", "left_anti")
    return rest.orderBy("location_id").limit(size)
