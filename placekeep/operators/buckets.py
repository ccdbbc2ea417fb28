"""Tables in hash buckets, changed file by file, with optimistic concurrent commits.

A table's rows lie in hash buckets of its first key column, and inside a bucket
in files that cover ranges of the whole key. A manifest (a Parquet table as
well) has each file's bucket, least and greatest key and rows. A merge finds the
files whose ranges hold a changed key, reads and rewrites those, and leaves all
others to the next version as they are.

Versions are numbered pointers that are put in place at most once each. A
commit that finds its number taken looks at what the versions since its start
changed: if none of it lies in a bucket that it changed itself, it is put on top
of them; else it raises ``Conflict`` and changes nothing. Files are never
changed, so a reader keeps the version that it began with.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placekeep.session import checkpointed

#: Rows of a file, about, and buckets of a new table.
FILE_ROWS, BUCKETS = 1_000_000, 16
#: Files of a manifest that are broadcast to find a change's files; more are joined by a shuffle.
BROADCAST_FILES = 100_000
#: Integer keys that share a bucket stand together in runs of this length, so that clustered changes touch few buckets.
SPAN = 4096


class Conflict(Exception):
    """Another commit has changed the same buckets since this one began."""


class Pointers:
    """Numbered files under a folder of any Hadoop file system, each put in place whole and at most once."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self.fs = self.path().getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path())

    def path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def numbers(self) -> list[int]:
        names = (s.getPath().getName() for s in self.fs.listStatus(self.path()))
        return sorted(int(n[8:]) for n in names if n.startswith("current-") and n[8:].isdigit())

    def read(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/current-{number}", wholetext=True).first()[0])

    def write(self, name: str, value: dict) -> None:
        out = self.fs.create(self.path(name), False)
        out.write(bytearray((json.dumps(value, indent=2, sort_keys=True) + "\n").encode()))
        out.close()

    def claim(self, number: int, value: dict) -> bool:
        """Whether the pointer is now this one; false if the number is taken."""
        pending = f"pending-{uuid.uuid4().hex}"
        self.write(pending, value)
        if self.fs.getUri().getScheme() == "file":
            # A local rename replaces files; a hard link doesn't.
            local = self._jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority
            try:
                os.link(local(self.path(pending)).toString(), local(self.path(f"current-{number}")).toString())
                return True
            except FileExistsError:
                return False
            finally:
                self.fs.delete(self.path(pending), False)
        if self.fs.exists(self.path(f"current-{number}")) or not self.fs.rename(self.path(pending), self.path(f"current-{number}")):
            self.fs.delete(self.path(pending), False)
            return False
        return True


@dataclass
class Change:
    """What a writer is about to commit: for each table the files it drops, a manifest of those it adds, and the buckets it changed."""

    base: int
    dropped: dict[str, list[str]] = field(default_factory=dict)
    added: dict[str, DataFrame] = field(default_factory=dict)
    touched: dict[str, list[int]] = field(default_factory=dict)
    made: dict[str, dict] = field(default_factory=dict)


class BucketStore:
    """Named tables of one folder."""

    def __init__(self, spark: SparkSession, root: str, file_rows: int = FILE_ROWS) -> None:
        self.spark, self.root, self.file_rows = spark, root.rstrip("/"), file_rows
        self.pointers = Pointers(spark, root)

    def version(self) -> int:
        return max([0, *self.pointers.numbers()])

    def state(self, version: int | None = None) -> dict:
        """tables: name -> manifest, keys, buckets; touched: name -> buckets that the version changed."""
        version = self.version() if version is None else version
        return self.pointers.read(version) if version else {"tables": {}, "touched": {}}

    def manifest(self, name: str, version: int | None = None) -> DataFrame:
        """file, bucket, low, high (structs of the keys), rows."""
        return self.spark.read.parquet(self.state(version)["tables"][name]["manifest"])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        state = self.state(version)["tables"][name]
        return self._rows([r.file for r in self.spark.read.parquet(state["manifest"]).select("file").collect()], state["schema"])

    def _rows(self, files: Sequence[str], schema: str) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*files)

    @staticmethod
    def bucket(key: str, kind: str, buckets: int) -> Column:
        spread = F.floor(F.col(key) / SPAN) if kind in ("bigint", "int", "smallint", "tinyint") else F.col(key)
        return F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int")

    @staticmethod
    def _spans(files: DataFrame) -> DataFrame:
        """file, bucket, slot, start, next: the keys of a bucket from ``start`` to before ``next`` belong to a file; all of them to some file."""
        w = Window.partitionBy("bucket").orderBy("low", "file")
        slot = F.row_number().over(w)
        return files.select("file", "bucket", slot.alias("slot"), F.when(slot > 1, F.col("low")).alias("start"), F.lead("low").over(w).alias("next"))

    @staticmethod
    def _inside(key: Column) -> Column:
        return (F.col("start").isNull() | (key >= F.col("start"))) & (F.col("next").isNull() | (key < F.col("next")))

    def _write(self, name: str, rows: DataFrame, keys: Sequence[str], buckets: int, spans: DataFrame | None = None) -> DataFrame:
        """The manifest of the files that hold ``rows`` from now on; a file stays within one of ``spans``, so that files of a bucket never overlap."""
        folder = f"{self.root}/data/{name}/{uuid.uuid4().hex}"
        rows = checkpointed(rows)
        total = rows.count()
        if total:
            dealt = rows.withColumn("_bucket", self.bucket(keys[0], dict(rows.dtypes)[keys[0]], buckets))
            if spans is None:
                dealt = dealt.withColumn("_slot", F.lit(0))
            else:
                places = spans.select(F.col("bucket").alias("_bucket"), F.col("slot").alias("_slot"), "start", "next")
                on = (dealt["_bucket"] == places["_bucket"]) & self._inside(F.struct(*keys))
                dealt = dealt.join(places, on, "left").select(*rows.columns, dealt["_bucket"], F.coalesce("_slot", F.lit(0)).alias("_slot"))
            parts = max(1, -(-total // self.file_rows))
            # Ranges of (bucket, slot, key): equal keys stay together, and each slot of a range is a file of its own.
            order = ["_bucket", "_slot", *keys]
            dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.option("compression", "zstd").partitionBy("_bucket", "_slot").parquet(folder)
            written = self.spark.read.parquet(folder).select(F.col("_metadata.file_path").alias("file"), F.col("_bucket").cast("int").alias("bucket"), F.struct(*keys).alias("key"))
        else:
            kinds = ", ".join(f"`{k}`: {dict(rows.dtypes)[k]}" for k in keys)
            written = self.spark.createDataFrame([], f"file string, bucket int, key struct<{kinds}>")
        return written.groupBy("file", "bucket").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("rows"))

    def begin(self) -> Change:
        return Change(self.version())

    def create(self, name: str, rows: DataFrame, keys: Sequence[str], buckets: int = BUCKETS, change: Change | None = None) -> Change:
        """Adds the replacing of a whole table to ``change``."""
        change = change or self.begin()
        old = self.state(change.base)["tables"].get(name)
        change.dropped[name] = [] if old is None else [r.file for r in self.spark.read.parquet(old["manifest"]).select("file").collect()]
        change.added[name] = checkpointed(self._write(name, rows, keys, buckets))
        change.touched[name] = list(range(max(buckets, old["buckets"] if old else 0)))
        change.made[name] = {"keys": list(keys), "buckets": buckets, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)}
        return change

    def touched_files(self, name: str, changes: DataFrame, version: int) -> list[tuple[str, int]]:
        """(file, bucket) of the files whose ranges hold keys of ``changes``; a key between two files belongs to the first."""
        state = self.state(version)["tables"][name]
        files = self.manifest(name, version)
        spans = self._spans(files)
        keys = changes.select(self.bucket(state["keys"][0], dict(changes.dtypes)[state["keys"][0]], state["buckets"]).alias("bucket"), F.struct(*state["keys"]).alias("key")).distinct()
        spans = F.broadcast(spans) if files.count() <= BROADCAST_FILES else spans
        # One row for each file of the manifest at most.
        return [(r.file, r.bucket) for r in keys.join(spans, "bucket").where(self._inside(F.col("key"))).select("file", "bucket").distinct().collect()]

    def merge(self, name: str, changes: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], change: Change | None = None) -> Change:
        """Adds a merge to ``change``. ``how(rows, changes)`` gives a table's next rows and may only change rows of keys in ``changes``."""
        change = change or self.begin()
        state = self.state(change.base)["tables"][name]
        if name in change.touched:
            raise ValueError(f"{name} is changed already")
        changes = checkpointed(changes)
        files = self.touched_files(name, changes, change.base)
        kind = self.bucket(state["keys"][0], dict(changes.dtypes)[state["keys"][0]], state["buckets"])
        buckets = sorted({r.b for r in changes.select(kind.alias("b")).distinct().collect()})
        rows = how(self._rows([f for f, _ in files], state["schema"]), changes)
        change.dropped[name] = [f for f, _ in files]
        # The files that are rewritten, in bounded number: the change's own.
        spans = self._spans(self.manifest(name, change.base)).join(F.broadcast(self.spark.createDataFrame([(f,) for f, _ in files], "file string")), "file")
        spans = F.broadcast(checkpointed(spans)) if len(files) <= BROADCAST_FILES else spans
        change.added[name] = checkpointed(self._write(name, rows, state["keys"], state["buckets"], spans))
        change.touched[name] = buckets
        return change

    def commit(self, change: Change) -> int:
        """The version that ``change`` became. Raises ``Conflict`` if a version since its start has changed the same buckets."""
        base = change.base
        while True:
            now = self.version()
            for n in range(base + 1, now + 1):
                other = self.state(n)["touched"]
                for name in change.touched.keys() & other.keys():
                    both = set(change.touched[name]) & set(other[name])
                    if both:
                        raise Conflict(f"version {n} has changed buckets {sorted(both)} of {name}")
            base = now
            tables = dict(self.state(now)["tables"])
            for name in change.touched:
                entry = dict(change.made.get(name) or tables[name])
                files = change.added[name]
                if name in tables:
                    gone = self.spark.createDataFrame([(f,) for f in change.dropped[name]], "file string")
                    files = self.spark.read.parquet(tables[name]["manifest"]).join(F.broadcast(gone), "file", "left_anti").select(*files.columns).unionByName(files)
                entry["manifest"] = f"{self.root}/manifests/{name}/{uuid.uuid4().hex}"
                files.repartition(1 + change.added[name].count() // BROADCAST_FILES).write.parquet(entry["manifest"])
                tables[name] = entry
            if self.pointers.claim(now + 1, {"tables": tables, "touched": change.touched}):
                return now + 1

    def compact(self, name: str) -> int:
        """Files of fewer than half of ``file_rows`` rows are written anew, together with those beside them in their buckets."""
        change = self.begin()
        state = self.state(change.base)["tables"][name]
        files = self.manifest(name, change.base)
        crowded = files.where(F.col("rows") * 2 < self.file_rows).groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        chosen = files.join(crowded.select("bucket"), "bucket", "left_semi").select("file", "bucket").collect()
        if not chosen:
            return change.base
        change.dropped[name] = [r.file for r in chosen]
        change.touched[name] = sorted({r.bucket for r in chosen})
        change.added[name] = checkpointed(self._write(name, self._rows(change.dropped[name], state["schema"]), state["keys"], state["buckets"]))
        return self.commit(change)

    def remove_old(self, keep: int = 1) -> int:
        """Deletes pointers before the last ``keep`` versions, with the files and manifests that only they name; gives the number of files."""
        numbers = self.pointers.numbers()
        old, kept = numbers[:-keep], numbers[-keep:]
        if not old:
            return 0

        def manifests(versions: list[int]) -> set[str]:
            return {t["manifest"] for n in versions for t in self.state(n)["tables"].values()}

        def files(paths: set[str]) -> DataFrame:
            return reduce(DataFrame.unionByName, [self.spark.read.parquet(m).select("file") for m in sorted(paths)]).distinct()

        gone, held = manifests(old), manifests(kept)
        if not gone - held:
            lost = []
        else:
            lost = [r.file for r in files(gone - held).join(files(held), "file", "left_anti").collect()] if held else [r.file for r in files(gone).collect()]
        for n in old:
            self.pointers.fs.delete(self.pointers.path(f"current-{n}"), False)
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        for f in lost:
            self.pointers.fs.delete(make(f), False)
        for m in gone - held:
            self.pointers.fs.delete(make(m), True)
        return len(lost)


def upsert_into(store: BucketStore, name: str, changes: DataFrame, policies: Mapping[str, str], default: str = "fill") -> int:
    """``upsert.upsert`` that rewrites touched files only."""
    from placekeep.operators.upsert import upsert

    keys = store.state()["tables"][name]["keys"]
    return store.commit(store.merge(name, changes, lambda rows, new: upsert(rows, new, keys, policies, default)))
