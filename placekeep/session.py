"""Session helpers shared by all operators."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "placekeep", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators are tested with."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, late ones too.

    The zip goes out through the driver's file server, so executors that join
    after a loss fetch it as well.
    """
    sc = spark.sparkContext
    if getattr(sc, "_placekeep_shipped", False):
        return
    root = Path(__file__).resolve().parent
    files = sorted(root.rglob("*.py"))
    digest = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:16]
    target = os.path.join(tempfile.mkdtemp(), f"placekeep-{digest}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in files:
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    sc._placekeep_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, which all executors share: that of ``spark.checkpoint.dir``.

    Where that setting is absent, a master on this machine alone (tests,
    notebooks) gets a folder of it; on a cluster it would be lost with the
    machine, so there the setting must be made.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="placekeep-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys) -> DataFrame:
    """``df`` in two parts for each core, by the keys if given, before costly work on few bytes that would be one task otherwise."""
    parts = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts, *keys)


#: Rows of a task of :func:`by_rows`.
TASK_ROWS = 1 << 20


def by_rows(df: DataFrame, *keys, counted: DataFrame | None = None) -> DataFrame:
    """``df`` by the keys in as many parts as its rows ask for, so that what a task sorts or groups doesn't grow with the table.

    The rows of ``counted`` are counted, or of ``df``, if that is cheap to read.
    """
    rows = (df if counted is None else counted).count()
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return df.repartition(parts, *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
