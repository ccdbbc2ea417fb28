"""Near copies by SimHash candidates and exact confirmation; one document of each group stays.

Sketches of 256 bits (``simhash.sketch``) meet in vantage-point trees at a limit
that nearly all pairs of the wanted similarity keep. The trees' links are
candidates only: each is confirmed on the full shingle sets. Where the confirmed
links leave a group of candidates in several components, all its pairs of
different components within the limit are confirmed as well, in tiles of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placekeep.llm.common import map_rows
from placekeep.llm.minhash import confirm, set_digest, sets_of, still_open, tile_links, with_labels
from placekeep.llm.simhash import BROADCAST_IDS, SIMILARITY, components, limit_for, link_edges, packed, sketch_and_set, sketch_set
from placekeep.session import checkpointed


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, digest, n, fp): digest and size of each text's set of shingles, and its sketch as bytes."""

    def run(batch: pa.RecordBatch) -> list:
        made = [sketch_and_set(t.as_py()) for t in batch.column(1)]
        return [batch.column(0), pa.array([set_digest(s) for _, s in made], pa.binary()), pa.array([len(s) for _, s in made], pa.int64()), pa.array([fp for fp, _ in made], pa.binary())]

    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, digest binary, n long, fp binary")


def confirmed_links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """Links (a, b) between ``nodes`` (low, digest, n, fp) that connect all candidates of the similarity."""
    limit, percent = limit_for(similarity), round(100 * similarity)
    found = packed(link_edges(nodes.where("n > 0").select("fp", F.col("low").cast("long").alias("low")), limit).distinct())
    groups = components(found, packed)
    wanted = packed(groups.select("node"))
    sets = sets_of(docs, wanted, id_col, text_col, sketch_set)
    links = packed(confirm(found, sets, percent))
    labels = components(links, packed).select("node", F.col("component").alias("label"))
    alive = with_labels(sets, labels, percent).withColumn("node", F.col("node").cast("long"))
    members = still_open(packed(groups.withColumnRenamed("component", "key").join(alive, "node")))
    marks = nodes.select(F.col("low").cast("long").alias("node"), "digest", F.col("fp").alias("signature"))
    wide = marks.join(sets.select(F.col("node").cast("long").alias("node"), "digest", "shingles"), ["node", "digest"])
    near = lambda x, y: np.flatnonzero(np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= limit)
    rest = tile_links(members.drop("size").withColumn("keys", F.array("key")), wide, percent, near)
    # The first components' stars connect what their links do, and are taken together again in one round.
    stars = labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    return checkpointed(stars.unionByName(rest))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``id_col`` (an integer), fingerprint (the sketch in lowercase hex), component_id for each row.

    Texts link where the Jaccard similarity of their distinct shingles reaches
    ``similarity`` (in whole percent). Equal sets are one component, so are
    texts without words. Null texts, repeated ids, null ids and other columns as
    in ``simhash.near_duplicates``. An empty table gives no rows.
    """
    signed = checkpointed(sketches(docs, id_col, text_col))
    nodes = signed.groupBy("digest").agg(F.min(F.struct(F.col(id_col).isNull().alias("_null"), F.col(id_col).alias("low"), "n", "fp")).alias("m")).select("digest", "m.low", "m.n", "m.fp")
    nodes = checkpointed(nodes)
    links = confirmed_links(docs, nodes.where("low IS NOT NULL"), id_col, text_col, similarity)
    # One id may have rows of several sets; those belong together as well.
    several = signed.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select(id_col)
    again = signed.join(several, id_col, "left_semi").join(nodes.select("digest", "low"), "digest").where(F.col(id_col) != F.col("low"))
    labels = components(links.unionByName(again.select(F.col(id_col).cast("long").alias("a"), F.col("low").cast("long").alias("b"))), packed)
    named = nodes.select("digest", "low").join(labels, nodes["low"] == labels["node"], "left").select("digest", F.coalesce("component", "low").alias("component_id"))
    return signed.join(named, "digest").select(id_col, F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Rows of ``docs``, with all their columns: of each component of ``similar_documents`` the document of smallest id.

    Repeated rows of that id leave one. Rows with a null id stay.
    """
    labelled = similar_documents(docs, id_col, text_col, similarity).where(F.col(id_col).isNotNull())
    labelled = checkpointed(labelled.groupBy(id_col).agg(F.min("component_id").alias("_component"), F.count("*").alias("_rows")))

    def bounded(ids: DataFrame) -> DataFrame:
        ids = checkpointed(ids)
        return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    kept = docs.join(bounded(labelled.where(F.col(id_col) != F.col("_component")).select(id_col)), id_col, "left_anti").select(*docs.columns)
    several = checkpointed(labelled.where((F.col(id_col) == F.col("_component")) & (F.col("_rows") > 1)).select(id_col))
    if several.isEmpty():
        return kept
    once = kept.join(several, id_col, "left_semi").select(*docs.columns).dropDuplicates([id_col])
    return kept.join(several, id_col, "left_anti").select(*docs.columns).unionByName(once)
