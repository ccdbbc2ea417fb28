"""Ranked lexical search: WAND over document shards.

One pass over the documents builds the index: each task cuts its documents into
segments, and a segment holds, for the items' terms, the postings (document,
occurrences) in the order of the document ids. Texts are never shuffled. The
number of documents, their length and each term's document frequency are sums
over all segments. A second pass reads the segments: with the statistics, every
posting has its final impact and every term its largest one. An item goes
through a segment window by window. With its terms in the order of their largest
impacts, the pivot is the term at which their sum reaches the score of the
heap's last document; documents that only terms before it hold are skipped, and so
are those whose terms' largest impacts, added up, stay below that score. The
others are scored in full. Heaps live as long as their task, and a window
with a limit merges them.

All but the logarithm is integer arithmetic, so scores are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placekeep.llm.common import fold_table, give_back, word_parts
from placekeep.session import checkpointed, ship_package

#: Fixed values of the score.
SCALE, TF, LENGTH, SHARE, WEIGHT = 1_000_000_000, 1000, 12, 25, 1000
TOP = 20
#: Bytes of item texts whose terms are searched at once; more items take more passes.
BLOCK_BYTES = 4 << 20
#: Postings and documents at which a segment is closed.
SEGMENT_POSTINGS, SEGMENT_DOCUMENTS = 1 << 20, 1 << 16
#: Documents of a window.
WINDOW = 2048
#: ASCII letters and digits; all other characters belong to words.
WORDS = fold_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))

INDEX = "documents long, words long, ids array<long>, lengths array<long>, terms array<int>, sizes array<int>, places binary, counts binary"
FOUND = "number long, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    return [w for part in word_parts(text, WORDS) for w in part]


class _Segment:
    """Postings of one shard in the making."""

    def __init__(self) -> None:
        self.documents = self.words = self.postings = 0
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_id: int | None, text: str | None, get) -> None:
        length, found = 0, []
        for words in word_parts(text, WORDS):
            length += len(words)
            known = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
            found.append(known[known >= 0])
        if not length:
            return
        self.documents += 1
        self.words += length
        terms, counts = np.unique(np.concatenate(found), return_counts=True)
        if len(terms):
            self.ids.append(doc_id)
            self.lengths.append(length)
            self.terms.append(terms)
            self.counts.append(counts)
            self.postings += len(terms)

    def full(self) -> bool:
        return self.postings >= SEGMENT_POSTINGS or len(self.ids) >= SEGMENT_DOCUMENTS

    def row(self) -> dict:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        terms = np.concatenate([*self.terms, np.zeros(0, np.int32)])
        counts = np.concatenate([*self.counts, np.zeros(0, np.int64)])
        places = np.repeat(place, [len(t) for t in self.terms])
        by = np.lexsort((places, terms))
        names, sizes = np.unique(terms, return_counts=True)
        return {
            "documents": self.documents, "words": self.words, "ids": [self.ids[i] for i in order], "lengths": [self.lengths[i] for i in order],
            "terms": names.tolist(), "sizes": sizes.tolist(), "places": places[by].astype("<i4").tobytes(), "counts": counts[by].astype("<i8").tobytes(),
        }


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments with the postings of the words of ``vocabulary`` in whole texts; a checkpoint."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship_package(docs.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(INDEX))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, get = _Segment(), vocabulary.get
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                segment.add(doc_id, text.as_py(), get)
                if segment.full():
                    yield pa.RecordBatch.from_pylist([segment.row()], schema=arrow)
                    segment = _Segment()
        if segment.documents:
            yield pa.RecordBatch.from_pylist([segment.row()], schema=arrow)
        give_back()

    return checkpointed(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, INDEX))


def weight(documents: int, holding: int) -> int:
    return math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(counts: np.ndarray, lengths: np.ndarray, documents: int, words: int) -> np.ndarray:
    """A posting's part of the score before the term's weight; ``lengths`` of the postings' documents."""
    if len(lengths) and int(lengths.max()) * SHARE * documents >= 2**63:
        lengths = lengths.astype(object)
    share = 100 - SHARE + SHARE * lengths * documents // words
    return ((SCALE * counts) // (TF * counts + LENGTH * share)).astype(np.int64)


class Heap:
    """The best ``TOP`` documents of an item: score descending, then id ascending, nulls last."""

    def __init__(self, top: int) -> None:
        self.top = top
        self.scores, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """Score that a document must have; ids decide between equal scores."""
        return int(self.scores[-1]) if len(self.scores) >= self.top else 1

    def push(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.null, null)))
        best = np.lexsort((ids, null, -scores))[: self.top]
        self.scores, self.ids, self.null = scores[best], ids[best], null[best]


class Shard:
    """A segment with final impacts. A list is a term's documents, its postings' parts of the score, and the largest of them."""

    def __init__(self, row: dict, weights: np.ndarray, documents: int, words: int) -> None:
        self.null = np.array([i is None for i in row["ids"]], bool)
        self.ids = np.array([i or 0 for i in row["ids"]], np.int64)
        self.places, counts = np.frombuffer(row["places"], "<i4"), np.frombuffer(row["counts"], "<i8")
        ends = np.cumsum(row["sizes"])
        names = np.array(row["terms"], np.int64)
        parts = impacts(counts, np.array(row["lengths"], np.int64)[self.places], documents, words)
        self.parts = parts * np.repeat(weights[names], row["sizes"])
        self.slot = dict(zip(row["terms"], range(len(names))))
        starts = ends - row["sizes"]
        self.most = np.maximum.reduceat(self.parts, starts) if len(names) else np.zeros(0, np.int64)
        windows = np.arange(0, len(self.ids) + WINDOW, WINDOW)
        # Where each list enters each window.
        self.cuts = [a + np.searchsorted(self.places[a:b], windows) for a, b in zip(starts, ends)]

    def search(self, terms: list[tuple[int, int]], heap: Heap) -> int:
        """Fills the heap with the best documents for (term, repeats); gives the number of documents scored in full."""
        lists = [(int(self.most[s]) * n, s, n) for t, n in terms if (s := self.slot.get(t)) is not None and self.most[s] > 0]
        lists.sort()
        scored = 0
        for k, low in enumerate(range(0, len(self.ids), WINDOW)):
            here = [(most, self.cuts[s][k], self.cuts[s][k + 1], n) for most, s, n in lists if self.cuts[s][k] < self.cuts[s][k + 1]]
            least, before, pivot = heap.least(), 0, 0
            while pivot < len(here) and before + here[pivot][0] < least:
                before += here[pivot][0]
                pivot += 1
            if pivot == len(here):
                continue
            bound = np.zeros(WINDOW, np.int64)
            for most, a, b, _ in here[pivot:]:
                bound[self.places[a:b] - low] += most
            found = np.flatnonzero(bound)
            found = found[bound[found] + before >= least] + low
            if not len(found):
                continue
            for most, a, b, _ in reversed(here[:pivot]):
                # Terms before the pivot are only looked up for documents that are left.
                held = _among(self.places[a:b], found) >= 0
                bound[found[held] - low] += most
                before -= most
                found = found[bound[found - low] + before >= least]
            scores = np.zeros(len(found), np.int64)
            for _, a, b, n in here:
                at = _among(self.places[a:b], found)
                scores[at >= 0] += n * self.parts[a:b][at[at >= 0]]
            scored += len(found)
            good = scores >= least
            heap.push(scores[good], self.ids[found[good]], self.null[found[good]])
        return scored


def _among(places: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted document in an ascending list, or -1."""
    at = np.searchsorted(places, wanted)
    at[at == len(places)] = 0
    return np.where(places[at] == wanted, at, -1)


def _search_block(docs: DataFrame, items: list[tuple[int, list[bytes]]], top: int, id_col: str, text_col: str) -> DataFrame:
    """FOUND: the heaps of all tasks for these items."""
    spark = docs.sparkSession
    vocabulary = {t: k for k, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    wanted = []
    for number, terms in items:
        repeats: dict[int, int] = {}
        for t in terms:
            repeats[vocabulary[t]] = repeats.get(vocabulary[t], 0) + 1
        wanted.append((number, sorted(repeats.items())))
    index = build_index(docs, vocabulary, id_col, text_col)
    documents, words = (x or 0 for x in index.agg(F.sum("documents"), F.sum("words")).first())
    held = np.zeros(max(1, len(vocabulary)), np.int64)
    # One row for each term of the block at most.
    for term, n in index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).groupBy("t.terms").agg(F.sum("t.sizes")).collect():
        held[term] = n
    weights = np.array([weight(documents, int(n)) for n in held], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [Heap(top) for _ in wanted]
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard(batch.slice(k, 1).to_pylist()[0], weights, documents, words)
                for (_, terms), heap in zip(wanted, heaps, strict=True):
                    shard.search(terms, heap)
        for (number, _), heap in zip(wanted, heaps, strict=True):
            if len(heap.scores):
                ids = pa.array(heap.ids, mask=heap.null)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(heap.ids), number)), ids, pa.array(heap.scores)], names=["number", "doc_id", "score"])
        give_back()

    ship_package(spark)
    return index.mapInArrow(run, FOUND)


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_col``, rank, ``id_col``, score: the ``top`` best documents of each item, of those that score above 0.

    Null and empty texts, and those without a letter or digit, have no terms:
    such documents don't count and such items have no rows. Every row of
    ``docs`` is a document, rows of one id as well; null ids come last among
    equal scores. Equal rows of ``items`` are one item; further texts of one
    ``item_col`` are ranked on their own. Very long texts are read in parts.
    Empty tables give no rows. Other columns are ignored.

    Items are dealt to blocks of some ``BLOCK_BYTES`` of text, which the
    driver and every task hold; each block is a pass over the documents.
    """
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL").distinct().withColumn("number", F.xxhash64("item", "text"))
    asked = checkpointed(asked)
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    found: DataFrame | None = None
    for k in range(blocks):
        rows = asked.where(F.pmod("number", F.lit(blocks)) == k).select("number", "text").collect()
        part = _search_block(docs, [(r.number, terms_of(r.text)) for r in rows], top, id_col, text_col)
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    names = asked.select("number", "item")
    return best.join(names, "number").select(F.col("item").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")
