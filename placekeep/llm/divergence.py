"""Divergence of a language's sources, by mergeable radix tries of their terms.

Each task counts the terms of its documents and writes them as byte tries, one
for each language, whose leaves hold the number of documents and a count for each
source. A written trie is the order in which a walk passes its leaves, the order of
UTF-8, with the depth at which each leaves the path of the one before; it comes in runs. Borders of prefix ranges are taken from the runs'
first terms, runs are cut at the borders, and each range merges its runs into one
trie again, whose walk gives the kept terms in order. A second walk compares the
sources' shares over the kept terms; per-source candidates stream out with ties
in the order of the terms.
"""

from __future__ import annotations

import bisect
import heapq
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placekeep.llm.common import fold_table, give_back, word_parts
from placekeep.session import checkpointed, ship_package

#: Fixed values of the contract.
LEAST_DOCUMENTS, SCALE, SMOOTH, TOP = 10, 1_000_000_000, 2, 10
#: Counters that a task holds before it turns them into tries.
ENTRIES = 600_000
#: Leaves of a run, and of a prefix range, about.
RUN, RANGE = 512, 200_000
#: First terms that the ranges' borders are taken from, at most about, and their bytes.
SAMPLE, BORDER = 50_000, 64
#: Languages and sources that are broadcast with their totals; more are joined by a shuffle.
BROADCAST_GROUPS = 200_000
#: ASCII letters; all characters beyond ASCII belong to words.
WORDS = fold_table((0x41, 0x5A), (0x61, 0x7A))

#: A run: leaves in order, each the length it shares with the one before, the rest of its term, its documents, and counts by source.
RUNS = "lang string, first binary, last binary, leaves int, shared binary, rest binary, sizes binary, documents binary, sources array<string>, degrees binary, who binary, counts binary"


class Trie:
    """Radix trie over bytes. A node is [leaf, {first byte: (label, node)}], a leaf [documents, {source: count}]."""

    def __init__(self) -> None:
        self.root: list = [None, {}]

    def leaf(self, term: bytes) -> list:
        """The leaf of a term, made if there is none."""
        node, at, end = self.root, 0, len(term)
        while at < end:
            edge = node[1].get(term[at])
            if edge is None:
                below: list = [None, {}]
                node[1][term[at]] = (term[at:], below)
                node = below
                break
            label, below = edge
            if not term.startswith(label, at):
                k = 1
                while at + k < end and label[k] == term[at + k]:
                    k += 1
                middle: list = [None, {label[k]: (label[k:], below)}]
                node[1][term[at]] = (label[:k], middle)
                label, below = label[:k], middle
            node, at = below, at + len(label)
        if node[0] is None:
            node[0] = [0, {}]
        return node[0]

    def add(self, term: bytes, documents: int, counts: Iterable[tuple[str, int]]) -> None:
        leaf = self.leaf(term)
        leaf[0] += documents
        held = leaf[1]
        for source, n in counts:
            held[source] = held.get(source, 0) + n

    def walk(self) -> Iterator[tuple[bytes, list]]:
        """Terms with their leaves in the order of their bytes."""
        todo = [(b"", self.root)]
        while todo:
            term, node = todo.pop()
            if node[0] is not None:
                yield term, node[0]
            todo.extend((term + label, below) for _, (label, below) in sorted(node[1].items(), reverse=True))


def _small(values: list[int] | np.ndarray) -> bytes:
    """Integers with the width of the greatest before them."""
    a = np.array(values, np.int64)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(a) or int(a.max()) < 1 << (8 * w))
    return bytes([width]) + a.astype(f"<u{width}").tobytes()


def _large(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _shared(terms: list[bytes]) -> list[int]:
    """Bytes that each term has in common with the one before: where the trie's walk branches off."""
    out, before = [], b""
    for term in terms:
        k = 0
        for x, y in zip(before, term):
            if x != y:
                break
            k += 1
        out.append(k)
        before = term
    return out


def pack_runs(lang: str, terms: list[bytes], documents: np.ndarray, sources: list[str], who: np.ndarray, counts: np.ndarray, degrees: np.ndarray, most: int = RUN) -> Iterator[dict]:
    """Rows of RUNS from the leaves of a trie in order: for each term, its documents and ``degrees`` counts by source."""
    ends = np.concatenate([[0], np.cumsum(degrees)])
    for at in range(0, len(terms), most):
        some = terms[at : at + most]
        shared = _shared(some)
        here = slice(ends[at], ends[at + len(some)])
        names, mine = np.unique(who[here], return_inverse=True)
        yield {
            "lang": lang, "first": some[0], "last": some[-1], "leaves": len(some), "shared": _small(shared), "rest": b"".join([t[k:] for t, k in zip(some, shared, strict=True)]),
            "sizes": _small([len(t) - k for t, k in zip(some, shared, strict=True)]), "documents": _small(documents[at : at + most]), "sources": [sources[k] for k in names],
            "degrees": _small(degrees[at : at + most]), "who": _small(mine), "counts": _small(counts[here]),
        }


def terms_of_run(row: dict) -> list[bytes]:
    out, rest, term, at = [], row["rest"], b"", 0
    for shared, size in zip(_large(row["shared"]).tolist(), _large(row["sizes"]).tolist(), strict=True):
        term = term[:shared] + rest[at : at + size]
        out.append(term)
        at += size
    return out


def cut_run(row: dict, number_of) -> Iterator[tuple[int, dict]]:
    """(range, run) for each prefix range that a run's terms fall in."""
    terms = terms_of_run(row)
    numbers = np.array([number_of(t) for t in terms])
    counts, who, documents, degrees = (_large(row[c]) for c in ("counts", "who", "documents", "degrees"))
    ends = np.concatenate([[0], np.cumsum(degrees)])
    starts = np.flatnonzero(np.diff(numbers, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(terms)]):
        here = slice(ends[a], ends[b])
        for out in pack_runs(row["lang"], terms[a:b], documents[a:b], row["sources"], who[here], counts[here], degrees[a:b], most=len(terms)):
            yield int(numbers[a]), out


def unpack_run(row: dict) -> Iterator[tuple[bytes, int, list[tuple[str, int]]]]:
    """(term, documents, counts by source) of a run, in order."""
    names, k = row["sources"], 0
    pairs = list(zip([names[i] for i in _large(row["who"]).tolist()], _large(row["counts"]).tolist(), strict=True))
    for term, documents, degree in zip(terms_of_run(row), _large(row["documents"]).tolist(), _large(row["degrees"]).tolist(), strict=True):
        yield term, documents, pairs[k : k + degree]
        k += degree


class _Counts:
    """Terms of a task's documents, until they are turned into tries."""

    def __init__(self) -> None:
        self.documents: dict[str, Counter] = defaultdict(Counter)
        self.counts: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def add(self, lang: str, source: str, text: str | None) -> None:
        seen: set[bytes] = set()
        counts = self.counts[lang, source]
        for words in word_parts(text, WORDS):
            counts.update(words)
            seen.update(words)
        seen.add(b"")
        self.documents[lang].update(seen)

    def entries(self) -> int:
        return sum(map(len, self.documents.values())) + sum(map(len, self.counts.values()))

    def runs(self) -> Iterator[dict]:
        """The counts as written tries, from sorted terms. The empty term stands for the documents themselves and holds every source."""
        for lang in sorted(self.documents):
            documents = self.documents[lang]
            terms = sorted(documents)
            place = dict(zip(terms, range(len(terms))))
            sources = sorted(s for k, s in self.counts if k == lang)
            # The empty term has every source, with a count of 0.
            at, who, counts = [np.zeros(len(sources), np.int64)], [np.arange(len(sources))], [np.zeros(len(sources), np.int64)]
            for k, source in enumerate(sources):
                held = self.counts[lang, source]
                at.append(np.fromiter(map(place.__getitem__, held), np.int64, len(held)))
                who.append(np.full(len(held), k))
                counts.append(np.fromiter(held.values(), np.int64, len(held)))
            at, who, counts = (np.concatenate(x) for x in (at, who, counts))
            by = np.argsort(at, kind="stable")
            yield from pack_runs(lang, terms, np.fromiter(map(documents.__getitem__, terms), np.int64, len(terms)), sources, who[by], counts[by], np.bincount(at, minlength=len(terms)))


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """RUNS of each task's tries; a checkpoint."""
    ship_package(docs.sparkSession)
    arrow = _arrow(RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, new = _Counts(), 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py()
                held.add(lang, source, text)
                new += len(text or "")
                if new >= 1 << 20:
                    new = 0
                    if held.entries() >= ENTRIES:
                        for row in held.runs():
                            yield pa.RecordBatch.from_pylist([row], schema=arrow)
                        held = _Counts()
        for row in held.runs():
            yield pa.RecordBatch.from_pylist([row], schema=arrow)
        give_back()

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col)]
    return checkpointed(docs.select(named[0].alias("lang"), named[1].alias("source"), F.col(text_col).alias("text")).mapInArrow(run, RUNS))


def merge_ranges(runs: DataFrame) -> DataFrame:
    """One row for each language and term of LEAST_DOCUMENTS documents or more, and for the empty term: lang, term, documents, sources, counts; a checkpoint."""
    size, leaves = runs.agg(F.count("*"), F.sum("leaves")).first()
    ranges = max(1, -(-(leaves or 0) // RANGE))
    part = min(1_000_000, SAMPLE * 1_000_000 // max(1, size) + 1)
    short = F.substring("first", 1, BORDER)
    sample = runs.where(F.pmod(F.xxhash64("lang", "first", "last"), F.lit(1_000_000)) < part).select("lang", short.alias("first")).collect()
    firsts = sorted((r.lang.encode(), bytes(r.first)) for r in sample)
    borders = sorted({firsts[k * len(firsts) // ranges] for k in range(1, ranges)}) if firsts else []
    arrow = _arrow("range int, " + RUNS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                name = row["lang"].encode()
                number = bisect.bisect_right(borders, (name, row["first"]))
                if number == bisect.bisect_right(borders, (name, row["last"])):
                    out.append(row | {"range": number})
                    continue
                out += [some | {"range": k} for k, some in cut_run(row, lambda t: bisect.bisect_right(borders, (name, t)))]  # noqa: B023
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        give_back()

    kept = "lang string, term string, documents long, sources array<string>, counts array<long>"
    shape = _arrow(kept)

    def merge(group: pa.Table) -> pa.Table:
        tries: dict[str, Trie] = defaultdict(Trie)
        for batch in group.to_batches(max_chunksize=16):
            for row in batch.to_pylist():
                for term, documents, counts in unpack_run(row):
                    tries[row["lang"]].add(term, documents, counts)
        out = []
        for lang, trie in sorted(tries.items()):
            for term, (documents, counts) in trie.walk():
                if documents >= LEAST_DOCUMENTS or not term:
                    out.append((lang, term.decode(), documents, list(counts), list(counts.values())))
        columns = list(zip(*out)) if out else [[]] * len(shape)
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, shape)], schema=shape)

    dealt = runs.mapInArrow(deal, "range int, " + RUNS)
    return checkpointed(dealt.groupBy("range").applyInArrow(merge, kept))


def _floor_share(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """p of each count; exact whatever the size."""
    if len(counts) and int(counts.max()) >= 2**63 // SCALE - SMOOTH:
        counts = counts.astype(object)
    return (1 + SCALE * (counts + SMOOTH) // total).astype(np.int64)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: how far each source's terms stand from those of the other sources of its language.

    Part ``pair`` has a row for each two sources of a language, part ``term`` the
    ten terms that a source has most above its language. Null texts, languages
    and sources count as ''. A source without terms has rows too. Every row is
    a document, repeated ones as well. Very long texts are read in parts. An
    empty table gives no rows. Other columns are ignored.
    """
    terms = merge_ranges(count_terms(docs, text_col, lang_col, source_col))
    kept = terms.where("term <> ''")
    sums = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    groups = terms.where("term = ''").select("lang", F.explode("sources").alias("source")).distinct().join(sums, ["lang", "source"], "left").fillna(0, ["n"])
    sizes = kept.groupBy("lang").agg(F.count("*").alias("size"))
    # One row for each language: its sources with their sums, in the order of their names.
    totals = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups")).join(sizes, "lang", "left").fillna(0, ["size"])
    totals = checkpointed(totals.select("lang", F.col("groups.source").alias("names"), F.col("groups.n").alias("sums"), "size"))
    few = (totals.agg(F.sum(F.size("names"))).first()[0] or 0) <= BROADCAST_GROUPS
    names = F.broadcast(totals) if few else totals

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between: dict[tuple[str, str, str], int] = defaultdict(int)
        best: dict[tuple[str, str], list] = defaultdict(list)
        for batch in batches:
            rows: dict[str, list[dict]] = defaultdict(list)
            for row in batch.to_pylist():
                rows[row["lang"]].append(row)
            for lang, some in rows.items():
                names, sums, size = some[0]["names"], some[0]["sums"], some[0]["size"]
                index = {s: k for k, s in enumerate(names)}
                counts = np.zeros((len(names), len(some)), np.int64)
                for k, row in enumerate(some):
                    counts[[index[s] for s in row["sources"]], k] = row["counts"]
                p = np.stack([_floor_share(counts[i], sums[i] + 2 * size) for i in range(len(names))])
                whole = _floor_share(counts.sum(0), sum(sums) + 2 * size)
                for i, source in enumerate(names):
                    for j in range(i):
                        f = int(_apart(p[i], p[j]).sum())
                        between[lang, source, names[j]] += f
                        between[lang, names[j], source] += f
                    above = np.flatnonzero((counts[i] > 0) & (p[i] > whole))
                    value = _apart(p[i, above], whole[above])
                    found = zip((-value).tolist(), (some[k]["term"].encode() for k in above), strict=True)
                    best[lang, source] = heapq.nsmallest(TOP, [*best[lang, source], *found])
        out = [(*k, "pair", v) for k, v in between.items()] + [(*k, term.decode(), "term", -v) for k, some in best.items() for v, term in some]
        for at in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out[at : at + 10_000])], names=["lang", "source", "item", "part", "value"])
        give_back()

    found = checkpointed(kept.select("lang", "term", "sources", "counts").join(names, "lang").mapInArrow(compare, "lang string, source string, item string, part string, value long"))
    # Every pair has a row, those of languages without kept terms too.
    empty = totals.select("lang", F.explode("names").alias("source"), "names").select("lang", "source", F.explode("names").alias("item")).where("source <> item")
    pairs = found.where("part = 'pair'").select("lang", "source", "item", "value").unionByName(empty.withColumn("value", F.lit(0).cast("long")))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", F.row_number().over(w)).unionByName(best).select("lang", "source", "part", "item", "value", "rank")
