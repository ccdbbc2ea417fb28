"""Toxicity by nearest labelled examples.

A bounded sample of labelled texts is the example set. Terms are all words and
word beginnings of the examples of both classes, named by 64-bit hashes; texts
become TF-IDF vectors over them, with document frequencies counted over all documents. A term's
weight grows with its log-likelihood ratio against the labels; no term is left
out. An inverted index lists the examples of each term. Lists of rare terms are
short and are read whole; a frequent term has for each block of examples its
greatest weight there. A query's sums over the short lists, and the block
bounds of its frequent terms, show which examples can still be among the k of
greatest cosine; only those get the rest of their sum, so the k nearest
examples are exact. Votes weighted by cosine give a raw score, which is
calibrated on the examples themselves, each left out in turn.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placekeep.llm.common import give_back, is_held_out, map_rows, worker_state
from placekeep.session import checkpointed, ship_package

#: Labelled examples of each class, at most about; chosen by a hash of the id.
EXAMPLES = 2_000
#: A term of this log-likelihood ratio against the labels (the 5 % point of chi-square) weighs twice its TF-IDF.
DOUBLE_G = 3.84
#: Lengths of word beginnings that are terms as well.
PREFIXES = (4,)
#: Examples in a block.
BLOCK = 32
#: A term in more than this share of the examples is frequent; the most frequent ones at most.
FREQUENT_SHARE, FREQUENT = 1 / 64, 1_024
NEIGHBOURS = 15
#: Weight of the prior in the vote.
PRIOR = 0.5
#: Texts, and characters of them, that are taken together; a longer text is alone and read in pieces.
TOGETHER, CHARACTERS = 32, 1 << 17
#: Scores from which a text counts as toxic.
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"[\W\d_]")
#: Odd numbers for hashing.
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_WRAP = (1 << 64) - 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    out = np.zeros(0x110000, bool)
    for at in range(0, len(out), 4096):
        for m in _WORD.finditer("".join(map(chr, range(at, at + 4096)))):
            out[at + m.start() : at + m.end()] = True
    return out


@lru_cache(maxsize=1)
def _powers(log: int) -> np.ndarray:
    return np.cumprod(np.full(1 << log, _BASE, np.uint64))


def _mixed(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x ^ np.uint64(kind)) * np.uint64(_MIX)
    x ^= x >> np.uint64(32)
    x *= np.uint64(_MIX)
    return x ^ (x >> np.uint64(32))


def term_hash(letters: str, prefix: int = 0) -> int:
    """The 64 bits that name a whole word, or the beginning of ``prefix`` letters: sum of code points times powers of an odd number, mixed."""
    total = sum(ord(c) * pow(_BASE, i + 1, 1 << 64) for i, c in enumerate(letters))
    return int(_mixed(np.array([total & _WRAP], np.uint64), prefix)[0])


def pieces(text: str | None) -> Iterator[str]:
    """The text in lower case, divided between words into pieces of about bounded length."""
    line, at = (text or "").lower(), 0
    while len(line) - at > CHARACTERS:
        gap = _GAP.search(line, at + CHARACTERS)
        end = gap.start() if gap else len(line)
        yield line[at:end]
        at = end
    yield line[at:] if at else line


def together(texts: list[str | None]) -> Iterator[slice]:
    """Runs of neighbouring texts of bounded number and length."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > first and (i - first == TOGETHER or size + n > CHARACTERS):
            yield slice(first, i)
            first, size = i, 0
        size += n
    if first < len(texts):
        yield slice(first, len(texts))


def lists_of(column: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a batch, so that few at a time are Python strings."""
    for at in range(0, len(column), 8 * TOGETHER):
        yield column.slice(at, 8 * TOGETHER).to_pylist()


def hashed_terms(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the line and hash of each word and word beginning."""
    code = np.frombuffer(" ".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    edges = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    line = np.searchsorted(np.cumsum([len(x) + 1 for x in lines]), starts, "right")
    code = code[letter].astype(np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(code)) - np.repeat(first, lengths)
    code *= _powers(max(6, int(lengths.max()).bit_length()))[place]
    at, hashes = [line], [_mixed(np.add.reduceat(code, first), 0)]
    for n in PREFIXES:
        long = first[lengths >= n]
        at.append(line[lengths >= n])
        hashes.append(_mixed(sum((code[long + i] for i in range(1, n)), code[long]), n))
    return np.concatenate(at), np.concatenate(hashes)


class Counts(NamedTuple):
    """Terms of several texts: number of the text, of the term, and how often; in order of both."""

    text: np.ndarray
    term: np.ndarray
    n: np.ndarray


class Terms:
    """Numbers of the terms whose hashes are given, sorted; without any, each hash is its own number."""

    def __init__(self, hashes: np.ndarray | None) -> None:
        self.hashes = hashes
        if hashes is not None:
            bits = max(1, len(hashes).bit_length())
            self.shift = np.uint64(64 - bits)
            self.first = np.searchsorted(hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        bucket = (hashes >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        out = np.full(len(hashes), -1, np.int64)
        todo = np.flatnonzero(at < end)
        while len(todo):
            own = at[todo]
            same = self.hashes[own] == hashes[todo]
            out[todo[same]] = own[same]
            at[todo] += 1
            todo = todo[~same & (own + 1 < end[todo])]
        return out

    def counts(self, texts: list[str | None]) -> Counts:
        """Texts of :func:`together`; only a text that is alone has several pieces."""
        parts = []
        lines = [(i, x) for i, text in enumerate(texts) for x in pieces(text)]
        for run in [lines] if len(lines) == len(texts) else [[x] for x in lines]:
            line, term = hashed_terms([x for _, x in run])
            text = np.array([i for i, _ in run])[line]
            if self.hashes is not None:
                term = self.numbers(term)
                text, term = text[term >= 0], term[term >= 0]
                key, n = np.unique(text * len(self.hashes) + term, return_counts=True)
                parts.append(Counts(key // max(1, len(self.hashes)), key % max(1, len(self.hashes)), n.astype(np.float64)))
            else:
                order = np.lexsort((term, text))
                parts.append(summed(text[order], term[order], np.ones(len(order))))
        if len(parts) == 1:
            return parts[0]
        text, term, n = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((term, text))
        return summed(text[order], term[order], n[order])


def summed(text: np.ndarray, term: np.ndarray, n: np.ndarray) -> Counts:
    """Equal neighbours added up."""
    if not len(text):
        return Counts(text, term, n)
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (term[1:] != term[:-1])])
    return Counts(text[new], term[new], np.add.reduceat(n, new))


def unit_vectors(counts: Counts, idf: np.ndarray, texts: int) -> np.ndarray:
    """Weights of the terms, each text's of length one."""
    w = (1.0 + np.log(counts.n)) * idf[counts.term]
    norm = np.sqrt(np.bincount(counts.text, w * w, texts))
    norm[norm == 0] = 1.0
    return w / norm[counts.text]


def numbered(sets: list[np.ndarray], times: list[np.ndarray]) -> tuple[Counts, np.ndarray]:
    """Counts of texts with these ascending hashes (as signed integers) and numbers of each, and all hashes in order; four bytes a number."""
    hashes = np.unique(np.concatenate(sets).view(np.uint64))
    ends = np.cumsum([len(x) for x in sets])
    term, n = np.empty(ends[-1], np.int32), np.empty(ends[-1], np.int32)
    for x, k, end in zip(sets, times, ends):
        term[end - len(x) : end], n[end - len(x) : end] = np.searchsorted(hashes, x.view(np.uint64)), k
    return Counts(np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets]), term, n), hashes


class Index(NamedTuple):
    """Examples in an order that brings alike ones into one block."""

    doc_ids: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    #: Place of each term among the frequent ones, or -1.
    place: np.ndarray
    #: Weights of the frequent terms by example, and the greatest by block.
    frequent: np.ndarray
    block_max: np.ndarray
    #: Examples and weights by term, without the frequent ones.
    lists: np.ndarray
    list_examples: np.ndarray
    list_weights: np.ndarray

    def __reduce__(self):
        """Only the vectors are sent; workers arrange them and keep the arrangement alone."""
        return searchable, (*self[:6], len(self.place))


def build_index(doc_ids: np.ndarray, labels: np.ndarray, counts: Counts, idf: np.ndarray, class_weight: tuple[float, float]) -> Index:
    """``counts`` are those of the examples ``doc_ids``; one without terms is near to nothing."""
    return arranged(*example_vectors(doc_ids, labels, counts, idf, class_weight))


def example_vectors(doc_ids: np.ndarray, labels: np.ndarray, counts: Counts, idf: np.ndarray, class_weight: tuple[float, float]) -> tuple:
    """What :func:`arranged` takes; examples are weighed in parts, as the driver should hold little besides their vectors."""
    n = len(doc_ids)
    starts = np.searchsorted(counts.text, np.arange(n + 1))
    size = np.bincount(counts.term, minlength=len(idf))
    weights, lead = np.empty(len(counts.term)), np.full(n, len(idf), np.int64)
    for a in range(0, n, 8 * TOGETHER):
        b = min(n, a + 8 * TOGETHER)
        own = slice(starts[a], starts[b])
        text, term = counts.text[own] - a, counts.term[own]
        w = weights[own] = unit_vectors(Counts(text, term, counts.n[own]), idf, b - a)
        # By each example's strongest frequent term, so that a block's maxima are near its examples' weights.
        strong = np.lexsort((-w, size[term] <= n * FREQUENT_SHARE, text))
        found, first = np.unique(text[strong], return_index=True)
        lead[a + found] = term[strong][first]
    order = np.lexsort((doc_ids, lead))
    labels = labels[order]
    ordered = lambda x: np.concatenate([x[:0], *(x[starts[i] : starts[i + 1]] for i in order)])
    terms, weights = ordered(counts.term).astype(np.int32, copy=False), ordered(weights)
    starts = np.concatenate([[0], np.cumsum(np.diff(starts)[order])])
    return doc_ids[order], labels, np.array(class_weight)[labels], starts, terms, weights, len(idf)


def arranged(doc_ids: np.ndarray, labels: np.ndarray, votes: np.ndarray, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int) -> Index:
    """The index of vectors that are in order."""
    n, size = len(doc_ids), np.bincount(terms, minlength=n_terms)
    most = np.argsort(-size, kind="stable")[:FREQUENT]
    most = most[size[most] > n * FREQUENT_SHARE]
    place = np.full(n_terms, -1, np.int64)
    place[most] = np.arange(len(most))
    example = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))
    often = (place >= 0)[terms]
    frequent = np.zeros((n, len(most)))
    frequent[example[often], place[terms[often]]] = weights[often]
    block_max = np.maximum.reduceat(frequent, np.arange(0, n, BLOCK), axis=0).T.copy() if n else np.zeros((len(most), 0))
    rare = np.flatnonzero(~often)
    lists = np.concatenate([[0], np.cumsum(np.bincount(terms[rare], minlength=n_terms))])
    rare = rare[np.argsort(terms[rare], kind="stable")]
    return Index(doc_ids, labels, votes, starts, terms, weights, place, frequent, block_max, lists, example[rare], weights[rare])


def searchable(*vectors) -> Index:
    """:func:`arranged` without the vectors by example, which a search doesn't read."""
    return arranged(*vectors)._replace(starts=None, terms=None, weights=None)


def nearest(index: Index, text: np.ndarray, term: np.ndarray, weight: np.ndarray, texts: int, k: int = NEIGHBOURS, leave: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the k examples of greatest positive cosine (ties: first in the index) and their cosines.

    ``text``, ``term`` and ``weight`` are the texts' vectors; ``leave`` names an example for each text that is left out.
    """
    n = len(index.doc_ids)
    if not n:
        return [(np.zeros(0, np.int64), np.zeros(0))] * texts
    place = index.place[term]
    rare = np.flatnonzero(place < 0)
    often = np.flatnonzero(place >= 0)
    first = index.lists[term[rare]]
    size = index.lists[term[rare] + 1] - first
    # One entry for each query term and example of its list.
    of = np.repeat(np.arange(len(rare)), size)
    at = (first - (np.cumsum(size) - size))[of]
    at += np.arange(len(of))
    cell = (text[rare] * n)[of]
    cell += index.list_examples[at]
    product = weight[rare][of]
    product *= index.list_weights[at]
    sums = np.bincount(cell, product, texts * n).reshape(texts, n)
    query = np.zeros((texts, index.frequent.shape[1]))
    query[text[often], place[often]] = weight[often]
    bound = query @ index.block_max + 1e-9
    if leave is not None:
        sums[np.arange(texts), leave] = -2.0
    least = np.full(texts, 1e-12)
    if n > k:
        # The k best of the short lists in full: the k-th best of all is no worse.
        some = np.argpartition(sums, n - k, axis=1)[:, n - k :]
        whole = np.take_along_axis(sums, some, 1) + np.einsum("qkf,qf->qk", index.frequent[some], query)
        least = np.maximum(whole.min(1) - 1e-9, 1e-12)
    # A block is completed for the texts that its bound still concerns.
    opened = np.maximum.reduceat(sums, np.arange(0, n, BLOCK), axis=1) + bound >= least[:, None]
    cosine = np.full((texts, n), -2.0)
    for block in np.flatnonzero(opened.any(0)).tolist():
        who, own = np.flatnonzero(opened[:, block]), slice(block * BLOCK, (block + 1) * BLOCK)
        cosine[who, own] = sums[who, own] + query[who] @ index.frequent[own].T
    if n > k:
        least = np.maximum(np.partition(cosine, n - k, axis=1)[:, n - k] - 1e-11, 1e-12)
    who, near = np.nonzero(cosine >= least[:, None])
    found = cosine[who, near]
    order = np.lexsort((near, -found.round(12), who))
    near, found = near[order], found[order]
    ends = np.searchsorted(who, np.arange(texts + 1)).tolist()
    return [(near[a : min(b, a + k)], found[a : min(b, a + k)]) for a, b in zip(ends, ends[1:])]


class Model(NamedTuple):
    #: Hashes of the terms, sorted.
    terms: np.ndarray
    idf: np.ndarray
    index: Index
    prior: float
    slope: float
    shift: float


NO_INDEX = build_index(np.zeros(0, np.int64), np.zeros(0, np.int64), Counts(*(np.zeros(0, np.int64),) * 3), np.zeros(0), (1.0, 1.0))


def raw_score(index: Index, i: np.ndarray, s: np.ndarray, prior: float) -> float:
    vote = s * index.votes[i]
    return float((vote @ index.labels[i] + PRIOR * prior) / (vote.sum() + PRIOR))


def _logit(p: float | np.ndarray):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with a small pull to the identity."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * weight * x).sum() + (a - 1), ((p - y) * weight).sum() + b])
        h = p * (1 - p) * weight
        m = np.array([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum() + 1]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES) -> Model:
    """Terms, index and calibration. Held-out ids, null texts and null labels are not learned from.

    Documents with conflicting labels take the greatest one. Only the examples'
    term counts (``examples`` of each class) and the document frequencies of
    their terms come to the driver.
    """
    ship_package(docs.sparkSession)
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(F.col(id_col))).groupBy(id_col).agg(F.max((F.col(label_col) != 0).cast("int")).alias("_label"))
    sizes = {r[0]: r[1] for r in marks.groupBy("_label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(np.zeros(0, np.uint64), np.zeros(0), NO_INDEX, 0.0 if n0 or not n1 else 1.0, 1.0, 0.0)
    share = F.when(F.col("_label") == 1, min(1_000_000, 1_000_000 * examples // n1 + 1)).otherwise(min(1_000_000, 1_000_000 * examples // n0 + 1))
    chosen = marks.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("example")), F.lit(1_000_000)) < share)
    # The chosen ids are bounded by ``examples`` of each class.
    sample = checkpointed(docs.select(id_col, text_col).where(F.col(text_col).isNotNull()).join(F.broadcast(chosen), id_col).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), "_label"))

    def vectors(batch: pa.RecordBatch) -> list:
        terms, texts, found, times = Terms(None), batch.column(1).to_pylist(), [], []
        for own in together(texts):
            c = terms.counts(texts[own])
            ends = np.searchsorted(c.text, np.arange(own.stop - own.start + 1))
            found += [c.term[a:b].view(np.int64) for a, b in zip(ends, ends[1:])]
            times += [c.n[a:b].astype(np.int32) for a, b in zip(ends, ends[1:])]
        return [batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int64()), found, times]

    rows = map_rows(sample, vectors, "doc_id long, label long, terms array<long>, counts array<int>").toArrow()
    if not rows.num_rows:
        return Model(np.zeros(0, np.uint64), np.zeros(0), NO_INDEX, n1 / (n0 + n1), 1.0, 0.0)
    # Repeated ids stand in a fixed order.
    sets, times = ([x.values.to_numpy() for x in rows[c]] for c in ("terms", "counts"))
    names = list(zip(rows["doc_id"].to_pylist(), rows["label"].to_pylist(), map(len, sets)))
    again = {name for name, n in Counter(names).items() if n > 1}
    order = sorted(range(len(names)), key=lambda i: (names[i], sets[i].tobytes(), times[i].tobytes()) if names[i] in again else (names[i],))
    doc_ids, labelled = (np.array([names[i][k] for i in order], np.int64) for k in (0, 1))
    counts, hashes = numbered([sets[i] for i in order], [times[i] for i in order])
    del rows, sets, times
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(hashes)

    def frequencies(batch: pa.RecordBatch) -> list:
        terms = worker_state(key, lambda: Terms(shared.value))
        seen = np.zeros(len(terms.hashes) + 1, np.int64)
        for texts in lists_of(batch.column(0)):
            for own in together(texts):
                np.add.at(seen, terms.counts(texts[own]).term, 1)
        seen[-1] = batch.num_rows
        at = np.flatnonzero(seen)
        return [pa.array(at), pa.array(seen[at])]

    counted = map_rows(docs.select(text_col), frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(len(hashes) + 1)
    seen[counted["term"].to_numpy()] = counted["n"].to_numpy()

    m1 = int(labelled.sum())
    m0 = len(labelled) - m1
    if not m0 or not m1:
        return Model(np.zeros(0, np.uint64), np.zeros(0), NO_INDEX, n1 / (n0 + n1), 1.0, 0.0)
    toxic = labelled.astype(bool)[counts.text]
    in1, in0 = (np.bincount(counts.term[own], minlength=len(hashes)).astype(float) for own in (toxic, ~toxic))

    def part(n: np.ndarray, total: float, all_n: np.ndarray) -> np.ndarray:
        """One cell of the log-likelihood ratio."""
        return n * np.log(np.maximum(n, 1) / np.maximum(total * all_n / (m0 + m1), 1e-300))

    with_term, without = in0 + in1, m0 + m1 - in0 - in1
    g = 2 * (part(in0, m0, with_term) + part(in1, m1, with_term) + part(m0 - in0, m0, without) + part(m1 - in1, m1, without))
    idf = (np.log((1 + seen[-1]) / (1 + seen[:-1])) + 0.1) * (1 + np.maximum(g, 0) / DOUBLE_G)
    weight = (n0 / m0, n1 / m1)
    size = np.bincount(counts.text, minlength=len(order))
    vectors = example_vectors(doc_ids, labelled, counts, idf, weight)
    del counts, toxic
    give_back()
    index = arranged(*vectors)
    bare = labelled[size == 0]
    prior = (weight[1] * bare.sum() + 0.5) / (weight[1] * bare.sum() + weight[0] * (len(bare) - bare.sum()) + 1.0 + 0.5 * n0 / n1)
    raw = np.zeros(len(order))
    for a in range(0, len(order), TOGETHER):
        some = np.arange(a, min(a + TOGETHER, len(order)))
        own = slice(index.starts[a], index.starts[some[-1] + 1])
        text = np.repeat(some - a, np.diff(index.starts)[some])
        for i, (near, cosine) in zip(some, nearest(index, text, index.terms[own], index.weights[own], len(some), leave=some)):
            raw[i] = raw_score(index, near, cosine, prior)
    slope, shift = calibrate(_logit(raw), index.labels.astype(float), index.votes)
    give_back()
    return Model(hashes, idf, index, float(prior), slope, shift)


class Scorer:
    """Scores texts in a worker; texts without terms share one result."""

    def __init__(self, model: Model) -> None:
        self.model, self.terms = model, Terms(model.terms)

    def __call__(self, column: pa.Array) -> list[tuple[float, list[dict]]]:
        m, out = self.model, []
        for some in (texts[own] for texts in lists_of(column) for own in together(texts)):
            counts = self.terms.counts(some)
            for i, s in nearest(m.index, counts.text, counts.term, unit_vectors(counts, m.idf, len(some)), len(some)):
                if not len(i):
                    out.append((m.prior, []))
                    continue
                score = 1 / (1 + math.exp(-float(np.clip(m.slope * _logit(raw_score(m.index, i, s, m.prior)) + m.shift, -30, 30))))
                out.append((score, [{"doc_id": int(m.index.doc_ids[a]), "similarity": float(b), "label": int(m.index.labels[a])} for a, b in zip(i[:3], s[:3])]))
        return out


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col``, held_out, score, predicted, evidence for each row.

    ``evidence`` holds the three nearest examples. Null and empty texts, and
    texts without any term, score the rate among such examples. Without labels
    of both classes every text scores that one class (0 without any). Repeated
    rows are kept, other columns ignored.
    """
    ship_package(docs.sparkSession)
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list:
        score = worker_state(key, lambda: Scorer(shared.value))
        found = score(batch.column(2))
        return [batch.column(0), batch.column(1), [x[0] for x in found], [int(x[0] >= threshold) for x in found], [x[1] for x in found]]

    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, held_out boolean, score double, predicted int, evidence array<struct<doc_id:long,similarity:double,label:int>>"
    return map_rows(docs.select(id_col, is_held_out(F.col(id_col)).alias("held_out"), text_col), run, schema)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose text scores below ``threshold``."""
    ship_package(docs.sparkSession)
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = worker_state(key, lambda: Scorer(shared.value))
        return batch.filter(pa.array([x[0] < threshold for x in score(batch.column(at))], pa.bool_()))

    return map_rows(docs, run, docs.schema)
