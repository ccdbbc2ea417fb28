"""Cross-validates the toxicity operator's term weights and word beginnings on training rows alone.

``python -m tests.llm.toxicity_choice [DIR]`` prints the AUC of the raw votes over three folds
for each choice, and the CPU seconds of taking terms and of searching. Rows held out by the
operator's rule are never read.
"""

from __future__ import annotations

import sys
import time
import zlib

import duckdb
import numpy as np

from placekeep.llm import toxicity as T

FOLDS = 3


def auc(score: np.ndarray, y: np.ndarray) -> float:
    _, inverse, size = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(size) - (size - 1) / 2)[inverse]
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


def all_counts(texts: list[str]) -> T.Counts:
    terms = T.Terms(None)
    parts = [(own.start, terms.counts(texts[own])) for own in T.together(texts)]
    return T.Counts(np.concatenate([c.text + a for a, c in parts]), np.concatenate([c.term for _, c in parts]), np.concatenate([c.n for _, c in parts]))


def weights(counts: T.Counts, label: np.ndarray, seen: np.ndarray, docs: int, double_g: float) -> np.ndarray:
    """TF-IDF weights of terms, grown by the log-likelihood ratio against the labels."""
    ones, n = label.sum(), len(label)
    zeros = n - ones
    in1 = np.bincount(counts.term[label[counts.text] == 1], minlength=len(seen)).astype(float)
    in0 = np.bincount(counts.term[label[counts.text] == 0], minlength=len(seen)).astype(float)
    cells = [(in0, zeros, in0 + in1), (in1, ones, in0 + in1), (zeros - in0, zeros, n - in0 - in1), (ones - in1, ones, n - in0 - in1)]
    g = 2 * sum(a * np.log(np.maximum(a, 1) / np.maximum(of * al / n, 1e-300)) for a, of, al in cells)
    return (np.log((1 + docs) / (1 + seen)) + 0.1) * (1 + np.maximum(g, 0) / double_g)


def fold_scores(counts: T.Counts, y: np.ndarray, fold: np.ndarray, f: int, double_g: float, out: np.ndarray) -> None:
    train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
    rng = np.random.default_rng(f)
    examples = np.sort(np.concatenate([rng.permutation(train[y[train] == c])[: T.EXAMPLES] for c in (0, 1)]))
    place = np.full(len(y), -1)
    place[examples] = np.arange(len(examples))
    mine = place[counts.text] >= 0
    hashes, term = np.unique(counts.term[mine], return_inverse=True)
    known = T.Counts(place[counts.text[mine]], term, counts.n[mine].astype(float))
    at = np.minimum(np.searchsorted(hashes, counts.term), len(hashes) - 1)
    same = hashes[at] == counts.term
    idf = weights(known, y[examples], np.bincount(at[same], minlength=len(hashes)), len(y), double_g)
    n1, n0 = y[train].sum(), (1 - y[train]).sum()
    m1, m0 = y[examples].sum(), (1 - y[examples]).sum()
    index = T.build_index(examples.astype(np.int64), y[examples], known, idf, (n0 / m0, n1 / m1))
    row = np.full(len(y), -1)
    row[test] = np.arange(len(test))
    own = same & (row[counts.text] >= 0)
    text, term, n = row[counts.text[own]], at[own], counts.n[own].astype(float)
    order = np.lexsort((term, text))
    text, term, n = text[order], term[order], n[order]
    weight = T.unit_vectors(T.Counts(text, term, n), idf, len(test))
    for a in range(0, len(test), T.TOGETHER):
        b = min(a + T.TOGETHER, len(test))
        s = slice(*np.searchsorted(text, [a, b]))
        for i, (near, cosine) in enumerate(T.nearest(index, text[s] - a, term[s], weight[s], b - a)):
            out[test[a + i]] = T.raw_score(index, near, cosine, n1 / (n0 + n1))


def main(folder: str) -> None:
    rows = duckdb.sql(
        f"SELECT d.doc_id, d.text, max(l.toxic)::INT FROM '{folder}/documents.parquet' d JOIN '{folder}/labels.parquet' l USING (doc_id) WHERE d.text IS NOT NULL GROUP BY ALL ORDER BY 1"
    ).fetchall()
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    y, fold = np.array([r[2] for r in rows]), np.array([zlib.crc32(f"fold {r[0]}".encode()) % FOLDS for r in rows])
    for prefixes in ((4,), (4, 5, 6), ()):
        T.PREFIXES = prefixes
        began = time.process_time()
        counts = all_counts([r[1] for r in rows])
        taken = time.process_time() - began
        for double_g in (1.0, 3.84, 15.0, 1e18):
            began, out = time.process_time(), np.zeros(len(rows))
            for f in range(FOLDS):
                fold_scores(counts, y, fold, f, double_g, out)
            print(f"beginnings {prefixes}, double at {double_g:g}: AUC {auc(out, y):.4f}; {taken:.1f} s for terms, {time.process_time() - began:.1f} s for the search", flush=True)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
