"""Toxicity and language ID: exact search, decoding against brute force, held-out accuracy."""

import itertools
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from placekeep.llm import langid, toxicity

from .helpers import ODD, documents

BAD = ["idiotic", "rubbish", "wretched"]


def sample(n=400, seed=1):
    rng = random.Random(seed)
    texts, marks = [], []
    for i in range(n):
        words = ["".join(rng.choice(["ba", "lo", "mi", "ter", "sun"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for w in rng.sample(BAD, rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), w + rng.choice(["", "s", "ly"]))
        texts.append(" ".join(words))
        marks.append(int(toxic))
    return texts, marks


def labelled(spark, marks):
    return spark.createDataFrame([(i, 1, m, "clash") for i, m in enumerate(marks)], "doc_id long, quality int, toxic int, text string")


def test_toxicity_holds_out_and_scores(spark):
    texts, marks = sample()
    docs, labels = documents(spark, [*texts, *ODD]), labelled(spark, [*marks, *[None] * len(ODD)])
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(got) == len(texts) + len(ODD)
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in range(len(texts)))
    assert not {e["doc_id"] for r in got.values() for e in r.evidence} & set(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert sum(got[i].predicted == marks[i] for i in held) / len(held) > 0.95
    assert got[len(texts)].score == got[len(texts) + 1].score and got[len(texts)].predicted == 0
    # Labels of held-out documents don't matter.
    flipped = labelled(spark, [1 - m if i in set(held) else m for i, m in enumerate(marks)])
    assert toxicity.fit(docs, flipped).terms.tolist() == model.terms.tolist()
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def vectors(rng, n, terms, most):
    """Counts of random texts."""
    rows = [sorted((t, rng.randint(1, 5)) for t in rng.sample(range(terms), rng.randint(0, most))) for _ in range(n)]
    return toxicity.Counts(np.repeat(np.arange(n), [len(r) for r in rows]), np.array([t for r in rows for t, _ in r], np.int64), np.array([c for r in rows for _, c in r], float))


@pytest.mark.parametrize("frequent", [0, 8, 512])
@pytest.mark.parametrize("n", [3, 500])
def test_nearest_is_exact(monkeypatch, frequent, n):
    monkeypatch.setattr(toxicity, "FREQUENT", frequent)
    rng = random.Random(4)
    idf = np.array([rng.uniform(0.1, 5) for _ in range(200)])
    examples = vectors(rng, n, 200, 12)
    index = toxicity.build_index(np.arange(n) + 1000, np.array([rng.randint(0, 1) for _ in range(n)]), examples, idf, (1.0, 2.0))
    assert sorted(index.doc_ids.tolist()) == list(range(1000, 1000 + n))
    dense = np.zeros((n, 200))
    dense[examples.text, examples.term] = toxicity.unit_vectors(examples, idf, n)
    dense = dense[index.doc_ids - 1000]
    queries = vectors(rng, 300, 200, 20)
    w = toxicity.unit_vectors(queries, idf, 300)
    query = np.zeros((300, 200))
    query[queries.text, queries.term] = w
    leave = np.array([rng.randrange(n) for _ in range(300)])
    for out in (None, leave):
        cosine = (query @ dense.T).round(12)
        if out is not None:
            cosine[np.arange(300), out] = -1
        for own, (i, s) in zip(cosine, toxicity.nearest(index, queries.text, queries.term, w, 300, leave=out), strict=True):
            want = [int(x) for x in np.lexsort((np.arange(n), -own))[: toxicity.NEIGHBOURS] if own[x] > 0]
            assert i.tolist() == want and np.allclose(s, own[want])


def test_the_index_is_made_in_little_memory():
    """The index takes 45 bytes an entry here; making it may take half as much besides."""
    rng = np.random.default_rng(0)
    n, terms, each = 1000, 20000, 400
    counts = toxicity.Counts(np.repeat(np.arange(n), each), np.concatenate([np.sort(rng.choice(terms, each, replace=False)) for _ in range(n)]), np.ones(n * each))
    idf = rng.uniform(0.1, 5, terms)
    tracemalloc.start()
    try:
        toxicity.build_index(np.arange(n), np.arange(n) % 2, counts, idf, (1.0, 2.0))
        assert tracemalloc.get_traced_memory()[1] < 68 * n * each
    finally:
        tracemalloc.stop()


def test_terms_are_words_and_beginnings(monkeypatch):
    texts = [*sample(40)[0], *ODD, "_ab_ 1a2 É\ud800é ǅ 𝒳𝒴𝒵𝒳𝒴", " ".join(sample(60)[0])]
    want = []
    for text in texts:
        names: dict[int, int] = {}
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            for h in [toxicity.term_hash(word), *(toxicity.term_hash(word[:n], n) for n in toxicity.PREFIXES if len(word) >= n)]:
                names[h] = names.get(h, 0) + 1
        want.append(names)
    hashes = np.array(sorted({h for names in want for h in names}), np.uint64)
    for characters in (toxicity.CHARACTERS, 50):
        monkeypatch.setattr(toxicity, "CHARACTERS", characters)
        for terms in (toxicity.Terms(None), toxicity.Terms(hashes), toxicity.Terms(hashes[::3].copy())):
            known = hashes if terms.hashes is None else terms.hashes
            for own in toxicity.together(texts):
                c = terms.counts(texts[own])
                names = c.term if terms.hashes is None else terms.hashes[c.term]
                for i, names_of in enumerate(want[own]):
                    got = dict(zip(names[c.text == i].tolist(), c.n[c.text == i].tolist()))
                    assert got == {h: n for h, n in names_of.items() if h in set(known.tolist())}
    assert [i for own in toxicity.together(texts) for i in range(own.start, own.stop)] == list(range(len(texts)))


def test_toxicity_keeps_the_whole_vocabulary(spark):
    texts = ["calm words only", "calm rivers run", "wretched words here", "wretched noise again"] * 6
    marks = [0, 0, 1, 1] * 6
    model = toxicity.fit(documents(spark, texts), labelled(spark, marks))
    used = {w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 4 != 2 for w in t.split()}
    wanted = {toxicity.term_hash(w) for w in used} | {toxicity.term_hash(w[:n], n) for w in used for n in toxicity.PREFIXES if len(w) >= n}
    assert model.terms.tolist() == sorted(wanted)
    assert len(model.index.doc_ids) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(len(texts)))
    # A clean text is searched as well.
    score, evidence = toxicity.Scorer(model)(pa.array(["calm rivers"]))[0]
    assert evidence and all(e["label"] == 0 for e in evidence) and score < toxicity.THRESHOLD


@pytest.mark.parametrize("marks,score", [([], 0.0), ([0] * 20, 0.0), ([1] * 20, 1.0)])
def test_toxicity_without_both_classes(spark, marks, score):
    docs = documents(spark, sample(20)[0])
    got = toxicity.score_toxicity(docs, toxicity.fit(docs, labelled(spark, marks))).collect()
    assert len(got) == 20 and {r.score for r in got} == {score}


def test_toxicity_of_an_empty_table(spark):
    empty = documents(spark, [])
    assert toxicity.score_toxicity(empty, toxicity.fit(empty, labelled(spark, [0, 1] * 10))).collect() == []


LANGS = {"xx": ["kal", "dor", "min", "zek"], "yy": ["ouma", "lien", "eaux", "tion"], "ru": ["ско", "при", "ной", "ать"]}


def mixed(n=240, seed=2):
    rng = random.Random(seed)
    texts, langs = [], []
    for i in range(n):
        lang = ["xx", "yy", "ru"][i % 3]
        texts.append(" ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 40))))
        langs.append(lang)
    return texts, langs


def test_language_id(spark):
    texts, langs = mixed()
    extra = [*ODD, "12 34 !!", "中文字", texts[0] + " " + texts[1] + " " + texts[2]]
    docs = documents(spark, [*texts, *extra], langs=[*langs, *[None] * len(extra)])
    model = langid.fit(docs)
    assert model.langs == ["ru", "xx", "yy"]
    rows = langid.identify(docs, model).collect()
    got = {r.doc_id: r for r in rows}
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in range(len(texts)))
    assert all(got[i].lang_pred == langs[i] and got[i].score > 0.9 for i in held)
    n = len(texts)
    assert [got[n + i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and got[n + len(ODD)].lang_pred == "und"
    assert got[n + len(ODD) + 1].lang_pred in model.langs and got[n + len(ODD) + 1].score == 0
    assert [s.lang for s in got[n + len(extra) - 1].spans] == ["xx", "yy", "ru"]
    assert all(0 <= r.score <= 1 for r in rows)
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.lang_pred != "und" and r.score >= 0.5}
    assert langid.identify(documents(spark, []), langid.fit(documents(spark, []))).collect() == []


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b"], rng.normal(-6, 2, (langid.BUCKETS, 2)).astype(np.float32), np.ones((len(langid.NAMES), 2), bool))
    decoder = langid.Decoder(model)
    texts = [[str(w) for w in rng.choice(["ab", "cd", "efg", "h", "ijkl", "mno"], n)] for n in (0, 1, 5, 7, 3, 8)]
    got = decoder.decode(texts)
    for words, states in zip(texts, got):
        if not words:
            assert not len(states)
            continue
        score = lambda path: sum(float(decoder.scores[decoder.rows[w], s]) for w, s in zip(words, path)) - langid.SWITCH * sum(a != b for a, b in zip(path, path[1:]))
        best = max(score(path) for path in itertools.product(range(2), repeat=len(words)))
        assert math.isclose(score(states), best, rel_tol=1e-6)


def test_memory_of_words_changes_nothing(monkeypatch):
    texts, _ = mixed(30)
    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b"], rng.normal(-6, 2, (langid.BUCKETS, 2)).astype(np.float32), np.ones((len(langid.NAMES), 2), bool))
    whole = langid.Decoder(model).label(texts)
    monkeypatch.setattr(langid, "KNOWN", 5)
    monkeypatch.setattr(langid, "GROUP", 50)
    assert langid.Decoder(model).label(texts) == whole
