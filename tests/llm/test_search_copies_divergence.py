"""Ranked search, MinHash near-duplicates and source divergence, each against a plain version."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from placekeep.llm import divergence, minhash, ranked_search

from .helpers import ODD, documents, rows_of


def words(rng, n, size=60):
    return [f"w{min(int(rng.expovariate(0.08)), size)}" for _ in range(n)]


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# --- ranked search


def search_plain(docs, items, top=20):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    bags = [(i, Counter(split(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 75 + 25 * sum(b.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in split(text) if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scored)[:top])]
    return out


@pytest.mark.parametrize("window, postings", [(2048, 1 << 20), (16, 200)])
def test_search_equals_plain(spark, monkeypatch, window, postings):
    monkeypatch.setattr(ranked_search, "WINDOW", window)
    monkeypatch.setattr(ranked_search, "SEGMENT_POSTINGS", postings)
    rng = random.Random(3)
    texts = [" ".join(words(rng, rng.randint(1, 80))) for _ in range(400)] + ODD + ["W1, w2; W3! w1" for _ in range(30)] + ["été w1 ÉTÉ"]
    ids = [rng.choice([k, k * 7 % 100, None]) if k % 50 == 0 else 1000 - k for k in range(len(texts))]
    docs = documents(spark, texts, ids=ids).repartition(7)
    items = [(1, "w1 w2 w3 w3 w50"), (2, None), (3, ""), (4, "nothing here?"), (5, " ".join(words(rng, 60))), (6, "ÉTÉ w40 w41"), (None, "w9")]
    found = ranked_search.rank_documents(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    want = search_plain(list(zip(ids, texts)), items)
    assert rows_of(found) == sorted(tuple(map(str, r)) for r in want)


def test_search_skips_documents():
    """Documents of frequent words alone aren't scored once the heap is full of better ones."""
    segment, vocabulary = ranked_search._Segment(), {b"rare": 0, b"the": 1}
    for k in range(8000):
        segment.add(k, "the rare" if k < 100 else "the end", vocabulary.get)
    row = segment.row()
    shard = ranked_search.Shard(row, np.array([ranked_search.weight(8000, 100), ranked_search.weight(8000, 8000)]), 8000, 16000)
    heap = ranked_search.Heap(20)
    assert shard.search([(0, 1), (1, 1)], heap) <= ranked_search.WINDOW
    assert heap.ids.tolist() == list(range(20))


def test_search_blocks_and_empty(spark, monkeypatch):
    docs = documents(spark, ["a b c", "b c d", "c d e"])
    items = spark.createDataFrame([(k, t) for k, t in enumerate(["a c", "d e", "b"])], "item_id long, text string")
    whole = rows_of(ranked_search.rank_documents(docs, items))
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 2)
    assert rows_of(ranked_search.rank_documents(docs, items)) == whole and len(whole) > 3
    assert not ranked_search.rank_documents(docs.where("false"), items).collect()
    assert not ranked_search.rank_documents(docs, items.where("false")).collect()


def test_search_very_long_text(spark, monkeypatch):
    from placekeep.llm import common

    monkeypatch.setattr(common, "PART", 64)
    long = "abc def " * 30_000 + "ghi"
    assert Counter(ranked_search.terms_of(long)) == {b"abc": 30_000, b"def": 30_000, b"ghi": 1}
    assert ranked_search.impacts(np.array([10**9]), np.array([10**9]), 10**11, 10**12).tolist() == [10**18 // (10**12 + 12 * (75 + 25 * 10**20 // 10**12))]


# --- MinHash


def sets_plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def copies_plain(docs, percent=85):
    sets = [(i, sets_plain(t)) for i, t in docs]
    up = {i: i for i, _ in docs if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    out = []
    for i, s in sets:
        of_set = min((root(j) for j, t in sets if t == s and j is not None), default=None) if s else None
        c = root(i) if i is not None else of_set
        out.append((i, len(s), c, i == c))
    return out


def varied(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**9)}"
    return out


@pytest.mark.parametrize("small, block", [(32, 512), (2, 5)])
def test_copies_equal_plain(spark, monkeypatch, small, block):
    """A large group of near copies around the limit, in rows and in tiles of several blocks."""
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(5)
    base = [f"b{k}" for k in range(150)]
    texts = [" ".join(varied(rng, base, rng.choice([0, 1, 1, 2, 2, 3, 5]))) for _ in range(120)]
    for _ in range(25):
        one = [f"y{rng.randrange(10**6)}" for _ in range(rng.randint(1, 90))]
        texts += [" ".join(one), " ".join(varied(rng, one, rng.randint(0, 2))), " ".join(one).upper() + " \n"]
    texts += ODD + ["a b c", "A  b\tc", "a b"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = documents(spark, texts, ids=ids)
    found = minhash.near_duplicate_sets(docs)
    assert found.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert rows_of(found) == sorted(tuple(map(str, r)) for r in copies_plain(list(zip(ids, texts))))


def test_copies_odd_ids(spark):
    """Null ids, ids of several texts, and an id with an empty text."""
    base = [f"b{k}" for k in range(60)]
    other = [f"c{k}" for k in range(60)]
    texts = [" ".join(base), " ".join(base), " ".join(other), " ".join(other), "", " ".join(base[1:])]
    ids = [5, None, 5, 3, 5, None]
    got = sorted(map(tuple, minhash.near_duplicate_sets(documents(spark, texts, ids=ids)).collect()), key=str)
    assert got == sorted([(5, 56, 3, False), (None, 56, 3, False), (5, 56, 3, False), (3, 56, 3, True), (5, 0, 3, False), (None, 55, None, True)], key=str)
    assert not minhash.near_duplicate_sets(documents(spark, [])).collect()


def test_copies_very_long_text(spark):
    rng = random.Random(7)
    long = [f"l{rng.randrange(5000)}" for _ in range(140_000)]
    got = {r.doc_id: r for r in minhash.near_duplicate_sets(documents(spark, [" ".join(long), " ".join(long[:-500]), " ".join(long[:100_000])])).collect()}
    assert [got[k].component_id for k in range(3)] == [0, 0, 2] and got[0].n_shingles == len(sets_plain(" ".join(long)))


def test_pruning_keeps_similar_pairs():
    """Of pairs at the limit, fewer than the stated part is lost; far ones go."""
    rng = np.random.default_rng(1)
    fewest = minhash.fewest_equal(85)
    t = 0.85 + 0.15 / 256
    at = lambda s: (rng.random((200_000, minhash.VALUES)) < s).astype(np.uint8)
    same = np.ones((200_000, minhash.VALUES), np.uint8)
    assert 200_000 - len(minhash.plausible(at(t), same, fewest)) <= 4
    assert len(minhash.plausible(at(0.5), same, fewest)) < 200
    assert (1 - 0.85**minhash.ROWS) ** minhash.BANDS < 1e-10


def test_minima_estimate_similarity():
    rng = random.Random(2)
    a = [f"a{k}" for k in range(2000)]
    b = a[:1800] + [f"b{k}" for k in range(200)]
    rng.shuffle(a)
    x, y = (np.unique(np.array([xxhash.xxh3_64_intdigest(w) for w in s], np.uint64)) for s in (a, b))
    equal = (minhash.minima(x) == minhash.minima(y)).mean()
    assert abs(equal - 1800 / 2200) < 0.08


# --- divergence


def audit_plain(docs):
    out = []
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for t, lang, source in docs]
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= 10)
        counts = defaultdict(Counter)
        for _, source, terms in mine:
            counts[source].update(t for t in terms if df[t] >= 10)

        def shares(c):
            return {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in counts:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:10]
            for part, rows in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(rows)]
    return out


@pytest.mark.parametrize("entries, run, size", [(600_000, 512, 200_000), (50, 3, 20)])
def test_audit_equals_plain(spark, monkeypatch, entries, run, size):
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    monkeypatch.setattr(divergence, "RUN", run)
    monkeypatch.setattr(divergence, "RANGE", size)
    rng = random.Random(9)
    alphabet = "abcé中Z"
    word = lambda: "".join(rng.choice(alphabet) for _ in range(min(1 + int(rng.expovariate(0.9)), 6)))
    texts = ["; ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(300)] + ODD
    langs = [rng.choice(["en", "de", None, "", "Ünï"]) for _ in texts]
    sources = [rng.choice(["s1", "s2", "S2", None, "s10", "é"]) for _ in texts]
    docs = documents(spark, texts + ["1 2 3"], langs=[*langs, "one"], sources=[*sources, "alone"]).repartition(5)
    found = divergence.audit_sources(docs)
    assert found.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert rows_of(found) == sorted(tuple(map(str, r)) for r in audit_plain([*zip(texts, langs, sources), ("1 2 3", "one", "alone")]))
    assert not divergence.audit_sources(docs.where("false")).collect()


def test_audit_of_few_documents(spark):
    """Without a kept term, pairs stand at 0; a source alone has no rows."""
    got = divergence.audit_sources(documents(spark, ["a b", "c", None], langs=["x", "x", "y"], sources=["p", "q", "p"]))
    assert rows_of(got) == [("x", "p", "pair", "q", "0", "1"), ("x", "q", "pair", "p", "0", "1")]


def test_tries():
    rng = random.Random(4)
    counted = Counter()
    trie = divergence.Trie()
    for _ in range(3000):
        term = bytes(rng.choice(b"ab\xc3\xa9") for _ in range(rng.randint(0, 7)))
        counted[term] += 1
        trie.add(term, 1, [("s", 2)])
    assert [(t, d, c["s"]) for t, (d, c) in trie.walk()] == [(t, n, 2 * n) for t, n in sorted(counted.items())]
    terms = sorted(counted)
    n = np.array([counted[t] for t in terms])
    for row in divergence.pack_runs("x", terms, n, ["q", "s"], np.ones(len(n), int), 2 * n, np.ones(len(n), int), most=len(n)):
        assert [(t, d, c) for t, d, c in divergence.unpack_run(row)] == [(t, counted[t], [("s", 2 * counted[t])]) for t in terms]
        again = [x for _, part in divergence.cut_run(row, lambda t: len(t) and t[0]) for x in divergence.unpack_run(part)]
        assert again == list(divergence.unpack_run(row))


def test_large_counts_are_exact():
    big = np.array([10**10, 0])
    assert divergence._floor_share(big, 10**10 + 4).tolist() == [1 + 10**9 * (10**10 + 2) // (10**10 + 4), 1 + 10**9 * 2 // (10**10 + 4)]
