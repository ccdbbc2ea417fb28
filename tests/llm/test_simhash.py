"""SimHash, vantage-point trees and components against brute force."""

import random

import numpy as np
import pytest
import regex
import xxhash

from placekeep.llm import minhash, near_copies
from placekeep.llm import simhash as S

from .helpers import ODD, documents


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = regex.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def plain_components(fps, limit=4):
    """{id: smallest id reachable} for {id: fingerprint}."""
    ids = sorted(fps)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= limit:
                ra, rb = sorted((root(a), root(b)))
                up[rb] = ra
    return {i: root(i) for i in ids}


def clustered(rng, n, groups, size):
    """Random fingerprints, with groups spread around centres."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(groups):
        at = rng.getrandbits(64)
        for _ in range(size):
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                at ^= 1 << bit
            out.append(at)
    return sorted(set(out))


def test_fingerprints():
    for t in [*ODD, "A b C d E", "a\x0bb\x0cc d", "one two three", "Ä ä A a b c d e", " ".join(f"w{i % 7}" for i in range(500))]:
        assert S.simhash(t) == plain_fingerprint(t), t


@pytest.mark.parametrize("seed", range(4))
def test_links_are_exact(seed, monkeypatch):
    monkeypatch.setattr(S, "DIRECT", 16)
    rng = random.Random(seed)
    x = np.array(clustered(rng, 300, 10, 40), dtype=np.uint64)
    ids = {i: int(v) for i, v in enumerate(x)}
    want = plain_components(ids)
    up = list(range(len(x)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for mask in S._masks(4):
        top = S.build_top(x, len(x), mask, 1, 60)
        i, leaf, home = S.route(top, x, mask, 1)
        assert sorted(i[home].tolist()) == list(range(len(x)))
        for n in np.unique(leaf):
            own = leaf == n
            for a, b in S.links_within(x[i[own]], home[own], mask, 1, 4):
                a, b = int(i[own][a]), int(i[own][b])
                assert (ids[a] ^ ids[b]).bit_count() <= 4
                ra, rb = sorted((root(a), root(b)))
                up[rb] = ra
    least = {}
    for i in ids:
        least[root(i)] = min(least.get(root(i), i), i)
    assert {i: least[root(i)] for i in ids} == want


def test_one_tree_over_all_bits_is_exact_too():
    rng = random.Random(9)
    x = np.array(clustered(rng, 200, 5, 30), dtype=np.uint64)
    mask = S._masks(1)[0]
    pairs = S.links_within(x, np.ones(len(x), bool), mask, 4, 4)
    up = plain_components({i: int(v) for i, v in enumerate(x)})
    assert len(pairs) == len(x) - len(set(up.values()))


@pytest.mark.parametrize("hub", [1, 64])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(S, "HUB", hub)
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [(7, 7)] + [(300 + i, 299) for i in range(70)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in S.components(df).collect()}
    up = {n: n for e in edges for n in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        ra, rb = sorted((root(a), root(b)))
        up[rb] = ra
    want = {n: root(n) for e in edges for n in e if e[0] != e[1]}
    assert got == want
    assert S.components(df.where("a < 0")).collect() == []


def near_texts():
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(300)) for _ in range(12)]
    texts = []
    for b in base:
        w = b.split()
        texts += [b, b, b.upper(), " ".join([*w[:150], "changed", *w[151:]])]
    return [*texts, *ODD]


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD", 10)
    texts = near_texts()
    got = {r.doc_id: r for r in S.near_duplicates(documents(spark, texts)).collect()}
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    want = plain_components(fps)
    assert len(got) == len(texts)
    assert all(got[i].fingerprint == f"{fps[i]:016x}" and got[i].component_id == want[i] for i in fps)


def test_odd_ids_and_empty_tables(spark):
    assert S.near_duplicates(documents(spark, [])).collect() == []
    # Rows of id 5 tie two texts together; a null id takes the component of its text.
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    rows = S.near_duplicates(documents(spark, [a, b, a, b, a], ids=[5, 5, 7, 3, None])).collect()
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=str) == sorted([(5, 3), (5, 3), (7, 3), (3, 3), (None, 3)], key=str)


def plain_sketch(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = regex.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return 0
    shingles = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)}
    h = [xxhash.xxh3_128_intdigest(s.encode(), 0) << 128 | xxhash.xxh3_128_intdigest(s.encode(), 1) for s in shingles]
    return sum(1 << b for b in range(256) if 2 * sum(v >> b & 1 for v in h) > len(h))


def edited_texts(seed, texts=40, words=240):
    """Texts, and copies of each with more and more words replaced."""
    rng = random.Random(seed)
    out = []
    for _ in range(texts):
        w = [f"w{rng.randrange(900)}" for _ in range(words)]
        for edits in (0, 0, 2, 4, 9):
            v = list(w)
            for at in rng.sample(range(words), edits):
                v[at] = f"x{rng.randrange(900)}"
            out.append(" ".join(v))
    return out


def test_sketches():
    for t in [*ODD, "A b C d E f", "a b c d e a b c d e a b c d e", "one two three", *near_texts()[:8]]:
        assert int.from_bytes(S.sketch(t), "big") == plain_sketch(t), t
    for n in (65539, 65540, 65541, 131080):
        long = " ".join(f"w{i * i % 8191}" for i in range(n))
        assert int.from_bytes(S.sketch(long), "big") == plain_sketch(long) and S.simhash(long) == plain_fingerprint(long)
    assert [S.limit_for(j) for j in (1.0, 0.9, 0.8)] == [0, 38, 53]


def jaccard_components(texts, least=80):
    """Components of exact similarity over distinct 5-word shingles, and its pairs."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in texts)]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] == sets[b] or 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    up = list(range(len(sets)))
    for a, b in pairs:
        x, y = up[a], up[b]
        up = [min(x, y) if u in (x, y) else u for u in up]
    return dict(enumerate(up)), pairs


@pytest.mark.parametrize("block", [512, 6])
def test_similar_documents(spark, monkeypatch, block):
    """Candidates of small shards, confirmed exactly; groups that fall apart are searched in tiles."""
    monkeypatch.setattr(S, "SHARD", 25)
    monkeypatch.setattr(S, "DIRECT", 8)
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = [*edited_texts(3), *ODD]
    rng = random.Random(6)
    base = [f"b{k}" for k in range(150)]
    for _ in range(60):
        some = list(base)
        for k in rng.sample(range(150), rng.choice([0, 1, 2, 2, 3, 4])):
            some[k] = f"z{rng.randrange(10**8)}"
        texts.append(" ".join(some))
    got = {r.doc_id: r for r in near_copies.similar_documents(documents(spark, texts)).collect()}
    assert all(got[i].fingerprint == f"{plain_sketch(t):064x}" for i, t in enumerate(texts))
    want, pairs = jaccard_components(texts)
    found = {i: got[i].component_id for i in range(len(texts))}
    # No false link: each found component lies within a true one.
    assert all(want[found[i]] == want[i] for i in found)
    assert len(pairs) > 300 and sum(found[a] == found[b] for a, b in pairs) >= 0.97 * len(pairs)
    close = jaccard_components(texts, 85)[1]
    assert sum(found[a] == found[b] for a, b in close) >= 0.995 * len(close)


def test_sketch_links_of_a_dense_group(monkeypatch):
    """Thousands of versions of one text share words of the sketch, so no vantage point divides them."""
    monkeypatch.setattr(S, "DIRECT", 16)
    rng = random.Random(8)
    centre = rng.getrandbits(256)
    values = [centre ^ sum(1 << b for b in rng.sample(range(192), rng.randint(0, 60))) for _ in range(300)] + [rng.getrandbits(256) for _ in range(100)]
    fp = S._words([v.to_bytes(32, "big") for v in values], True)
    word = np.zeros(len(values), np.uint64)
    links = S.links_within(word, np.ones(len(values), bool), S._masks(4)[0], 1, 38, fp)
    want = plain_components(dict(enumerate(values)), 38)
    assert all((values[a] ^ values[b]).bit_count() <= 38 and want[a] == want[b] for a, b in links)
    assert len(links) == len(values) - len(set(want.values()))


def test_confirmed_links_are_stars(spark, monkeypatch):
    """A chain of links comes as a star, which the last components take in one round."""
    base = [f"w{k}" for k in range(150)]
    docs = documents(spark, [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in (10, 40, 70, 100)])
    nodes = near_copies.sketches(docs).withColumnRenamed("doc_id", "low")
    monkeypatch.setattr(near_copies, "link_edges", lambda nodes, limit: spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "a long, b long"))
    links = near_copies.confirmed_links(docs, nodes, "doc_id", "text", 0.8)
    assert sorted((r.a, r.b) for r in links.collect()) == [(1, 0), (2, 0), (3, 0)]


def test_one_of_each_stays(spark):
    texts = near_texts()
    docs = documents(spark, [*texts, texts[0]], ids=[*range(len(texts)), 0])
    kept = near_copies.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    want = jaccard_components(texts)[0]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    nulls = documents(spark, ["a b c d e f", "a b c d e f"], ids=[None, None])
    assert near_copies.keep_one_of_each(nulls).count() == 2
