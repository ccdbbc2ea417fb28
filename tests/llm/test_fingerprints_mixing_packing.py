"""Order MinHash, mixing and packing against plain versions."""

import hashlib
import math
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from placekeep.llm import mixing, order_minhash, packing
from placekeep.llm.common import worker_state

from .helpers import ODD, documents

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def edited(texts):
    """Each text with its last half replaced by the beginning of the next."""
    texts = [t or "" for t in texts]
    return [t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2] for i, t in enumerate(texts)]


def plain_tokens(text):
    alone = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
    return re.findall(f"[{alone}]|[^ \t\n\x0b\f\r{alone}]{{1,4}}", text)


def plain_signature(spark, text):
    """The signature by loops; only the hash function is Spark's."""
    rows = lambda values, number="long": [r[0] for r in spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, " + ", ".join(f"c{j} {'string' if isinstance(values[0][j], str) else number if j else 'long'}" for j in range(len(values[0])))).orderBy("i").select(F.xxhash64(*[f"c{j}" for j in range(len(values[0]))])).collect()]
    cut = lambda x: (x & (2**64 - 1)) >> 25
    words = ["", "", *plain_tokens(text), None, None]
    runs = [tuple(words[i : i + order_minhash.K]) for i in range(len(words) - 2)]
    seen, grams, later = {}, [], []
    for i, h in enumerate(rows(runs)):
        n = seen[cut(h)] = seen.get(cut(h), -1) + 1
        (later if n else grams).append((cut(h), n, i) if n else (cut(h), i))
    if later:
        grams += [(cut(h), i) for h, (_, _, i) in zip(rows([x[:2] for x in later], "int"), later)]
    grams.sort()
    bins, width = 1 << order_minhash.BIN_BITS, 39 - order_minhash.BIN_BITS
    pairs = []
    for b in range(bins):
        at = next((j for j, g in enumerate(grams) if g[0] >= b << width), 0)
        pair = [grams[at], grams[(at + 1) % len(grams)]]
        pairs.append(tuple(g[0] for g in sorted(pair, key=lambda g: g[1])))
    return "".join(f"{b << 26 | h & (1 << 26) - 1:08x}" for b, h in enumerate(rows(pairs)))


def test_order_minhash(spark):
    rng = random.Random(1)
    texts = [*ODD, *[" ".join(rng.choice(["ab", "cd", "ef", "gh", "é中"]) for _ in range(rng.randint(0, 90))) for _ in range(300)]]
    ids = [i * 37 for i in range(len(texts))]
    rows = order_minhash.fingerprint_documents(documents(spark, texts, ids=ids)).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts)
    for i, e in zip(ids, edited(texts)):
        r = got[i]
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and r.n_chars == len(texts[i // 37] or "")
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_text = {}
    for i, t in zip(ids, texts):
        assert by_text.setdefault(t or "", got[i].fingerprint) == got[i].fingerprint
    for i in (0, 3, 4, 8, 9, 20, 40):
        assert got[ids[i]].fingerprint == plain_signature(spark, texts[i] or "")
        assert got[ids[i]].edited_fingerprint == plain_signature(spark, edited(texts)[i])
    a, b = ({f[i : i + 8] for i in range(0, len(f), 8)} for f in (got[ids[20]].fingerprint, got[ids[21]].fingerprint))
    assert math.isclose(got[ids[20]].near_next, len(a & b) / 64)


def test_likeness_falls_with_edits_and_order(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    pairs = []
    for n in (15, 40, 100, 300):
        for _ in range(15):
            w = [rng.choice(words) for _ in range(n)]
            q = n // 4
            pairs.append((n, " ".join(w), " ".join([*w[: n // 2], "changed", *w[n // 2 + 1 :]]), " ".join([*w[3 * q :], *w[2 * q : 3 * q], *w[q : 2 * q], *w[:q]])))
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(400))
    pairs.append((1, cjk, "好" + cjk, cjk[200:] + cjk[:200]))
    pairs.append((2, "x" * 50 + "abcdefghijkl" * 30, "x" * 50 + "abcdefghijkl" * 20, "abcdefghijkl" * 30))
    df = spark.createDataFrame(pairs, "n int, a string, b string, c string")
    for x in "abc":
        df = order_minhash.with_signature(df, x, f"s{x}")
    rows = df.select("n", order_minhash.likeness("sa", "sb").alias("edit"), order_minhash.likeness("sa", "sc").alias("moved")).collect()
    for n in (15, 40, 100, 300):
        edit, moved = ([r[c] for r in rows if r.n == n] for c in ("edit", "moved"))
        # Moved quarters change the order of three quarters of the pairs, whatever the text's length.
        assert sum(edit) / 15 > 0.5 and sum(moved) / 15 < 0.3, (n, edit, moved)
    assert next(r.edit for r in rows if r.n == 1) > 0.9 and next(r.edit for r in rows if r.n == 2) > 0.3
    short = order_minhash.fingerprint_documents(documents(spark, ["x" * 10, "one two three four five six", "x" * 400, cjk])).collect()
    assert all(0 < r.near_edited < 1 for r in short if r.doc_id in (2, 3)), short


def test_order_minhash_takes_whole_numbers(spark):
    with pytest.raises(TypeError):
        order_minhash.fingerprint_documents(documents(spark, ["a"]).withColumn("doc_id", F.col("doc_id").cast("string")))


@pytest.mark.parametrize("ids", [[5], [-9, 2**62, -(2**62), 0, 255, 256], [3, 3, 3, 1]])
def test_next_document(spark, ids):
    texts = [f"text {i} " * (i + 2) for i in range(len(ids))]
    rows = order_minhash.fingerprint_documents(documents(spark, texts, ids=ids)).collect()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    want = sorted((ids[i], hashlib.sha256(e.encode()).hexdigest()) for i, e in zip(order, edited([texts[i] for i in order])))
    assert sorted((r.doc_id, r.edited_sha256) for r in rows) == want


def test_next_document_over_levels(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "ORDERED", 3)
    rng = random.Random(3)
    keys = sorted({rng.randrange(-(10**9), 10**9) for _ in range(80)} | set(range(50)))
    got = {r["key"]: r["next"] for r in order_minhash.next_keys(spark.createDataFrame([(k,) for k in keys], "key long")).collect()}
    assert got == dict(zip(keys, [*keys[1:], None]))


def test_order_minhash_of_null_ids_and_nothing(spark):
    r = order_minhash.fingerprint_documents(documents(spark, ["one two three four", None], ids=[None, None])).collect()
    assert len(r) == 2 and all(x.near_next == 1.0 for x in r)
    assert order_minhash.fingerprint_documents(documents(spark, [])).collect() == []


def test_order_minhash_stays_native(spark):
    plan = order_minhash.fingerprint_documents(documents(spark, ODD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def mixture(spark, n=600):
    rng = random.Random(8)
    texts = ["w " * rng.randint(0, 40) for _ in range(n)]
    sources = [rng.choice(["big"] * 8 + ["mid"] * 3 + ["small", None]) for _ in range(n)]
    return documents(spark, texts, sources=sources), texts, sources


def tokens(texts, sources):
    out = {}
    for t, s in zip(texts, sources):
        out[s] = out.get(s, 0) + len(t.split())
    return out


@pytest.mark.parametrize("target", [mixing.Target(), mixing.Target(repeats=1.3), mixing.Target(entropy=1.2, repeats=None)])
def test_mixing_meets_its_target(spark, target, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 64)
    docs, texts, sources = mixture(spark)
    have = tokens(texts, sources)
    plan, a = mixing.plan(docs, target)
    # The exponent by plain bisection.
    low, high = 0.0, 1.0
    for _ in range(60):
        m = (low + high) / 2
        w = {s: t**m / sum(x**m for x in have.values()) for s, t in have.items()}
        if target.entropy is None:
            low, high = (low, m) if (max(have.values()) / min(have.values())) ** (1 - m) <= target.repeats else (m, high)
        else:
            low, high = (m, high) if -sum(x * math.log(x) for x in w.values()) >= target.entropy else (low, m)
    assert math.isclose(a, m, abs_tol=1e-6)
    rows = mixing.mix(docs, target).collect()
    got = {}
    for r in rows:
        got[r.source] = got.get(r.source, 0) + r.n_tokens
    budget = math.ceil(max(t / w[s] for s, t in have.items()))
    for s in have:
        assert w[s] * budget - 41 <= got[s] <= w[s] * budget + 1, (s, got[s], w[s] * budget)
    assert {r.doc_id for r in rows} == set(range(len(texts)))
    full = {}
    for r in rows:
        full.setdefault((r.source, r["pass"]), []).append((r.turn, r.block, r.place, r.doc_id))
    last = {s: max(n for x, n in full if x == s) for s in have}
    cut = 0
    for (s, n), own in full.items():
        inside = {x[3] for x in own}
        assert len(inside) == len(own)
        if n < last[s]:
            assert inside == {x[3] for x in full[(s, 0)]}
        elif n and len(inside) < len(full[(s, 0)]):
            # The last pass ends early, in an order of its own.
            cut += 1
            assert all(texts[i] is not None and sources[i] == s for i in inside)
        blocks = {b: t for t, b, _, _ in own}
        if len(blocks) > 2 and n:
            first = {b: t for t, b, _, _ in full[(s, 0)]}
            assert sorted(blocks, key=blocks.get) != [b for b in sorted(first, key=first.get) if b in blocks]


def test_mixing_of_hostile_columns(spark):
    docs, texts, sources = mixture(spark, 200)
    names = ["_block", "_weight", "_place", "_pass", "_copies", "_s_weight", "_s_key", "row", "weight", "pass", "block", "place", "turn", "source_key", "cut.block", "tokens"]
    wide = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    got = mixing.mixed_documents(wide)
    assert got.columns == wide.columns
    rows = got.collect()
    assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in mixing.mix(docs).collect())


def test_mixing_of_many_equal_rows(spark):
    texts, sources = ["a b c"] * 300 + ["x y"] * 20, ["same"] * 300 + [f"s{i % 2}" for i in range(20)]
    rows = mixing.mix(documents(spark, texts, ids=[1] * 300 + list(range(2, 22)), sources=sources)).collect()
    assert sum(r.doc_id == 1 for r in rows) == 300 and {r.doc_id for r in rows} == {1, *range(2, 22)}


def test_mixing_odd_cases(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
    rows = mixing.mix(documents(spark, [None, "", "a b", "a b"], sources=["x", "x", None, None], ids=[1, 2, 3, 3])).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 3, 3]
    few = mixing.mix(mixture(spark)[0], budget=500).collect()
    assert 380 < sum(r.n_tokens for r in few) <= 500
    docs = mixture(spark)[0]
    assert mixing.mixed_documents(docs).columns == docs.columns


@given(st.dictionaries(st.integers(1, 64), st.integers(0, 50), max_size=20))
@settings(max_examples=200, deadline=None)
def test_packs_hold_the_histogram(histogram):
    packs = packing.shortest_pack_first(histogram, 64)
    held = {}
    for pack, count in packs:
        assert sum(pack) <= 64 and count > 0
        for n in pack:
            held[n] = held.get(n, 0) + count
    assert held == {n: c for n, c in histogram.items() if c}


def check_packing(rows, texts):
    encode = worker_state("test", lambda: packing.Encoder(*FILES))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, own in by_doc.items():
        ids = np.append(encode.slow(texts[i]) if texts[i] else np.zeros(0, np.uint32), np.uint32(0)).astype("<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    return by_seq


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 20)
    rng = random.Random(6)
    texts = [*ODD, "a <|endoftext|> b", *["".join(rng.choice("abc de, \n") for _ in range(rng.choice([3, 50, 2000, 9000]))) for _ in range(80)]]
    rows = packing.pack_documents(documents(spark, texts), *FILES).collect()
    seqs = check_packing(rows, texts)
    used = [sum(r.length for r in own) for own in seqs.values()]
    assert sum(1024 - u for u in used) / (1024 * len(used)) < 0.05 and sorted(seqs) == list(range(len(seqs)))
    assert packing.pack_documents(documents(spark, []), *FILES).collect() == []
    twice = packing.pack_documents(documents(spark, ["same text", "same text", None], ids=[1, 1, None]), *FILES).collect()
    assert sorted(r.doc_id for r in twice if r.doc_id) == [1, 1] and len(twice) == 3


MARKED = st.lists(st.text(max_size=20) | st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " "]), max_size=6).map("".join)


@given(st.text(max_size=60) | st.text(alphabet=st.characters(max_codepoint=0x52F), max_size=200) | MARKED)
@settings(max_examples=300, deadline=None)
def test_ids_are_those_of_the_stated_call(text):
    encode = worker_state("test", lambda: packing.Encoder(*FILES))
    plain = tokenizer()
    assert encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids


@lru_cache
def tokenizer():
    return Tokenizer.from_file(FILES[0])


def test_special_marks_have_their_ids():
    assert packing.Encoder(*FILES)("a <|endoftext|> b").tolist() == [64, 220, 50256, 275] == packing.Encoder(FILES[0], None)("a <|endoftext|> b").tolist()
    long = " " * 20_000 + "x" * 3_000 + "1" * 20_000
    assert packing.Encoder(*FILES)(long).tolist() == tokenizer().encode(long, add_special_tokens=False).ids
