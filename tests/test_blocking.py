"""Candidate pairs against comparing all pairs; the matchers that use them, too."""

import random
from difflib import SequenceMatcher

import pytest

from placekeep.operators import blocking


def names(rng, n):
    words = ["star", "stars", "trek", "tron", "electron", "galaga", "kalaga", "pong", "superpong", "x men", "xmen", "aa", "aaaa", "a", "b", "the act", "pin", "pinbot", "bot", "é中", "deluxe"]
    out = set()
    while len(out) < n:
        w = " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w) + 1)
            w = w[:at] + rng.choice(["", "q", "a"]) + w[at + rng.randint(0, 1) :]
        out.add(w.strip())
    return sorted(out - {""})


@pytest.mark.parametrize("least", [0.6, 0.75, 0.829, 0.938])
def test_no_pair_is_lost(spark, least):
    rng = random.Random(int(least * 1000))
    a, b = names(rng, 160), names(rng, 160)
    frame = lambda x: spark.createDataFrame([(t, p) for t in x for p in ("p", "q")] + [(None, "p"), ("", "p"), ("x", None)], "form string, part string")
    got = [(r.part, r.a, r.b) for r in blocking.alike_candidates(frame(a), frame(b), least).collect()]
    assert len(got) == len(set(got))
    for x in a:
        for y in b:
            if x == y or x in y or y in x or SequenceMatcher(None, x, y).ratio() >= least or SequenceMatcher(None, y, x).ratio() >= least:
                assert ("p", x, y) in set(got) and ("q", x, y) in set(got), (x, y)
    if least > 0.8:
        # The filter leaves out most pairs.
        assert len(got) < 0.35 * 2 * len(a) * len(b)
