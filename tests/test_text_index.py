"""Indexed fuzzy search against scoring every text."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from placekeep import model
from placekeep.operators import text_index
from placekeep.operators.text_index import TextIndex
from placekeep.plans import cli

SYLLABLES = "ba ri to ne lo ka mi stu der pin wiz ard gal axy star bow ling al ley bar grill tav ern pub arc ade fun house la ser pizza king dom city mar ket é中".split()


def names(rng, n):
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    out = set()
    while len(out) < n:
        out.add(" ".join(rng.choice(words) for _ in range(rng.randint(2, 4))))
    return sorted(out)


def misspelt(rng, text):
    for _ in range(rng.randint(1, 2)):
        at = rng.randrange(len(text))
        text = text[:at] + rng.choice(["", "x", text[at] * 2]) + text[at + 1 :]
    return text


def score(matcher, a, b):
    if a == b:
        return 1.0
    if a in b:
        return 0.95
    if b in a:
        return min(0.9, 0.55 + len(b) / len(a) * 0.35)
    matcher.set_seq1(a)
    return matcher.ratio()


def brute(texts, asked, k, least):
    """{(question id, row id): score}: the k best rows and their ties."""
    scores = {q: [] for q in asked}
    for row, text in texts.items():
        matcher = SequenceMatcher(None, "", text)
        for q, a in asked.items():
            if a and text:
                s = score(matcher, a, text)
                if s >= least:
                    scores[q].append((s, row))
    out = {}
    for q, found in scores.items():
        found.sort(key=lambda x: -x[0])
        last = found[k - 1][0] if len(found) >= k else 0.0
        out.update({(q, row): s for s, row in found if s >= last})
    return out


def searched(spark, tmp_path, texts, asked, k, least, scored=None):
    rows = spark.createDataFrame([(i, t) for i, t in texts.items()], "place long, name string")
    index = TextIndex.build(rows.repartition(3), ["place"], [F.col("name")], str(tmp_path / "index"))
    got = index.search(spark.createDataFrame(list(asked.items()), "question_id long, question string"), k, least, scored=scored).collect()
    assert len(got) == len({(r.question_id, r.place) for r in got})
    return {(r.question_id, r.place): r.score for r in got}


def test_a_thousand_questions_score_few_texts(spark, tmp_path):
    k, share = 5, 0.05
    rng = random.Random(k)
    texts = dict(enumerate(names(rng, 500)))
    asked = {i: misspelt(rng, rng.choice(list(texts.values()))).strip() for i in range(1000)}
    asked = {i: " ".join(a.split()) for i, a in asked.items()}
    count = spark.sparkContext.accumulator(0)
    assert searched(spark, tmp_path, texts, asked, k, 0.62, count) == brute(texts, asked, k, 0.62)
    assert count.value < share * len(texts) * len(asked)


@pytest.mark.parametrize("least", [0.3, 0.62, 0.85])
def test_odd_texts_and_questions(spark, tmp_path, least):
    """Nulls, empty and very short texts, repeated ones, long ones, one text within another, ties."""
    rng = random.Random(7)
    long = " ".join(names(rng, 60))
    listed = [None, "", "!?", "a", "b", "ab", "aba", "abab", "ababab", "star", "star bar", "the star bar", "star bar", "tar ba", "é中", "é中 é", long, long[:900], long[200:], "x" * 70, "x" * 64, "x" * 65 + "y"]
    listed += [f"place {i:06d}" for i in range(40)]
    texts = dict(enumerate(listed))
    asked = dict(enumerate([None, "", "?", "a", "z", "ab", "ba", "star", "star bars", "at the star bar", "place 000013", "plaec 000031", "é中", long, long[100:800], "x" * 66, "x" * 64, "star"]))
    plain = lambda d: {i: " ".join((t or "").replace("!?", "").replace("?", "").split()) for i, t in d.items()}
    assert searched(spark, tmp_path, texts, asked, 3, least) == brute(plain(texts), plain(asked), 3, least)


def test_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([], "place long, name string")
    index = TextIndex.build(rows, ["place"], [F.col("name")], str(tmp_path / "empty"))
    asked = spark.createDataFrame([(1, "star")], "question_id long, question string")
    assert index.search(asked, 3, 0.6).collect() == []
    assert index.search(asked.where("false"), 3, 0.6).collect() == []


def test_bounds_hold():
    rng = random.Random(3)
    texts = names(rng, 60) + ["", "a", "x" * 200]
    code, starts = text_index.code_points(texts)
    for a in ["a", "x" * 64, *names(rng, 20)]:
        got = text_index.common_lengths(a, code, starts, text_index.np.arange(len(texts)))
        assert got.tolist() == [text_index.common(a, b) for b in texts]
        for b, most in zip(texts, got.tolist()):
            assert sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks()) <= most


def test_searches_with_an_index_give_the_same_rows(spark, tmp_path):
    p = model.bind(spark, "/root/testdata/sf0.001")
    index, items = cli.place_index(p, str(tmp_path / "places")), cli.item_index(p, str(tmp_path / "items"))
    for query in ("Suplier#000000007", "supplier", "13 main stret", "nothing like it"):
        want = cli.search_places(p, query, 7).collect()
        assert cli.search_places(p, query, 7, index=index).collect() == want
    for query in ("smal rng", "blue anvl brand 12", "e"):
        assert cli.search_items(p, query, "FRANCE", 7, index=items).collect() == cli.search_items(p, query, "FRANCE", 7).collect()


def test_texts_that_hold_the_question_come_first(spark, tmp_path):
    """As in the tiers of a search: a text alike by .97 doesn't hide those that hold the question."""
    texts = {i: f"supplier {i:09d}" for i in (0, 1, 2, 9, 10, 50, 123)}
    rows = spark.createDataFrame(list(texts.items()), "place long, name string")
    index = TextIndex.build(rows, ["place"], [F.col("name"), F.concat_ws(" ", "name", F.lit("asia"))], str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "supplier 00000000"), (2, "suppier 000000050"), (3, "supplier 000000123"), (4, "s")], "question_id long, question string")
    got = {(r.question_id, r.place): r.score for r in index.search(asked, 1, 0.62, holding_first=True).collect()}
    want = {(1, i): 0.95 for i in (0, 1, 2, 9)} | {(2, 50): 34 / 35, (3, 123): 1.0} | {(4, i): 0.95 for i in texts}
    assert got == want


def test_questions_short_of_a_letter_score_few_texts(spark, tmp_path):
    """Numbered names are nearly all alike by .8; the best one is found without scoring them."""
    texts = {i: f"supplier {i:09d}" for i in range(400)}
    asked = {i: t[:4] + t[5:] for i, t in texts.items() if i % 4 == 3}
    count = spark.sparkContext.accumulator(0)
    assert searched(spark, tmp_path, texts, asked, 1, 0.62, count) == brute(texts, asked, 1, 0.62)
    assert count.value <= 2 * len(asked)
