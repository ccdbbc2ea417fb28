"""The pipeline's stages on a small corpus, each against what its operator says of its own input."""

import random

import pytest

import corpus_pipeline
from placekeep.llm import langid, mixing, near_copies, toxicity

from .helpers import ODD
from .test_learned_operators import LANGS

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    at = str(tmp_path_factory.mktemp("corpus"))
    rows, marks = [], []
    for i in range(150):
        lang = ["xx", "yy"][i % 2]
        words = ["".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 200))]
        if i % 5 == 0:
            words[3:3] = ["vileword", "vilewords"]
        rows.append((i, " ".join(words), lang, "big" if i % 3 else f"s{i % 4}", 0))
        marks.append((i, 1, int(i % 5 == 0)))
    rows += [(200 + i, rows[i][1], rows[i][2], "copy", 0) for i in range(1, 40, 6)]
    rows += [(300 + i, t, None, None, 0) for i, t in enumerate(ODD)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    outs = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        outs.append((docs, out))
        docs = out
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)
    before, after = outs[0]
    found = {r.doc_id: r for r in langid.identify(before, langid.fit(before)).collect()}
    assert ids(after) == sorted((i for i, r in found.items() if r.lang_pred != "und" and r.score >= 0.5), key=str)
    assert not {300, 301, 302} & set(ids(after)) and set(range(150)) <= set(ids(after))
    before, after = outs[1]
    scored = {r.doc_id: r for r in toxicity.score_toxicity(before, toxicity.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))).collect()}
    assert ids(after) == sorted((i for i, r in scored.items() if not r.predicted), key=str)
    assert not set(range(0, 150, 5)) & set(ids(after)) and {i for i in range(150) if i % 5} <= set(ids(after))
    before, after = outs[2]
    assert ids(after) == sorted({r.component_id for r in near_copies.similar_documents(before).collect()}, key=str)
    assert not any(200 <= i < 300 for i in ids(after))
    before, after = outs[3]
    assert ids(after) == sorted((r.doc_id for r in mixing.mix(before).collect()), key=str) and set(ids(after)) == set(ids(before))
    before, after = outs[4]
    rows = after.collect()
    assert sorted((r.doc_id for r in rows if r.start == 0), key=str) == ids(before)
    total = {}
    for r in rows:
        total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
    assert max(total.values()) <= 1024
    assert len(corpus_pipeline.run(spark, sf_dir).collect()) == len(rows)


@pytest.mark.parametrize("case", ["no rows", "no labels", "nulls", "clashes"])
def test_odd_tables(spark, tmp_path, case):
    rows = {"no rows": [], "nulls": [(None, None, None, None, None)] * 3 + [(1, None, None, None, None), (2, "a b", None, None, None)]}.get(case) or [
        (i, f"kaldor min {i} zekmin dorkal", "xx", "s", 3) for i in range(12) if case != "no rows"
    ]
    names = ["score", "predicted", "_block", "fp", "row", "sequence_id", "_label", "lang_pred"] if case == "clashes" else []
    docs = spark.createDataFrame([(*r, *["c"] * len(names)) for r in rows], COLUMNS + "".join(f", {n} string" for n in names))
    marks = [(i, 1, i % 2) for i in range(12)] if case != "no labels" else []
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        # The first two stages learn from whole tables; without anything to learn they may keep nothing.
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        found = out.collect()
        if case == "no rows":
            assert not found
        elif name in ("near_dedup", "mixing", "packing"):
            assert found and all(r["score"] == "c" for r in found if "score" in out.columns)
