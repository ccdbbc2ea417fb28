"""Feeds, page walks, reconciliation lists, curated tables and runs of several steps."""

import json

import pytest
from pyspark.sql import functions as F

from placekeep.plans import curation, feeds, pipelines
from placekeep.plans.render import QueryResult

from .test_operators import rows, small  # noqa: F401


def test_states():
    assert feeds.selected_states("utah") == ["UT"] and feeds.selected_states(states="co, Nevada,CO") == ["CO", "NV"]
    every = feeds.selected_states(continental=True)
    assert len(every) == 49 and "DC" in every and "AK" not in every
    with pytest.raises(ValueError):
        feeds.selected_states(states="UT,Atlantis")


def test_page_walk(spark):
    probes = spark.createDataFrame(
        [(1, "https://a.example/", 1, "Games", "https://www.a.example/games/", 9), (1, "https://a.example/", 2, "Home", "https://a.example", 8), (1, "https://a.example/", 3, "Again", "https://www.a.example/games", 7), (1, "https://a.example/", 4, "Far", "https://b.example/x", 6), (1, "https://a.example/", 5, "List", "https://l.trusted.site/", 5), (2, "https://c.example/", 1, "Games", "https://c.example/g", 3)],
        "location_id long, home string, rank int, text string, url string, score int",
    )
    got = rows(feeds.pages_to_read(probes, ["trusted.site"]), "location_id", "turn", "text")
    assert got == [(1, 0, "Games"), (1, 1, "List"), (2, 0, "Games")]
    known = spark.createDataFrame([(1, 1, "Known", "https://far.example/", 50), (9, 1, "None", "https://x.example/", 50)], "location_id long, rank int, text string, url string, score int")
    assert rows(feeds.pages_to_read(probes, [], known, limit=2), "location_id", "turn", "text") == [(1, 0, "Known"), (1, 1, "Games"), (2, 0, "Games")]
    read = spark.createDataFrame([(1, 7), (2, 0)], "location_id long, names int")
    assert rows(feeds.pages_to_read(probes, [], known, read), "location_id", "text") == [(1, "Known"), (2, "Games")]


def test_reconciliation_lists(spark):
    compared = spark.createDataFrame([(1, "website_only", "Pac Man"), (1, "website_only", "New One"), (1, "website_only", "Contact us"), (1, "missing", "Pac-Man"), (1, "missing", "Old One"), (1, "matched", "Both")], "location_id long, bucket string, name string")
    pairs = spark.createDataFrame([(1, "Pac Man", "Pac-Man", 1.0)], "location_id long, website_name string, db_name string, similarity double")
    r = feeds.reconciliation_lists(compared, pairs).first()
    assert (r.add_candidates, r.remove_candidates, r.ignored_names, r.matched_sample) == (["New One"], ["Old One"], ["Contact us"], ["Both"])
    assert [tuple(x) for x in r.renames] == [("Pac Man", "Pac-Man", 1.0)]


def test_review_queue(spark):
    candidates = spark.createDataFrame([(1, None, 5.0), (2, "merge", 9.0), (3, "pending", 7.0)], "candidate_id long, status string, priority_score double")
    members = spark.createDataFrame([(1, 10), (3, 11), (3, 12)], "candidate_id long, game_id long")
    got = feeds.review_queue(candidates, members).collect()
    assert [(r.candidate_id, [m.game_id for m in r.records]) for r in got] == [(3, [11, 12]), (1, [10])]


def test_steps_stop_at_a_failure():
    steps = pipelines.plan_steps(("UT",), apply=True)
    done = []
    actions = {s.name: done.append for s in steps[:2]} | {steps[2].name: lambda s: 1 / 0}
    out = curation.run_steps(steps, actions, apply=True)
    assert [x[1].split(":")[0] for x in out] == ["done", "done", "failed"] and [s.name for s in done] == [s.name for s in steps[:2]]
    assert {x[1] for x in curation.run_steps(steps, actions)} == {"planned"}


def test_export_and_rebuild(spark, tmp_path):
    folder = str(tmp_path / "out")
    statuses = spark.createDataFrame([(1, "closed", None), (2, "matched", "x")], "location_id long, status string, notes string")
    log = spark.createDataFrame([(1, "a")], "id long, text string")
    curation.export_curation({"old": log, "log": log}, folder, spark, "now")
    manifest = curation.export_curation({"location_statuses": statuses, "log": log, "none": None, "old": log.where("false")}, folder, spark, "now")
    assert manifest["counts"] == {"location_statuses": 2, "log": 1, "none": 0, "old": 0} and set(manifest["files"]) == {"location_statuses", "log"}
    assert json.loads((tmp_path / "out" / "manifest.json").read_text())["counts"] == manifest["counts"] and not (tmp_path / "out" / "old.jsonl").exists()
    base = {"location_statuses": spark.createDataFrame([(2, "open", "o"), (3, "open", "p")], statuses.schema), "log": log, "old": log}
    again = curation.rebuild_curation(base, folder, spark)
    assert rows(again["location_statuses"], "location_id", "status") == [(1, "closed"), (2, "matched"), (3, "open")]
    assert again["log"].count() == 2 and again["old"].count() == 1


def test_report(spark, tmp_path):
    table = QueryResult("Pairs", spark.createDataFrame([(1, "é")], "n int, t string"))
    files = curation.write_report([table], str(tmp_path), "report", spark, "now")
    assert [f.rsplit(".", 1)[1] for f in files] == ["md", "json", "csv"]
    texts = [open(f, encoding="utf-8").read() for f in files]
    assert "Generated: now" in texts[0] and json.loads(texts[1])["tables"][0]["rows"] == [{"n": 1, "t": "é"}] and texts[2] == "n,t\n1,é\n"


def test_national_run(small, spark):  # noqa: F811
    place = small.locations.where("state = 'UT'").orderBy("location_id").first()
    directory = small.locations.where(F.col("location_id") == place.location_id).select(F.lit(5).cast("long").alias("source_id"), "name", "city", "state", "street_address", "latitude", "longitude", F.expr("array(struct('1' AS id, '3' AS condition, struct('70' AS id, 'Some Unheard Game' AS name, 'Video' AS genre) AS game))").alias("machines"))
    out = curation.curate(small, ["UT"], "now", directory=directory)
    assert out.counts["directory_sure"] == 1 and out.counts["machines"] == 1
    assert rows(out.tables["games"].where("name = 'Some Unheard Game'"), "game_id") == [(-2_000_000_070,)]
    assert out.tables["location_games"].count() == small.location_games.count() + 1
    elsewhere = curation.curate(small, ["NV"], "now", directory=directory)
    assert elsewhere.counts["machines"] == 0
