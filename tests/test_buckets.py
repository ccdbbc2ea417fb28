"""Tables in buckets: few files are rewritten, results equal whole upserts, and commits of several writers."""

import pytest
from pyspark.sql import functions as F

from placekeep.operators import buckets, upsert


def table(spark, n, start=0):
    k = F.col("id") + start
    return spark.range(n).select(k.alias("k"), (k * 7 % 11).alias("a"), F.when(k % 3 != 0, F.concat(F.lit("v"), k)).alias("b"))


def same(x, y):
    key = lambda r: tuple(map(str, r))
    return sorted(map(tuple, x.select(*y.columns).collect()), key=key) == sorted(map(tuple, y.collect()), key=key)


def data_files(tmp_path):
    return {p for p in (tmp_path / "db" / "data").rglob("*.parquet")}


@pytest.mark.parametrize("default", ["fill", "prefer_new"])
def test_clustered_upsert_rewrites_few_files(spark, tmp_path, default):
    store = buckets.BucketStore(spark, str(tmp_path / "db"), file_rows=500)
    rows = table(spark, 60_000)
    store.commit(store.create("t", rows, ["k"], buckets=8))
    before, files = data_files(tmp_path), store.manifest("t").count()
    assert files >= 100 and same(store.read("t"), rows)
    # 1 % of the keys, one run of them, and a few new ones.
    changes = table(spark, 600, 30_000).withColumn("b", F.lit("new")).withColumn("a", F.lit(5).cast("long"))
    version = buckets.upsert_into(store, "t", changes, {"a": "new"}, default)
    written = data_files(tmp_path) - before
    assert version == 2 and 0 < len(written) < 0.05 * files
    assert same(store.read("t"), upsert.upsert(rows, changes, ["k"], {"a": "new"}, default))
    assert same(store.read("t", 1), rows)
    beyond = table(spark, 50, 100_000).unionByName(table(spark, 5, -40))
    buckets.upsert_into(store, "t", beyond, {})
    assert store.read("t").count() == 60_055


def test_scattered_changes_keep_files_apart(spark, tmp_path):
    """Files between two rewritten ones of a bucket stay between them."""
    store = buckets.BucketStore(spark, str(tmp_path / "db"), file_rows=50)
    rows = table(spark, 1000).withColumn("k", F.col("k") * 2)
    store.commit(store.create("t", rows, ["k"], buckets=1))
    want = rows
    for step in (700, 333, 61):
        changes = table(spark, 2000).where(f"k % {step} = 0").withColumn("b", F.concat(F.lit(f"{step}-"), "k"))
        buckets.upsert_into(store, "t", changes, {}, "prefer_new")
        want = upsert.upsert(want, changes, ["k"], {}, "prefer_new")
        assert same(store.read("t"), want)
        spans = sorted((r.low.k, r.high.k) for r in store.manifest("t").collect())
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_keys_of_several_columns(spark, tmp_path):
    store = buckets.BucketStore(spark, str(tmp_path / "db"), file_rows=20)
    schema = "s string, i int, v string"
    rows = spark.createDataFrame([(s, i, f"{s}{i}") for s in ["a", "b", "é", None, ""] for i in range(40)], schema)
    store.commit(store.create("t", rows, ["s", "i"], buckets=3))
    changes = spark.createDataFrame([("a", 3, "x"), ("zz", 1, "y"), ("é", 99, "z"), ("", 0, None)], schema)
    for how in (lambda t, c: upsert.replace_rows(t, c, ["s", "i"]), lambda t, c: upsert.append_if_new(t, c, ["s", "i"])):
        want = how(store.read("t"), changes)
        expected = sorted(map(tuple, want.collect()), key=str)
        store.commit(store.merge("t", changes, how))
        assert sorted(map(tuple, store.read("t").collect()), key=str) == expected


def test_empty_tables(spark, tmp_path):
    store = buckets.BucketStore(spark, str(tmp_path / "db"))
    store.commit(store.create("t", table(spark, 0), ["k"]))
    assert store.read("t").columns == ["k", "a", "b"] and store.read("t").count() == 0
    buckets.upsert_into(store, "t", table(spark, 0), {})
    buckets.upsert_into(store, "t", table(spark, 3), {})
    assert store.read("t").count() == 3
    store.commit(store.merge("t", table(spark, 3), lambda rows, new: rows.join(new.select("k"), "k", "left_anti")))
    assert store.read("t").count() == 0


def test_writers_on_different_tables_both_land(spark, tmp_path):
    one, two = (buckets.BucketStore(spark, str(tmp_path / "db")) for _ in range(2))
    one.commit(one.create("u", table(spark, 5), ["k"], change=one.create("t", table(spark, 5), ["k"])))
    a = one.merge("t", table(spark, 2, 10), lambda t, c: upsert.append_if_new(t, c, ["k"]))
    b = two.merge("u", table(spark, 3, 10), lambda t, c: upsert.append_if_new(t, c, ["k"]))
    assert (two.commit(b), one.commit(a)) == (2, 3)
    assert one.read("t").count() == 7 and one.read("u").count() == 8 and one.read("t", 2).count() == 5


def test_writers_on_one_table(spark, tmp_path):
    """The second on a bucket gets a conflict and changes nothing; in other buckets it lands."""
    one, two = (buckets.BucketStore(spark, str(tmp_path / "db"), file_rows=100) for _ in range(2))
    one.commit(one.create("t", table(spark, 40_000), ["k"], buckets=32))
    bump = lambda t, c: upsert.upsert(t, c, ["k"], {}, "prefer_new")
    new = lambda start, v: table(spark, 10, start).withColumn("b", F.lit(v))
    a, b = one.merge("t", new(0, "A"), bump), two.merge("t", new(5, "B"), bump)
    far = two.merge("t", new(20_000, "C"), bump)
    assert not set(far.touched["t"]) & set(a.touched["t"])
    assert two.commit(b) == 2
    with pytest.raises(buckets.Conflict):
        one.commit(a)
    assert two.commit(far) == 3 and one.version() == 3
    got = {r.k: r.b for r in one.read("t").where("b IN ('A', 'B', 'C')").collect()}
    assert got == {**{k: "B" for k in range(5, 15)}, **{k: "C" for k in range(20_000, 20_010)}} and one.read("t").count() == 40_000
    assert one.commit(one.merge("t", new(0, "A"), bump)) == 4 and one.read("t").where("b = 'A'").count() == 10


@pytest.mark.parametrize("step, table_of_other", [*((k, "t") for k in range(6)), (1, "u"), (4, "u")])
def test_interleaved_at_every_step(spark, tmp_path, monkeypatch, step, table_of_other):
    """Another writer commits right before the given step of a commit: state, manifest, pointer."""
    one, two = (buckets.BucketStore(spark, str(tmp_path / "db")) for _ in range(2))
    one.commit(one.create("u", table(spark, 4), ["k"], buckets=1, change=one.create("t", table(spark, 4), ["k"], buckets=1)))
    append = lambda t, c: upsert.append_if_new(t, c, ["k"])
    mine, calls = one.merge("t", table(spark, 1, 10), append), []

    def interleaved(owner, name):
        whole = getattr(owner, name)

        def run(*args):
            calls.append(name)
            if len(calls) == step + 1:
                two.commit(two.merge(table_of_other, table(spark, 1, 20), append))
            return whole(*args)

        monkeypatch.setattr(owner, name, run)

    for owner, name in ((one, "version"), (one, "state"), (one.pointers, "claim"), (one.pointers, "write")):
        interleaved(owner, name)
    try:
        one.commit(mine)
        landed = True
    except buckets.Conflict:
        landed = False
    monkeypatch.undo()
    other = len(calls) > step
    assert landed == (not other or table_of_other == "u")
    assert {r.k for r in one.read("t").collect()} == {0, 1, 2, 3} | ({10} if landed else set()) | ({20} if other and table_of_other == "t" else set())
    assert {r.k for r in one.read("u").collect()} == {0, 1, 2, 3} | ({20} if other and table_of_other == "u" else set())


def test_failure_before_the_pointer(spark, tmp_path, monkeypatch):
    store = buckets.BucketStore(spark, str(tmp_path / "db"))
    store.commit(store.create("t", table(spark, 4), ["k"]))
    monkeypatch.setattr(store.pointers, "claim", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        buckets.upsert_into(store, "t", table(spark, 9), {})
    monkeypatch.undo()
    assert store.version() == 1 and store.read("t").count() == 4
    assert buckets.upsert_into(store, "t", table(spark, 9), {}) == 2 and store.read("t").count() == 9


def test_compaction_and_removal(spark, tmp_path):
    store = buckets.BucketStore(spark, str(tmp_path / "db"), file_rows=1000)
    store.commit(store.create("t", table(spark, 100), ["k"], buckets=2))
    for k in range(4):
        store.file_rows = 20
        buckets.upsert_into(store, "t", table(spark, 100, 100 * k), {"a": "new"})
    store.file_rows = 1000
    rows, many = store.read("t").collect(), store.manifest("t").count()
    store.compact("t")
    assert store.manifest("t").count() <= 2 < many and sorted(store.read("t").collect()) == sorted(rows)
    held = len(data_files(tmp_path))
    removed = store.remove_old()
    assert removed == held - store.manifest("t").count() and len(data_files(tmp_path)) == store.manifest("t").count()
    assert sorted(store.read("t").collect()) == sorted(rows) and store.compact("t") == store.version()
