from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from strandloom.sources import frames as src
from strandloom.sources import store


@pytest.fixture
def remote(spark, tmp_path):
    """A path of a scheme that only Spark's file systems open."""
    conf = spark._jsc.hadoopConfiguration()
    conf.set(f"fs.viewfs.mounttable.{tmp_path.name.replace('_', '-')}.link./in", f"file://{tmp_path}")
    return f"viewfs://{tmp_path.name.replace('_', '-')}/in"


def rows(spark, *names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, n int")


@pytest.mark.parametrize("where", ["local", "remote"])
def test_one_of_two_writers_wins(spark, tmp_path, remote, where):
    root = remote if where == "remote" else str(tmp_path)
    table = store.Store(spark, f"{root}/t", "name string, n int")
    assert table.version() == 0 and table.read().count() == 0
    assert table.commit(rows(spark, "a"), 0) == 1
    base = table.version()
    assert table.commit(rows(spark, "a", "b"), base) == 2
    with pytest.raises(store.Conflict):
        table.commit(rows(spark, "a", "c"), base)
    assert sorted(r["name"] for r in table.read().collect()) == ["a", "b"] and sorted(r["name"] for r in table.read(1).collect()) == ["a"]
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2  # the loser's rows are gone
    tried = []

    def change(old):
        tried.append(old.count())
        if len(tried) == 1:
            table.commit(old.unionByName(rows(spark, "meanwhile")), table.version())
        return old.unionByName(rows(spark, "mine"))

    assert table.update(change) == 4 and tried == [2, 3]
    assert sorted(r["name"] for r in table.read().collect()) == ["a", "b", "meanwhile", "mine"]
    table.clear_old(2)
    assert table.version() == 4 and table.read(3).count() == 3 and len(list((tmp_path / "t" / "data").iterdir())) == 2
    assert not [p for p in (tmp_path / "t" / "versions").iterdir() if "draft" in p.name and not p.name.endswith(".crc")]


def test_no_update_is_lost(spark, tmp_path):
    table = store.Store(spark, str(tmp_path / "t"), "name string, n int")
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: table.update(lambda old: old.unionByName(rows(spark, f"w{i}"))), range(6)))
    assert table.version() == 6 and sorted(r["name"] for r in table.read().collect()) == [f"w{i}" for i in range(6)]


def test_jobs(spark, tmp_path):
    jobs = store.Jobs(spark, str(tmp_path / "jobs"))
    new = spark.createDataFrame([("/x/a.mp4", "file", "a", "ready"), ("/x/b.mp4", "file", "b", "ready")], "source string, source_kind string, title string, status string")
    jobs.create(new, 1.0)
    ids = {r.title: r.id for r in jobs.read().collect()}
    step = lambda title, status: spark.createDataFrame([(ids[title], status)], "id string, status string")
    jobs.change(step("a", "queued"), 2.0)
    with pytest.raises(Exception, match="cannot change"):
        jobs.change(step("b", "rendered"), 3.0)
    jobs.delete(step("b", None))
    assert [(r.title, r.status, r.updated_at) for r in jobs.recent(5).collect()] == [("a", "queued", 2.0)] and jobs.get(ids["b"]).count() == 0
    assert jobs.version() == 3


def test_profiles(spark, tmp_path, remote):
    one = lambda name, width: spark.createDataFrame([(name, width, 5, [0, 0, 1, 1], "paginated", 1.0)], src.PROFILE)
    kept = store.Profiles(spark, f"{remote}/profiles")
    for name, width in (("a", 1), ("b", 2), ("a", 9)):
        kept.save(one(name, width))
    kept.load(one("b", 7).unionByName(one("c", 3)).withColumn("position", F.monotonically_increasing_id()))
    assert [(r["name"], r.video_width) for r in kept.read().orderBy("position").collect()] == [("b", 7), ("a", 9), ("c", 3)]
    with pytest.raises(Exception, match="invalid profile"):
        kept.load(one("d", 0).withColumn("position", F.lit(0).cast("long")))
    path = f"{remote}/deep/profiles.json"
    assert src.read_profiles(spark, path).count() == 0
    for name, width in (("a", 1), ("b", 2), ("a", 9)):
        src.save_profile(spark, path, one(name, width))
    assert [(r["name"], r.video_width) for r in src.read_profiles(spark, path).orderBy("position").collect()] == [("b", 2), ("a", 9)]
