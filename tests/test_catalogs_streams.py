import pytest
from pyspark.sql import functions as F

from strandloom.functions import text as tx
from strandloom.operators import seq
from strandloom.sources import frames as src
from strandloom.streaming import wraps


def test_profiles(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"name":"a","video_width":10,"video_height":5,"region":[0,0,1,1],"mode":"paginated","created_at":1.0},{"name":"b","video_width":10,"video_height":5,"region":[0,0,2,2],"mode":"paginated","created_at":2.0}]')
    base = src.read_profiles(spark, str(tmp_path / "p.json"))
    new = base.filter("name = 'a'").withColumn("video_width", F.lit(77)).unionByName(base.filter("name = 'b'").withColumn("name", F.lit("c")))
    assert [(r["name"], r.video_width) for r in src.import_profiles(base, new).collect()] == [("a", 77), ("b", 10), ("c", 10)]
    with pytest.raises(Exception, match="invalid profile"):
        src.import_profiles(base, new.withColumn("mode", F.lit("sideways"))).collect()
    (tmp_path / "bad.json").write_text('[{"name": 1, ')
    with pytest.raises(Exception):
        src.read_profiles(spark, str(tmp_path / "bad.json")).collect()
    assert src.preferences({"a": 1, "x": 2}, {"a": 0, "b": 5}) == {"a": 1, "b": 5}


def test_jobs(spark):
    jobs = spark.createDataFrame([("1", "ready", None), ("2", "rendered", "t")], "id string, status string, title string").select(
        "id", "status", "title", F.lit(1.0).alias("updated_at")
    )
    change = spark.createDataFrame([("1", "queued", None)], "id string, status string, title string")
    got = {r.id: (r.status, r.title, r.updated_at) for r in src.update_jobs(jobs, change, 9.0).collect()}
    assert got == {"1": ("queued", None, 9.0), "2": ("rendered", "t", 1.0)}
    with pytest.raises(Exception, match="cannot change"):
        src.update_jobs(jobs, change.withColumn("status", F.lit("rendered")), 9.0).collect()


@pytest.mark.parametrize("expression, want", [
    (lambda: tx.normalise_url(F.lit(" example.org/x ")), "https://example.org/x"), (lambda: tx.normalise_url(F.lit("ftp://a/b")), None), (lambda: tx.normalise_url(F.lit("")), None),
    (lambda: tx.safe_file_name(F.lit("../a b?"), F.lit("song_1")), "___a b_"), (lambda: tx.safe_file_name(F.lit("  "), F.lit("song_1")), "song_1"), (lambda: tx.safe_folder_name(F.lit("a.b/c")), "a.b_c"),
    (lambda: tx.first_rule(F.lit("ERROR: HTTP Error 403"), tx.ERROR_RULES, "unknown"), "outdated"), (lambda: tx.tail_lines(F.lit("a\n\nb\nc\nd\ne"), 4), "b / c / d / e"),
    (lambda: tx.tail_lines(F.lit("banner\nx"), 4, 400, "^banner"), "x"), (lambda: tx.tail_lines(F.lit("banner"), 4, 400, "^banner"), "banner"), (lambda: tx.digits_to_int(F.lit("a1b2")), 12), (lambda: tx.digits_to_int(F.lit("x")), None),
    (lambda: tx.checksum_of(F.lit("AB12  one\nCD34  two"), F.lit("two")), "cd34"), (lambda: tx.instrument(F.lit(6)), "guitar"), (lambda: tx.instrument(F.lit(9)), "9 lines"), (lambda: tx.duration_text(F.lit(125.4)), "2:05"),
    (lambda: tx.progress_fields(F.lit("out_time=1=2"))["value"], "1=2"), (lambda: tx.has_video_suffix(F.lit("/x/A.MP4")), True), (lambda: tx.has_video_suffix(F.lit("/x/a.txt")), False),
    (lambda: tx.mapped(F.lit("queued_render"), tx.STATUS_LABELS, F.lit("?")), "queued"), (lambda: tx.number_or_zero(F.lit("n/a")), 0.0), (lambda: tx.region_of(F.lit(5.5), F.lit(9.0), F.lit(1.2), F.lit(2.0))["x0"], 1),
])
def test_scalars(spark, expression, want):
    assert spark.range(1).select(expression()).first()[0] == want


@pytest.mark.parametrize("n, k", [(1, 40), (2, 40), (10, 1), (10, 3), (100, 40), (41, 40)])
def test_even_sample(spark, n, k):
    got = sorted(r.pos for r in seq.even_sample(spark.range(n).withColumn("g", F.lit(1)), ["g"], ["id"], k).collect())
    m = min(k, n)
    assert got == sorted({0} if m == 1 else {j * (n - 1) // (m - 1) for j in range(m)})


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"v{i % 3}", i // 3, float((i * 37) % 100)) for i in range(90)]
    schema = "video string, frame long, x double"
    for part in range(3):
        spark.createDataFrame(rows[part * 30 : part * 30 + 30], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in" / f"{part}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for name, frame in (("w", wraps.page_wraps(stream, "video", "frame", "x", 30.0)), ("o", wraps.running_offsets(stream, "video", "frame", "x"))):
        q = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    batch = spark.createDataFrame(rows, schema)
    want = {(r.video, r.frame) for r in seq.page_wraps(batch, ["video"], ["frame"], "x", F.lit(30.0)).collect()}
    assert {(r.video, r.frame) for r in spark.table("w").collect()} == want
    assert spark.table("o").groupBy("video").agg(F.max("offset")).count() == 3 and abs(spark.table("o").agg(F.max("offset")).first()[0] - max(sum(x for v, _, x in rows if v == k) for k in ("v0", "v1", "v2"))) < 1e-6


def test_decoder_metadata(spark):
    import json

    from strandloom.sources import decode

    assert list(decode.progress(iter(["frame=1", "out_time_us=500000", "out_time_us=N/A", "out_time_us=9000000", "progress=end"]), 2.0)) == [0.25, 1.0, 1.0]
    assert list(decode.progress(iter(["out_time_us=5", "progress=end"]), 0.0)) == [1.0]
    formats = [("a", 720, 30.0, "avc"), ("b", 1080, 30.0, "avc"), ("c", 1080, 60.0, "vp9"), ("d", None, None, "avc"), ("e", None, None, "none"), ("f", 1080, 60.0, "av1"), ("g", 480, 30.0, None)]
    text = json.dumps({"title": "t", "formats": [{"format_id": i, "height": h, "fps": f, "vcodec": v} for i, h, f, v in formats]})
    got = decode.best_formats(spark.createDataFrame([("1", text)], "id string, json string")).orderBy("rank").collect()
    assert [r.format_id for r in got] == ["c", "a", "d"] and got[0].duration == 0.0


def test_profile_store(spark, tmp_path):
    path = str(tmp_path / "deep" / "profiles.json")
    assert src.read_profiles(spark, path).count() == 0
    one = lambda name, width: spark.createDataFrame([(name, width, 5, [0, 0, 1, 1], "paginated", 1.0)], src.PROFILE)
    for name, width in (("a", 1), ("b", 2), ("c", 3), ("a", 9)):
        src.save_profile(spark, path, one(name, width))
    assert [(r["name"], r.video_width, list(r.region)) for r in src.read_profiles(spark, path).orderBy("position").collect()] == [("b", 2, [0, 0, 1, 1]), ("c", 3, [0, 0, 1, 1]), ("a", 9, [0, 0, 1, 1])]


def test_preference_file(tmp_path):
    path, defaults = str(tmp_path / "p.json"), {"fps": 2, "folder": None}
    assert src.read_preferences(path, defaults) == defaults
    assert src.save_preferences(path, {"fps": 4, "unknown": 1}, defaults) == {"fps": 4, "folder": None} == src.read_preferences(path, defaults)
    for broken in ("{not json", "[1, 2]"):
        (tmp_path / "p.json").write_text(broken)
        assert src.read_preferences(path, defaults) == defaults
    assert src.save_preferences(path, {"folder": "/x"}, defaults) == {"fps": 2, "folder": "/x"}


def test_job_rows(spark):
    empty = spark.createDataFrame([], src.JOB)
    new = spark.createDataFrame([("/x/a.mp4", "file", "a", "ready"), ("/x/b.mp4", "file", "b", "new")], "source string, source_kind string, title string, status string")
    jobs = spark.createDataFrame(src.create_jobs(empty, new, 7.0).collect(), src.JOB)
    rows = jobs.collect()
    assert len({r.id for r in rows}) == 2 and all(len(r.id) == 32 and r.created_at == r.updated_at == 7.0 and r.analysis is None for r in rows)
    gone = spark.createDataFrame([(rows[0].id,), ("unknown",)], "id string")
    assert [r.id for r in src.delete_jobs(jobs, gone).collect()] == [rows[1].id]
    assert src.job(jobs, rows[1].id).first().title == rows[1].title and src.job(jobs, "none").count() == 0
    told = jobs.withColumn("analysis", F.when(F.col("title") == "a", F.lit('{"frame_count": 3}')))
    got = {r.title: r.analysis for r in src.decoded(told, {"analysis": "frame_count int"}).collect()}
    assert got["a"].frame_count == 3 and got["b"] is None


def test_sources_must_be_files(spark, tmp_path):
    (tmp_path / "a.MKV").write_bytes(b"")
    (tmp_path / "b.txt").write_bytes(b"")
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.MKV", "b.txt", "gone.mp4")], "path string")
    good, bad = src.admitted(src.with_existence(paths), exists="exists")
    assert [r.path.rsplit("/", 1)[1] for r in good.collect()] == ["a.MKV"] and bad.count() == 2


@pytest.mark.parametrize("expression, want", [
    (lambda: tx.normalise_url(F.lit("\t example.org/a b\n")), "https://example.org/a b"), (lambda: tx.normalise_url(F.lit("https:///x")), None), (lambda: tx.size_text(F.lit(2_600_000)), "3 MB"),
    (lambda: tx.size_text(F.lit(None).cast("long")), "unknown size"), (lambda: tx.display_time(F.lit(86_400.5)), "1970-01-02 00:00:00"), (lambda: tx.epoch_seconds(F.timestamp_seconds(F.lit(12.25))), 12.25),
    (lambda: tx.handshake(F.lit('GO {"port": 81, "token": "t"}'), "GO ")["port"], 81), (lambda: tx.handshake(F.lit('GO {"port": "81", "token": "t"}'), "GO "), None), (lambda: tx.handshake(F.lit('GO {"port": 81, "token": 5}'), "GO "), None),
    (lambda: tx.handshake(F.lit("GO {broken"), "GO "), None), (lambda: tx.handshake(F.lit('{"port": 81, "token": "t"}'), "GO "), None),
])
def test_more_scalars(spark, expression, want):
    assert spark.range(1).select(expression()).first()[0] == want


def test_region_handles(spark):
    box = F.struct(F.lit(10).alias("x0"), F.lit(20).alias("y0"), F.lit(60).alias("x1"), F.lit(50).alias("y1"))
    at = lambda x, y: spark.range(1).select(tx.handle_at(box, F.lit(x), F.lit(y), 5.0)).first()[0]
    assert [at(12, 18), at(58, 22), at(10, 54.9), at(60, 50), at(30, 30), at(15, 20), at(9, 30)] == ["nw", "ne", "sw", "se", "move", None, None]
    moved = lambda h: tuple(spark.range(1).select(tx.dragged(box, F.lit(h), F.lit(70.5), F.lit(1.0))).first()[0])
    assert [moved(h) for h in ("nw", "se", "move", "none")] == [(60, 21, 81, 50), (10, 20, 131, 51), (81, 21, 131, 51), (10, 20, 60, 50)]


def test_progress_stream(spark, tmp_path):
    from strandloom.streaming import progress

    rows = [("a", "sample", k / 10, str(k), float(k)) for k in range(10)] + [("a", "region", 0.5, "r", 10.0), ("b", "done", 1.0, "d", 1.0)]
    spark.createDataFrame(rows, "job_id string, stage string, pct double, message string, ts double").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id string, stage string, pct double, message string, ts double").json(str(tmp_path / "in"))
    got = []
    progress.publish(stream.withColumn("pct", progress.overall(F.col("stage"), F.col("pct"))), lambda batch, n: got.extend(batch.collect()), str(tmp_path / "c"), most=4).awaitTermination()
    assert sorted((r.job_id, r.message) for r in got) == [("a", "0"), ("a", "1"), ("a", "2"), ("a", "3"), ("b", "d")]
    progress.publish(stream, lambda batch, n: got.append("never"), str(tmp_path / "d"), cancelled=lambda: True).awaitTermination()
    assert "never" not in got
    bands = spark.createDataFrame([("a", 0.5, 1.0), ("a", 0.2, 2.0), ("a", 0.9, 3.0)], "job_id string, pct double, ts double")
    assert [r.pct for r in progress.never_back(bands).orderBy("ts").collect()] == [0.5, 0.5, 0.9]
