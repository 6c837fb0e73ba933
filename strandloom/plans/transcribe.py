"""From frames to sheets: analyse videos, render their songs, publish documents. Videos and songs are rows, not loops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import planes as pl
from strandloom.functions import text as tx
from strandloom.operators import folds, seq, video
from strandloom.sources import document_sink, pdf
from strandloom.stored import ready, stored, with_rows_of

SONGS = "array<struct<index:int,start:int,end:int>>"


#: Fixed value: the instrument of a video whose region comes from a profile.
BY_PROFILE = "(perfil)"


def analyse(frames: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """One row a video: region, confidence, mode, songs. A profile of the exact resolution skips detection of region and mode.

    All videos go through each stage together; what a later stage needs of a video, its region, is joined by video_id. What
    is read again (candidates, displacements, the result, all of few rows a video) is stored; the number of jobs does not
    grow with videos.
    """
    sizes = getattr(frames, "headers", frames).groupBy("video_id").agg(F.max("width").alias("video_width"), F.max("height").alias("video_height"), F.count("*").alias("frame_count"))
    if profiles is None:
        known = sizes.select("*", F.lit(None).cast("string").alias("profile"), F.lit(None).cast("string").alias("p_mode"), F.lit(None).cast("array<int>").alias("p_region"))
    else:
        listed = profiles.select("video_width", "video_height", "position", F.col("name").alias("profile"), F.col("mode").alias("p_mode"), F.col("region").alias("p_region"))
        known = seq.first_match(sizes, listed, ["video_width", "video_height"], "position").drop("position")
    known = stored(known, "videos")
    new = with_rows_of(frames, known.filter("profile IS NULL").select("video_id"))
    counts = stored(known.filter("profile IS NULL").select("video_id", F.col("frame_count").alias("n")), "frame-counts")
    found = stored(video.detect_region(new, counts), "regions")
    modes = video.classify_advance(new, found, counts).select("video_id", "mode")
    box = F.coalesce("p_region", F.array(*video.EDGES))
    info = known.join(found.drop("low_res_warning"), "video_id", "left").join(modes, "video_id", "left").select(
        "video_id", "video_width", "frame_count", "profile", box.alias("region"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce("p_mode", "mode").alias("mode"),
    )
    info = stored(info.withColumn("low_res_warning", F.get("region", F.lit(2)) - F.get("region", F.lit(0)) < video.LOW_WIDTH), "told-videos")
    songs = folds.segments(video.signatures(frames, regions(info)), ["video_id"], ["frame_idx"], "sig")
    listed = songs.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("index", "start", "end"))).cast(SONGS).alias("songs"))
    instrument = F.when(F.col("profile").isNotNull(), BY_PROFILE).otherwise(tx.instrument(F.col("n_lines")))
    return stored(info.join(listed, "video_id").select("*", instrument.alias("instrument")), "analysis")


def regions(info: DataFrame) -> DataFrame:
    """(video_id, x0, y0, x1, y1) of analysed videos."""
    return info.select("video_id", *(F.get("region", F.lit(i)).cast("int").alias(e) for i, e in enumerate(video.EDGES)))


def _notes(row: dict[str, Column]) -> Column:
    """What a reader of a report should look at, in a fixed order."""
    number = lambda c: c.cast("string")
    ranges = F.transform(row["left_out"], lambda r: F.format_string("%d-%d", r["start"], r["end"]))
    lines = F.array(
        F.when(F.exists(row["issues"], lambda i: i["kind"] == "gap"), "numbers jump without a reason: look at the pages around"),
        F.when(row["low"] > 0, F.concat(number(row["low"]), F.lit(" systems rest on too few frames"))),
        F.when(~row["overlap_ok"] & (row["unresolved"] > 0), F.concat(number(row["unresolved"]), F.lit(" steps could not be measured"))),
        F.when(~row["overlap_ok"] & (row["max_jump"] >= row["window"]), F.concat(F.lit("a step of "), number(row["max_jump"]), F.lit(" rows leaves the window of "), number(row["window"]))),
        F.when(row["cuts_on_ink"] > 0, F.concat(number(row["cuts_on_ink"]), F.lit(" cuts touch ink"))),
        F.when(pl.ink_flag(row["discarded_ink"]) != "ok", F.concat(number(row["discarded_ink"]), F.lit(" inked pixels lie outside all systems"))),
        F.when(row["transitions"] > 0, F.concat(number(row["transitions"]), F.lit(" pages were left out as transitions (frames "), F.array_join(ranges, ", "), F.lit(")"))),
    )
    return F.filter(lines, lambda n: n.isNotNull())


def render(frames: DataFrame, region: video.Region, mode: str, reader=None, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(placed systems, report) of the frames of each video, all of one mode. ``counts`` (video_id, n) saves a scan."""
    none = lambda kind: F.lit(None).cast(kind)
    if mode == "paginated":
        starts = video.page_starts(video.cursor_track(frames, region))
        pages = stored(video.compose_pages(video.page_frames(frames, starts, counts), region), "pages")
        systems = video.page_systems(pages)
        dropped = pages.groupBy("video_id").agg(F.array_sort(F.collect_list(F.when(F.col("transition"), F.struct("start", "end")))).alias("left_out"))
        checks = dropped.select(
            "video_id", F.lit(0).alias("cuts_on_ink"), F.lit(0).cast("long").alias("discarded_ink"), none("boolean").alias("overlap_ok"), none("int").alias("max_jump"),
            F.lit(0).cast("long").alias("unresolved"), none("int").alias("window"), F.size("left_out").alias("transitions"), "left_out",
        )
    else:
        across = mode == "scroll_horizontal"
        offsets = stored(video.scroll_offsets(frames, region, across), "offsets")
        systems = video.scroll_systems(stored(video.compose_scroll(frames, offsets, region, across), "bands"))
        seen = video.offset_check(offsets)
        checks = systems.groupBy("video_id").agg(F.max("cuts_on_ink").alias("cuts_on_ink"), F.max("discarded_ink").alias("discarded_ink")).join(seen, "video_id")
        checks = checks.select("video_id", "cuts_on_ink", "discarded_ink", F.col("ok").alias("overlap_ok"), "max_jump", "unresolved", "window", F.lit(0).alias("transitions"), none("array<struct<start:int,end:int>>").alias("left_out"))
    systems = stored(systems, "systems")
    placed = video.layout(systems)
    audit = folds.continuity(video.number_readings(systems, reader), ["video_id"], ["pos"], "number")
    weak = F.sort_array(F.collect_list(F.when(F.col("low_confidence"), F.col("pos"))))
    counts = systems.groupBy("video_id").agg(F.sum(F.col("low_confidence").cast("int")).alias("low"), F.count("*").alias("n_systems"), weak.alias("low_confidence_systems"))
    report = counts.join(checks, "video_id").join(audit, "video_id")
    bad = F.coalesce(~F.col("overlap_ok"), F.lit(False)).cast("int")
    score = folds.penalty_score(F.size("issues"), F.col("low"), bad, F.col("cuts_on_ink"), F.col("discarded_ink"))
    row = F.struct("issues", "n_read", "n", "n_kept", "reliable", "first", "last")
    names = ("issues", "low", "overlap_ok", "unresolved", "max_jump", "window", "cuts_on_ink", "discarded_ink", "transitions", "left_out")
    return placed, report.select(
        "video_id", "n_systems", "low", "low_confidence_systems", "overlap_ok", "cuts_on_ink", "discarded_ink", pl.ink_flag(F.col("discarded_ink")).alias("discarded_ink_flag"), "issues",
        folds.continuity_text(row).alias("continuity"), _notes({n: F.col(n) for n in names}).alias("notes"), score.alias("score"),
    )


def songs_of(info: DataFrame, boundaries: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """(song_id, video_id, index, start, end, title) of each song; ``boundaries`` (video_id, start, end) replace a video's songs
    and are numbered by start, ``titles`` (video_id, index, title) name them, else they are called by number."""
    found = info.select("video_id", F.explode("songs").alias("s")).select("video_id", "s.*")
    if boundaries is not None:
        given = seq.number(boundaries, ["video_id"], ["start"], "index").select("video_id", "index", "start", "end")
        found = found.join(given.select("video_id").distinct(), "video_id", "left_anti").unionByName(given)
    named = found.withColumn("song_id", F.format_string("%s#%04d", "video_id", "index"))
    layers = [] if titles is None else [titles.select(F.format_string("%s#%04d", "video_id", "index").alias("song_id"), "title")]
    return seq.precedence(named, "song_id", "title", layers, F.format_string("Song %d", F.col("index") + 1))


def render_songs(frames: DataFrame, info: DataFrame, songs: DataFrame, overrides: DataFrame | None = None, reader=None) -> tuple[DataFrame, DataFrame]:
    """(placed systems, report) of every song, by song_id. ``overrides`` (video_id, x0, y0, x1, y1) replace detected regions.

    A frame's number counts from 0 in its song; the three kinds of motion are three plans over the songs of that kind. A frame
    finds its songs in the list of its video's, so frames are not shuffled.
    """
    box = regions(info)
    if overrides is not None:
        box = box.join(overrides.select("video_id"), "video_id", "left_anti").unionByName(overrides.select("video_id", *video.EDGES))
    told = songs.join(info.select("video_id", "mode"), "video_id").join(box, "video_id")
    listed = told.groupBy("video_id").agg(F.collect_list(F.struct("song_id", "start", "end", "mode", *video.EDGES)).alias("songs"))
    at = F.col("frame_idx")
    own = with_rows_of(frames, listed).withColumn("s", F.explode_outer(F.filter("songs", lambda s: (s["start"] <= at) & (at <= s["end"])))).filter("s IS NOT NULL")
    own = own.select(F.col("s.song_id").alias("video_id"), (at - F.col("s.start")).cast("int").alias("frame_idx"), "height", "width", "data", "s.mode", *(f"s.{e}" for e in video.EDGES))
    # a song may say that it ends after its video does
    known = songs.join(info.select("video_id", "frame_count"), "video_id")
    n = F.least(F.col("end") + 1, F.col("frame_count")) - F.col("start")
    counts = stored(known.select(F.col("song_id").alias("video_id"), n.alias("n")), "song-counts")
    parts = [render(own.filter(F.col("mode") == m), None, m, reader, counts) for m in ("paginated", "scroll_vertical", "scroll_horizontal")]
    out = []
    for tables in zip(*parts, strict=True):
        whole = tables[0]
        for t in tables[1:]:
            whole = whole.unionByName(t)
        out.append(whole.withColumnRenamed("video_id", "song_id"))
    return out[0], out[1]


def sheets(placed: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, sheet, height, width, bits): each sheet drawn by itself and packed to one bit a pixel."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        bands = [(int(r.y), np.frombuffer(r.canvas, np.uint8).reshape(r.height, r.width)) for r in rows.itertuples()]
        first = rows.iloc[0]
        return pd.DataFrame([(first[key], first["sheet"], *pdf.packed(pdf.sheet(bands)))], columns=[key, "sheet", "height", "width", "bits"])

    ready(placed.sparkSession)
    return placed.groupBy(key, "sheet").applyInPandas(one, f"{key} string, sheet int, height int, width int, bits binary")


def _bound(pages: DataFrame, key: str) -> DataFrame:
    """One PDF a key from its pages (key, name, ordinal, caption, height, width, bits)."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ordinal")
        content = pdf.document([(int(r.height), int(r.width), r.bits, r.caption) for r in rows.itertuples()])
        return pd.DataFrame([(rows[key].iloc[0], rows["name"].iloc[0], len(rows), content)], columns=[key, "name", "pages", "content"])

    ready(pages.sparkSession)
    return pages.groupBy(key).applyInPandas(one, f"{key} string, name string, pages int, content binary")


def _captioned(pages: DataFrame, key: str) -> DataFrame:
    n = pages.groupBy(F.col(key).alias("__key")).agg(F.count("*").cast("int").alias("n"))
    return pages.join(n, F.col(key) == F.col("__key")).withColumn("caption", F.format_string("%s - %d/%d", "title", F.col("sheet") + 1, "n")).drop("__key", "n")


def documents(placed: DataFrame, titles: DataFrame) -> DataFrame:
    """One PDF a video: (video_id, name, pages, content). ``titles`` holds (video_id, number, title)."""
    title = F.coalesce("title", F.format_string("Song %d", F.col("number") + 1))
    named = sheets(placed).join(titles, "video_id", "left").withColumn("number", F.coalesce("number", F.lit(0))).withColumn("title", title)
    named = named.withColumn("name", tx.numbered_name(F.col("number") + 1, tx.safe_file_name(F.col("title"), F.format_string("song_%d", F.col("number") + 1))))
    return _bound(_captioned(named, "video_id").withColumn("ordinal", F.col("sheet")), "video_id")


def song_documents(placed: DataFrame, songs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one PDF a song by song_id, one combined PDF by video_id of the videos with several songs, in their order)."""
    drawn = sheets(placed, "song_id").join(songs.select("song_id", "video_id", "index", "title"), "song_id")
    name = tx.numbered_name(F.col("index") + 1, tx.safe_file_name(F.col("title"), F.format_string("song_%d", F.col("index") + 1)))
    drawn = _captioned(drawn.withColumn("name", name), "song_id")
    single = _bound(drawn.withColumn("ordinal", F.col("sheet")), "song_id")
    several = songs.groupBy("video_id").agg(F.count("*").alias("songs")).filter("songs > 1")
    pages = seq.concat_ordered(drawn.join(several.select("video_id"), "video_id", "left_semi").withColumn("name", F.lit("combined.pdf")), ["video_id"], "index", ["sheet"])
    return single, _bound(pages, "video_id")


def write_documents(docs: DataFrame, folder: str) -> DataFrame:
    """Write (name, content) rows as files below a shared folder and return their paths. All files appear or none does
    (:mod:`strandloom.sources.document_sink`); names must be free (:func:`free_names`)."""
    docs = stored(docs, "documents")
    document_sink.write(docs, folder)
    return docs.select(F.concat(F.lit(f"{folder}/"), "name").alias("path"))


_NUMBERED = r"^(.*) \((\d+)\)(\.[^.]*)?$"


def free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """File names made unique: repeated or taken ones get (2), (3) and so on before the suffix, counting on until one is free.

    Wanted names are kept for the first who wants them, so a number never makes a name that another row asked for.
    """
    rank = seq.number(wanted.select("id", "name"), ["name"], ["id"], "rank")
    asked = wanted.select("name").distinct()
    used = taken.select("name").distinct()
    stem, suffix = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"(\.[^.]*)$", 1)
    parted = lambda df: df.withColumn("stem", stem).withColumn("suffix", suffix)
    reserved = used.unionByName(asked)
    plain = parted(reserved).select("stem", "suffix", F.lit(1).alias("number"))
    numbered = reserved.filter(F.col("name").rlike(_NUMBERED)).select(
        F.regexp_extract("name", _NUMBERED, 1).alias("stem"), F.regexp_extract("name", _NUMBERED, 3).alias("suffix"), F.regexp_extract("name", _NUMBERED, 2).try_cast("int").alias("number")
    )
    marked = rank.join(used.withColumn("is_taken", F.lit(True)), "name", "left")
    keeps = (F.col("rank") == 0) & F.col("is_taken").isNull()
    moved = seq.free_numbers(parted(marked.filter(~keeps)), plain.unionByName(numbered.filter("number > 0")), ["stem", "suffix"], ["id"])
    made = F.concat("stem", F.lit(" ("), F.col("k").cast("string"), F.lit(")"), "suffix")
    return marked.filter(keeps).select("id", "name").unionByName(moved.select("id", made.alias("name")))


def analysis_json(info: DataFrame) -> DataFrame:
    """(video_id, json) of analysed videos."""
    region = F.struct(F.col("region").alias("bbox"), "confidence", "instrument", "n_lines", "low_res_warning")
    songs = F.transform("songs", lambda s: F.struct(s["index"].alias("index"), s["start"].alias("start_frame"), s["end"].alias("end_frame")))
    whole = F.struct(region.alias("region"), F.col("mode").alias("advance_mode"), "frame_count", songs.alias("songs"), F.col("profile").alias("matched_profile"))
    return info.select("video_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


def report_json(report: DataFrame, songs: DataFrame, docs: DataFrame, combined: DataFrame, folder: str) -> DataFrame:
    """(video_id, json) of rendered videos: songs in order with their reports, and paths below ``folder``."""
    where = lambda name: F.concat(F.lit(f"{folder}/"), name)
    issues = F.transform("issues", lambda i: F.struct(i["at"].alias("system_index"), i["kind"].alias("kind"), i["before"].alias("from_measure"), i["after"].alias("to_measure")))
    told = F.struct("score", F.col("continuity").alias("measure_continuity"), issues.alias("measure_issues"), "low_confidence_systems", "overlap_ok", "cuts_on_ink", "discarded_ink_flag", "notes")
    rows = report.join(songs.select("song_id", "video_id", "index", "title"), "song_id").join(docs.select("song_id", "name", "pages"), "song_id")
    song = F.struct("index", "title", "pages", where(F.col("name")).alias("path"), told.alias("report"))
    listed = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("index", song.alias("song")))).alias("s"))
    listed = listed.join(combined.select("video_id", where(F.col("name")).alias("combined")), "video_id", "left")
    whole = F.struct(F.transform("s", lambda x: x["song"]).alias("songs"), F.col("combined").alias("combined_path"), F.lit(folder).alias("output_dir"))
    return listed.select("video_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


__all__ = [
    "analyse", "analysis_json", "documents", "free_names", "regions", "render", "render_songs", "report_json", "sheets", "song_documents", "songs_of", "write_documents",
]
