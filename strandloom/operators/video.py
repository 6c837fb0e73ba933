"""Frame operators: pixel kernels as Arrow functions around DataFrame plans, partitioned by video, song or band.

The frames of a video are numbered from 0 without gaps. Plans choose frames by number and join tables of one row a video
(:func:`strandloom.stored.with_rows_of`); no window, sort or shuffle holds whole images.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import pixels as px
from strandloom.functions.counts import PIXELS, Totals, counted
from strandloom.operators import seq
from strandloom.stored import ready, stored, with_rows_of

BAND, LEAST = 200, 3
#: Grey bytes that a task gathers before it counts and ships them.
HELD = 32_000_000
LOW_WIDTH = 800
EDGES = ("x0", "y0", "x1", "y1")
#: One box for all videos, a table (video_id, x0, y0, x1, y1), or none where frames have the edges as columns.
Region = tuple[int, int, int, int] | DataFrame | None


def array_of(height: int, width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, -1)


def on_region(frames: DataFrame, region: Region) -> DataFrame:
    """Frames with the edges of their video's region; one row a video is joined, no frame is collected."""
    if region is None:
        return frames
    if isinstance(region, DataFrame):
        return with_rows_of(frames, region.select("video_id", *EDGES))
    return frames.select("*", *(F.lit(int(v)).alias(e) for v, e in zip(region, EDGES, strict=True)))


def frame_counts(frames: DataFrame) -> DataFrame:
    """(video_id, n), from the numbers of the frames where their source can tell them without images."""
    return getattr(frames, "numbers", frames).groupBy("video_id").agg(F.count("*").alias("n"))


def _cut(row) -> np.ndarray:
    return array_of(row.height, row.width, row.data)[row.y0 : row.y1, row.x0 : row.x1]


def _grey(row) -> np.ndarray:
    return np.frombuffer(row.grey, np.uint8).reshape(row.y1 - row.y0, row.x1 - row.x0)


def _per_frame(frames: DataFrame, schema: str, use) -> DataFrame:
    """Rows of ``use(row)`` for each frame; frames stream through in batches."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([r for row in pdf.itertuples(index=False) for r in use(row)], columns=columns)

    ready(frames.sparkSession)
    return frames.mapInPandas(run, schema)


def crops(frames: DataFrame, region: Region, keep: tuple[str, ...] = ()) -> DataFrame:
    """(video_id, frame_idx, edges, grey) of the region of each frame, with the columns ``keep``: what later shuffles move."""
    on = on_region(frames, region).select("video_id", "frame_idx", *EDGES, "height", "width", "data", *keep)
    kinds = dict(on.dtypes)
    schema = f"video_id {kinds['video_id']}, frame_idx int, x0 int, y0 int, x1 int, y1 int, grey binary" + "".join(f", {c} {kinds[c]}" for c in keep)
    return _per_frame(on, schema, lambda row: [(row.video_id, row.frame_idx, row.x0, row.y0, row.x1, row.y1, px.grey(_cut(row)).tobytes(), *(getattr(row, c) for c in keep))])


def region_candidates(frames: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Region and line count of up to 40 evenly spaced frames of each video; frames without one are null.

    ``counts`` (video_id, n), here and below, saves a scan where the frames of a video are counted already.
    """
    chosen = with_rows_of(frames, frame_counts(frames) if counts is None else counts).filter(seq.is_sample(F.col("frame_idx"), F.col("n"), 40))

    def one(row):
        found = px.region_candidate(array_of(row.height, row.width, row.data))
        box, lines = found if found else ((None,) * 4, None)
        return [(row.video_id, row.frame_idx, max(row.height, row.width), *box, lines)]

    return _per_frame(chosen, "video_id string, frame_idx int, side int, x0 double, y0 double, x1 double, y1 double, lines double", one)


def detect_region(frames: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row a video: edge medians, confidence (agreement over all samples), modal line count, low resolution (of the region).

    Candidates are found once and stored. A video without any raises.
    """
    every = stored(region_candidates(frames, counts), "candidates")
    box = seq.median_box(every, ["video_id"], EDGES).select("video_id", *(F.col(e).cast("int").alias(e) for e in EDGES))
    first = every.groupBy("video_id").agg(F.min_by("side", "frame_idx").alias("frame_side"))
    agree = seq.agreement(every.join(first, "video_id"), ["video_id"], EDGES, "frame_side").select("video_id", "confidence")
    lines = seq.modal_value(every.filter("x0 IS NOT NULL"), ["video_id"], ["frame_idx"], "lines").select("video_id", F.col("lines").cast("int").alias("n_lines"))
    out = box.join(agree, "video_id").join(lines, "video_id", "left")
    none = F.raise_error(F.concat(F.lit("no region in "), "video_id")).cast("int")
    x0 = F.when(F.col("x0").isNull(), none).otherwise(F.col("x0"))
    return out.select("video_id", x0.alias("x0"), "y0", "x1", "y1", "confidence", "n_lines", (F.col("x1") - F.col("x0") < LOW_WIDTH).alias("low_res_warning"))


def displacements(frames: DataFrame, region: Region, pairs: int = 200, counts: DataFrame | None = None) -> DataFrame:
    """(dx, dy) between evenly sampled neighbouring frames of each video; ``width`` and ``height`` are the region's.

    Pairs are chosen from frame numbers, so that only grey crops of chosen frames are shuffled.
    """
    at, last = F.col("frame_idx"), F.col("n") - 1
    chosen = lambda pos: seq.is_sample(pos, last, pairs)
    members = F.filter(F.array(F.when(chosen(at), at), F.when(chosen(at - 1), at - 1)), lambda p: p.isNotNull())
    wanted = with_rows_of(frames, frame_counts(frames) if counts is None else counts).withColumn("members", members).filter(F.size("members") > 0)
    both = crops(wanted, region, ("members",)).select("video_id", "frame_idx", *EDGES, "grey", F.explode("members").alias("pair"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = pdf.sort_values("frame_idx").itertuples(index=False)
        shift = px.phase_shift(_grey(first), _grey(second))
        told = (first.video_id, first.pair, *(round(v, 3) for v in shift), first.x1 - first.x0, first.y1 - first.y0)
        return pd.DataFrame([told], columns=["video_id", "frame_idx", "dx", "dy", "width", "height"])

    return both.groupBy("video_id", "pair").applyInPandas(one, "video_id string, frame_idx int, dx double, dy double, width int, height int")


def classify_advance(frames: DataFrame, region: Region, counts: DataFrame | None = None) -> DataFrame:
    """Kind of motion of each video; one of under two frames raises."""
    counts = stored(frame_counts(frames) if counts is None else counts, "frame-counts")
    moved = stored(displacements(frames, region, counts=counts), "displacements")
    told = seq.advance_mode(moved, ["video_id"], "dx", "dy", "width", "height")
    short = F.raise_error(F.concat(F.lit("at least two frames are needed to tell the motion of "), "video_id")).cast("string")
    whole = counts.join(told, "video_id", "left")
    return whole.withColumn("mode", F.when(F.col("n") < 2, short).otherwise(F.col("mode"))).drop("n")


def cursor_track(frames: DataFrame, region: Region) -> DataFrame:
    """(video_id, frame_idx, x, strength, width of the region) of the frames with a cursor."""

    def one(row):
        found = px.cursor_column(_cut(row))
        return [(row.video_id, row.frame_idx, *found, row.x1 - row.x0)] if found else []

    return _per_frame(on_region(frames, region).select("video_id", "frame_idx", "height", "width", "data", *EDGES), "video_id string, frame_idx int, x int, strength int, width int", one)


def signatures(frames: DataFrame, region: Region) -> DataFrame:
    """Signature of what lies outside the region."""
    one = lambda row: [(row.video_id, row.frame_idx, px.signature(array_of(row.height, row.width, row.data), (row.x0, row.y0, row.x1, row.y1)))]
    return _per_frame(on_region(frames, region), "video_id string, frame_idx int, sig array<float>", one)


def page_starts(track: DataFrame, width: int | None = None) -> DataFrame:
    """Page boundaries of a cursor track; the width is the track's own if none is given."""
    drop = 0.3 * (F.col("width") if width is None else F.lit(width))
    return seq.page_wraps(track, ["video_id"], ["frame_idx"], "x", drop).select("video_id", "frame_idx")


def page_table(frames: DataFrame, starts: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(video_id, n, starts, doubled): one row a video; without any start its frames are one page."""
    listed = starts.groupBy("video_id").agg(F.array_sort(F.collect_list("frame_idx")).alias("starts"))
    return (frame_counts(frames) if counts is None else counts).join(listed, "video_id", "left").withColumn("starts", F.coalesce("starts", F.array(F.lit(0)))).withColumn(
        "doubled", F.transform("starts", lambda s: 2 * s)
    )


def page_frames(frames: DataFrame, starts: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Frames with their page, its first frame and size, and whether they contribute; frames before the first start belong to none.

    The page follows from the frame's number and the starts of its video, so frames stay where they are read.
    """
    paged = with_rows_of(frames, page_table(frames, starts, counts))
    # how many starts are not after the frame: its place among the doubled starts. (A lambda that reads a column of the other side
    # of a join is pushed to the wrong side with the filter.)
    own = 2 * F.col("frame_idx") + 1
    place = F.array_position(F.sort_array(F.concat("doubled", F.array(own))), own).cast("int")
    paged = paged.withColumn("page", place - 2).filter("page >= 0")
    paged = paged.withColumn("first", F.get("starts", F.col("page")))
    paged = paged.withColumn("size", (F.coalesce(F.get("starts", F.col("page") + 1), F.col("n")) - F.col("first")).cast("int"))
    interior = (F.col("frame_idx") > F.col("first")) & (F.col("frame_idx") < F.col("first") + F.col("size") - 1)
    return paged.withColumn("contributes", F.when(seq.few_inside(F.col("size"), LEAST), F.lit(True)).otherwise(interior)).drop("starts", "doubled", "n")


def _blended(frames: DataFrame, keys: str, pieces) -> DataFrame:
    """(keys, chunk, across, n_all, n_inside, rows): images that ``pieces(row)`` yields as (key, width, inside, flat bytes) blended by
    key: the median of the inside ones, or of under ``LEAST`` of them the brightest of all.

    Tasks count the levels of their images and ship the counts, ``PIXELS`` pixels a row; counts are added up as they come. What
    is held is bounded by pixels, not by images (:mod:`strandloom.functions.counts`).
    """
    names = [c.split()[0] for c in keys.split(", ")]
    partial = [*names, "chunk", "across", "n_all", "n_inside", "levels", "counts", "top"]

    def shipped(held: dict) -> pd.DataFrame:
        rows = []
        for key, (across, inside, others) in held.items():
            every = np.stack(inside + others)
            for c, at in enumerate(range(0, every.shape[1], PIXELS)):
                part = every[:, at : at + PIXELS]
                levels, counts = counted(part[: len(inside)]) if inside else (np.zeros(0, np.int32),) * 2
                rows.append((*key, c, across, len(every), len(inside), levels.tobytes(), counts.tobytes(), part.max(axis=0).tobytes()))
        return pd.DataFrame(rows, columns=partial)

    def run(batches):
        held, size = {}, 0
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                for key, across, inside, flat in pieces(row):
                    held.setdefault(key, (across, [], []))[1 if inside else 2].append(flat)
                    size += flat.size
                if size >= HELD:
                    yield shipped(held)
                    held, size = {}, 0
        if held:
            yield shipped(held)

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, n_all, n_inside = None, 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in partial[-6:]), strict=True):
                across, most = row[0], np.frombuffer(row[5], np.uint8)
                totals, top = (totals, np.maximum(top, most)) if top is not None else (Totals(len(most)), most)
                totals.add(np.frombuffer(row[3], np.int32), np.frombuffer(row[4], np.int32))
                n_all, n_inside = n_all + row[1], n_inside + row[2]
        rows = totals.median(n_inside) if n_inside >= LEAST else top
        told = [k.as_py() for k in key] + [across, n_all, n_inside, rows.tobytes()]
        yield pa.RecordBatch.from_pylist([dict(zip(out, told, strict=True))], schema)

    out = [*names, "chunk", "across", "n_all", "n_inside", "rows"]
    kinds = {"string": pa.string(), "int": pa.int32()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in keys.split(", ")] + [(c, pa.int32()) for c in out[len(names) : -1]] + [("rows", pa.binary())])
    ready(frames.sparkSession)
    counts = frames.mapInPandas(run, f"{keys}, chunk int, across int, n_all int, n_inside int, levels binary, counts binary, top binary")
    return counts.groupBy(*names, "chunk").applyInArrow(add, f"{keys}, chunk int, across int, n_all int, n_inside int, rows binary")


def _whole(chunks: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """Chunks of blended pixels put together by key."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "rows"))), lambda c: c["rows"])
    whole = F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b))
    return chunks.groupBy(*keys).agg(F.max("n_all").alias("n_all"), F.max("n_inside").alias("n_inside"), F.max("across").alias("width"), whole.alias(name))


def compose_pages(paged: DataFrame, region: Region) -> DataFrame:
    """Canvases of pages, with their first and last frame, and whether they are transitions (little paper) or of few frames.

    A page's canvas is the median of its frames but the first and last; where these are under three, the brightest of all.
    """

    def pieces(row):
        g = px.grey(_cut(row))
        yield (row.video_id, row.page, row.first, row.size), g.shape[1], not row.few, g.ravel()

    used = paged.filter("contributes").withColumn("few", seq.few_inside(F.col("size"), LEAST))
    on = on_region(used, region).select("video_id", "page", "first", "size", "few", "height", "width", "data", *EDGES)
    keys = ("video_id", "page", "first", "size")
    pages = _whole(_blended(on, "video_id string, page int, first int, size int", pieces), keys, "canvas")

    def told(row):
        share = float((np.frombuffer(row.canvas, np.uint8) > px.PAPER_GREY).mean())
        few = row.n_inside < LEAST
        return [(row.video_id, row.page, row.n_all, row.canvas, len(row.canvas) // row.width, row.width, share < 0.5, few, row.first, row.first + row.size - 1)]

    schema = "video_id string, page int, contributors int, canvas binary, height int, width int, transition boolean, low_confidence boolean, start int, end int"
    return _per_frame(pages, schema, told)


def scroll_offsets(frames: DataFrame, region: Region, horizontal: bool = False) -> DataFrame:
    """Cumulative offset of each frame of a scroll, and how each step was found.

    The strip match runs on every pair; the costlier phase correlation only where it is unsure.
    """
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    paired = crops(frames, region).withColumn("before", F.lag("grey").over(w))

    def one(row):
        length = row.x1 - row.x0 if horizontal else row.y1 - row.y0
        if row.before is None:
            return [(row.video_id, row.frame_idx, 0.0, 1.0, 0.0, length)]
        b = _grey(row)
        a = np.frombuffer(row.before, np.uint8).reshape(b.shape)
        if horizontal:
            a, b = a.T, b.T
        d, score = px.strip_match(a, b)
        shift = 0.0 if score >= 0.6 else float(np.rint(-px.phase_shift(a, b)[1]))
        return [(row.video_id, row.frame_idx, float(d), score, shift, length)]

    steps = _per_frame(paired, "video_id string, frame_idx int, d double, score double, shift double, length int", one)
    return seq.running_offsets(steps, ["video_id"], ["frame_idx"], F.col("d"), F.col("score") >= 0.6, F.col("shift"), F.col("length")).select(
        "video_id", "frame_idx", F.col("offset").cast("int").alias("offset"), "resolution", "length"
    )


def compose_scroll(frames: DataFrame, offsets: DataFrame, region: Region, horizontal: bool = False) -> DataFrame:
    """Bands (video_id, band, rows, contributors, low_confidence) of the canvas of a scroll, BAND rows each.

    Interval cover by band numbers: each frame is cut to the bands it touches, white where it does not reach. The median of
    frames that contain a band counts; where they are too few, the brightest of all that touch it.
    """
    listed = offsets.groupBy("video_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "offset"))), lambda x: x["offset"]).alias("offsets"), F.max(F.col("offset") + F.col("length")).alias("total")
    )
    placed = with_rows_of(frames, listed).withColumn("offset", F.get("offsets", F.col("frame_idx")))

    def pieces(row):
        g = px.grey(_cut(row))
        g = g.T if horizontal else g
        length = g.shape[0]
        for band in range(row.offset // BAND, (row.offset + length - 1) // BAND + 1):
            y0, y1 = band * BAND, min((band + 1) * BAND, row.total)
            a, b = max(y0, row.offset), min(y1, row.offset + length)
            piece = np.full((y1 - y0, g.shape[1]), 255, np.uint8)
            piece[a - y0 : b - y0] = g[a - row.offset : b - row.offset]
            yield (row.video_id, band), g.shape[1], a == y0 and b == y1, piece.ravel()

    on = on_region(placed, region).select("video_id", "offset", "total", "height", "width", "data", *EDGES)
    bands = _whole(_blended(on, "video_id string, band int", pieces), ("video_id", "band"), "rows")
    few = F.col("n_inside") < LEAST
    return bands.select("video_id", "band", F.when(few, F.col("n_all")).otherwise(F.col("n_inside")).alias("contributors"), few.alias("low_confidence"), "width", "rows")


def page_systems(pages: DataFrame) -> DataFrame:
    """Pages without transitions as systems, each but the last cut at its last barline."""
    real = pages.filter(~F.col("transition"))
    marked = real.withColumn("last", F.col("page") == F.max("page").over(Window.partitionBy("video_id")))

    def one(row):
        canvas, guarded = px.trim(np.frombuffer(row.canvas, np.uint8).reshape(row.height, row.width), bool(row.last))
        return [(row.video_id, row.page, canvas.shape[0], canvas.shape[1], np.ascontiguousarray(canvas).tobytes(), bool(guarded or row.low_confidence))]

    return _per_frame(marked, "video_id string, pos int, height int, width int, canvas binary, low_confidence boolean", one)


def scroll_systems(bands: DataFrame, carry_confidence: bool = False) -> DataFrame:
    """System blocks of scroll canvases. ``carry_confidence`` marks blocks that touch a band of few frames.

    No task holds a canvas: each band tells its rows' ink; cuts are found from these counts of a
    video, after the wide gaps are looked at for bridges band by band; then bands are cut to blocks.
    """
    inked = lambda row: np.frombuffer(row.rows, np.uint8).reshape(-1, row.width) < px.GAP_INK
    counts = _per_frame(bands, "video_id string, band int, width int, ink array<int>", lambda row: [(row.video_id, row.band, row.width, inked(row).sum(axis=1).tolist())])
    rows = counts.groupBy("video_id").agg(F.max("width").alias("width"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("band", "ink"))), lambda b: b["ink"])).alias("ink"))

    def wide(row):
        return [(row.video_id, a, b) for a, b in px.wide_gaps(np.asarray(row.ink), row.width)]

    gaps = _per_frame(rows, "video_id string, a int, b int", wide)
    touched = gaps.withColumn("band", F.explode(F.sequence(F.expr(f"a div {BAND}"), F.expr(f"(b - 1) div {BAND}"))))

    def crossing(row):
        at = row.band * BAND
        return [(row.video_id, row.a, row.b, inked(row)[max(0, row.a - at) : row.b - at].sum(axis=0).tolist())]

    parts = _per_frame(touched.join(bands.select("video_id", "band", "width", "rows"), ["video_id", "band"]), "video_id string, a int, b int, columns array<int>", crossing)
    column = parts.select("video_id", "a", "b", F.posexplode("columns").alias("x", "c")).groupBy("video_id", "a", "b", "x").agg(F.sum("c").alias("c"))
    bridges = column.groupBy("video_id", "a", "b").agg(F.sum((F.col("c") * 10 >= (F.col("b") - F.col("a")) * 9).cast("int")).alias("columns"))
    clear = bridges.filter("columns < 2").groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("gaps"))

    def cut(row):
        ink = np.asarray(row.ink)
        kept, cuts = px.blocks_between(ink, [(g["a"], g["b"]) for g in (row.gaps if row.gaps is not None else [])])
        on_ink = sum(int(ink[c] > 0.01 * row.width) for c in cuts)
        lost = max(0, int(ink.sum()) - sum(int(ink[a:b].sum()) for a, b in kept))
        return [(row.video_id, i, a, b, on_ink, lost) for i, (a, b) in enumerate(kept)]

    blocks = _per_frame(rows.join(clear, "video_id", "left"), "video_id string, pos int, a int, b int, cuts_on_ink int, discarded_ink long", cut)
    pieces = blocks.withColumn("band", F.explode(F.sequence(F.expr(f"a div {BAND}"), F.expr(f"(b - 1) div {BAND}")))).join(bands, ["video_id", "band"])
    at = F.col("band") * BAND
    first, end = F.greatest(F.lit(0), F.col("a") - at), F.least(F.lit(BAND), F.col("b") - at)
    piece = F.substring("rows", first * F.col("width") + 1, (end - first) * F.col("width"))
    sliced = pieces.select("video_id", "pos", "a", "b", "width", "cuts_on_ink", "discarded_ink", "low_confidence", F.struct("band", piece.alias("rows")).alias("piece"))
    canvas = F.aggregate(F.array_sort(F.collect_list("piece")), F.lit(b""), lambda whole, p: F.concat(whole, p["rows"]))
    weak = F.max("low_confidence") if carry_confidence else F.lit(False)
    whole = sliced.groupBy("video_id", "pos", "a", "b", "width", "cuts_on_ink", "discarded_ink").agg(canvas.alias("canvas"), weak.alias("low_confidence"))
    return whole.select("video_id", "pos", (F.col("b") - F.col("a")).alias("height"), "width", "canvas", "low_confidence", "cuts_on_ink", "discarded_ink")


def offset_check(offsets: DataFrame, window: int | None = None) -> DataFrame:
    """Largest step and unresolved pairs; ok is null for under two offsets. The window is the offsets' own length if none is given."""
    width = F.col("length") if window is None else F.lit(window)
    return seq.step_check(offsets, ["video_id"], ["frame_idx"], "offset", F.col("resolution") == "unresolved", width)


def layout(systems: DataFrame, width: int = 2240, capacity: int = 3158, gap: int = 30) -> DataFrame:
    """Systems scaled by their song's common factor and packed: adds sheet and y; ``canvas`` is the scaled image."""
    common = seq.common_scale(systems, ["video_id"], "width", width)

    def one(row):
        image = px.scaled(np.frombuffer(row.canvas, np.uint8).reshape(row.height, row.width), row.factor)
        return [(row.video_id, row.pos, *image.shape, image.tobytes(), row.low_confidence)]

    made = _per_frame(common, "video_id string, pos int, height int, width int, canvas binary, low_confidence boolean", one)
    placed = seq.pack(made.select("video_id", "pos", "height"), ["video_id"], ["pos"], "height", capacity, gap).select("video_id", "pos", "sheet", "y")
    return made.join(placed, ["video_id", "pos"])


def number_readings(systems: DataFrame, reader=None) -> DataFrame:
    """(video_id, pos, number) read left of each system by ``reader(image) -> int | None``; null without one."""
    if reader is None:
        return systems.select("video_id", "pos", F.lit(None).cast("int").alias("number"))

    def one(row):
        strip = px.number_strip(np.frombuffer(row.canvas, np.uint8).reshape(row.height, row.width))
        box = px.first_number_box(strip) if strip is not None else None
        number = reader(strip[box[1] : box[3], box[0] : box[2]]) if box else None
        return [(row.video_id, row.pos, number)]

    return _per_frame(systems, "video_id string, pos int, number double", one).withColumn("number", F.col("number").cast("int"))


def clamp_frame(frames: DataFrame, index: int) -> DataFrame:
    """The frame of an index forced into range."""
    return with_rows_of(frames, frame_counts(frames)).filter(F.col("frame_idx") == seq.clamp_index(F.lit(index), F.col("n"))).drop("n")


def frame_seconds(index: Column, rate: float = 2.0) -> Column:
    return index / F.lit(rate)
