"""Scalar text, number and JSON functions of job and file handling, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VIDEO_SUFFIXES = ("mp4", "mkv", "webm", "mov", "avi")


def safe_file_name(title: Column, fallback: Column) -> Column:
    """Letters, digits, space, hyphen and underscore stay, all else becomes underscore; blanks and dots go at both ends."""
    clean = F.btrim(F.regexp_replace(title, r"[^\p{L}\p{N} _-]", "_"), F.lit(" ."))
    return F.when(F.length(clean) > 0, clean).otherwise(fallback)


def safe_folder_name(title: Column, fallback: str = "output") -> Column:
    """As a file name, but dots stay too, and 80 characters at most."""
    clean = F.substring(F.btrim(F.regexp_replace(title, r"[^\p{L}\p{N} ._-]", "_"), F.lit(" .")), 1, 80)
    return F.when(F.length(clean) > 0, clean).otherwise(F.lit(fallback))


def numbered_name(number: Column, title: Column) -> Column:
    return F.format_string("%02d - %s.pdf", number, title)


def normalise_url(url: Column) -> Column:
    """Without white space at both ends, with https:// where no scheme is given; null unless http or https with a host."""
    whole = F.regexp_replace(url, r"^\s+|\s+$", "")
    whole = F.when(F.contains(whole, F.lit("://")), whole).otherwise(F.concat(F.lit("https://"), whole))
    return F.when(whole.rlike(r"^(?i)https?://[^/?#]+"), whole)


def has_video_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*VIDEO_SUFFIXES)


def first_rule(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The kind of the first rule whose fragment occurs, whatever its case."""
    out = None
    for fragment, kind in rules:
        hit = F.contains(F.lower(text), F.lit(fragment))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(default)


def tail_lines(text: Column, n: int = 4, most: int = 400, unwanted: str | None = None) -> Column:
    """The last n non-blank lines joined by slashes and cut; unwanted lines go unless nothing else is there."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    if unwanted:
        wanted = F.filter(lines, lambda s: ~s.rlike(unwanted))
        lines = F.when(F.size(wanted) > 0, wanted).otherwise(lines)
    last = F.slice(lines, F.greatest(F.lit(1), F.size(lines) - n + 1), F.lit(n))
    return F.substring(F.array_join(last, " / "), 1, most)


def digits_to_int(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "").try_cast("int")


def checksum_of(listing: Column, name: Column) -> Column:
    """The hash before two spaces and a name in a checksum listing, in lower case; blanks around lines do not count. Null if absent."""
    parts = F.transform(F.split(listing, "\n"), lambda s: F.split(F.regexp_replace(s, r"^\s+|\s+$", ""), "  ", 2))
    line = F.get(F.filter(parts, lambda p: F.get(p, F.lit(1)) == name), F.lit(0))
    return F.lower(F.get(line, F.lit(0)))


def progress_fields(line: Column) -> Column:
    """(key, value) of a key=value line; blanks around it do not count."""
    parts = F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), "=", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("key"), F.get(parts, F.lit(1)).alias("value"))


def duration_text(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("int")
    return F.format_string("%d:%02d", (whole / 60).cast("int"), whole % 60)


def size_text(size: Column) -> Column:
    """Whole megabytes of a number of bytes; null or zero is unknown."""
    return F.when(size > 0, F.format_string("%.0f MB", size / 1e6)).otherwise("unknown size")


def display_time(seconds: Column, form: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Epoch seconds as text in the session's time zone."""
    return F.date_format(F.timestamp_seconds(seconds), form)


def epoch_seconds(time: Column) -> Column:
    """The inverse of :func:`display_time` for timestamps."""
    return F.unix_micros(time) / 1e6


def handshake(line: Column, prefix: str) -> Column:
    """(port, token) of a line that starts with the prefix and goes on with JSON of a number and a text; else null."""
    body = F.when(line.startswith(prefix), F.substring(line, F.lit(len(prefix) + 1), F.length(line)))
    port, token = F.get_json_object(body, "$.port"), F.from_json(body, "token string", {"mode": "PERMISSIVE"})["token"]
    number = F.from_json(body, "port double", {"mode": "PERMISSIVE"})["port"]
    whole = number.isNotNull() & token.isNotNull() & ~body.rlike(r'"port"\s*:\s*"') & body.rlike(r'"token"\s*:\s*"')
    return F.when(whole & port.isNotNull(), F.struct(number.cast("int").alias("port"), token.alias("token")))


def score_grade(score: Column) -> Column:
    return F.when(score >= 90, "good").when(score >= 60, "fair").otherwise("poor")


def mapped(value: Column, table: dict, default: Column) -> Column:
    """A literal lookup with a default."""
    out = None
    for key, label in table.items():
        out = F.when(value == key, label) if out is None else out.when(value == key, label)
    return out.otherwise(default)


#: Instruments by line count.
INSTRUMENTS = {4: "bass", 6: "guitar", 5: "staff"}
#: What a job's status is called.
STATUS_LABELS = {
    "new": "new", "ready": "ready to analyse", "downloading": "downloading", "queued": "queued", "analyzing": "analysing", "analyzed": "analysed",
    "queued_render": "queued", "rendering": "generating", "rendered": "finished", "cancelled": "cancelled", "failed": "failed",
}
#: Fragments of downloader messages and the kinds they stand for, in order.
ERROR_RULES = [
    ("private video", "private"), ("confirm your age", "age_restricted"), ("age-restricted", "age_restricted"), ("age restricted", "age_restricted"),
    ("video unavailable", "unavailable"), ("removed by the uploader", "unavailable"), ("does not exist", "unavailable"),
    ("sign in to confirm", "outdated"), ("nsig extraction", "outdated"), ("unable to extract", "outdated"), ("http error 403", "outdated"), ("player response", "outdated"),
]


def instrument(lines: Column) -> Column:
    return mapped(lines, INSTRUMENTS, F.format_string("%d lines", lines.cast("int")))


def number_or_zero(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def region_of(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A region with ordered, half-up rounded edges."""
    up = lambda c: F.floor(c + 0.5).cast("int")
    return F.struct(up(F.least(x0, x1)).alias("x0"), up(F.least(y0, y1)).alias("y0"), up(F.greatest(x0, x1)).alias("x1"), up(F.greatest(y0, y1)).alias("y1"))


#: Which edges of a region each handle moves.
HANDLES = {"nw": ("x0", "y0"), "ne": ("x1", "y0"), "sw": ("x0", "y1"), "se": ("x1", "y1"), "move": ("x0", "y0", "x1", "y1")}


def dragged(region: Column, handle: Column, dx: Column, dy: Column) -> Column:
    """A region whose handle moved by (dx, dy), with ordered, rounded edges; an unknown handle moves nothing."""
    edge = lambda e: region[e] + F.when(handle.isin(*(h for h, moved in HANDLES.items() if e in moved)), dx if e[0] == "x" else dy).otherwise(0)
    return region_of(*(edge(e) for e in ("x0", "y0", "x1", "y1")))


def handle_at(region: Column, x: Column, y: Column, reach: float) -> Column:
    """The handle under a point: a corner closer than ``reach`` in both directions, else the inside, else null."""
    near = lambda ex, ey: (F.abs(x - region[ex]) < reach) & (F.abs(y - region[ey]) < reach)
    inside = (x > region["x0"]) & (x < region["x1"]) & (y > region["y0"]) & (y < region["y1"])
    out = None
    for corner in ("nw", "ne", "sw", "se"):
        out = F.when(near(*HANDLES[corner]), corner) if out is None else out.when(near(*HANDLES[corner]), corner)
    return out.when(inside, "move")
