"""Audio columns: lossless 8-bit storage, polyphase resampling, log-mel features, energy segments.

A payload becomes a mono 8-bit WAV file. Features come from the bytes of that file alone: the
samples are resampled by a rational factor, cut into overlapping windows, turned into log-mel
bands, packed into tensors of a fixed shape with their time spans, and segmented by energy with
hysteresis. Every document is computed by itself, so equal payloads have equal features.

Files and tensors are stored as a Parquet table of one row a document, from which the query reads both.

Defined results: a null or empty text is a payload of padding only; very long texts are computed
window block by window block; repeated rows are computed alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strandloom.llm.common import blocks, documents, materialise, utf8_view

UNIT, PAD = 192, 32
RATE, UP, DOWN = 16_000, 2, 5
#: Rate of the features, and samples of a window and between windows at that rate.
OUT_RATE = RATE * UP // DOWN
WINDOW, HOP, FFT, BANDS = 160, 64, 256, 24
#: Windows of one tensor.
SPAN = 64
TAPS = 16
#: Frame energy in dB over the file's median that opens a segment, and that keeps it open.
OPEN_DB, KEEP_DB = 1.0, -1.0
BLOCK = 8192
#: Bytes of texts or files that are held together.
TOGETHER = 4_000_000


def padded(data: bytes) -> bytes:
    """The payload: bytes 32 up to a positive multiple of the unit."""
    return data + bytes([PAD]) * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def store(payload: bytes, rate: int = RATE) -> bytes:
    """A mono 8-bit PCM file in RIFF form."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    body = b"WAVE" + fmt + struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def read_back(media: bytes) -> tuple[int, memoryview]:
    """Rate and sample bytes of a stored file."""
    view = memoryview(media)
    if view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(view):
        kind, size = struct.unpack_from("<4sI", view, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", view, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is stored here")
        if kind == b"data":
            return rate, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no sample data")


@lru_cache(maxsize=1)
def _phases() -> np.ndarray:
    """Low-pass taps of each phase (Hann-windowed sinc), scaled to unit gain."""
    n = TAPS * UP
    t = (np.arange(n) - (n - 1) / 2) / max(UP, DOWN)
    taps = np.sinc(t) * (0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(n) + 0.5) / n))
    taps = taps.reshape(TAPS, UP).T[:, ::-1]
    return np.ascontiguousarray(taps / taps.sum(axis=1, keepdims=True), np.float32)


def resample(samples: np.ndarray) -> np.ndarray:
    """Rational resampling: every output is one phase's taps on its own stretch of input."""
    groups = -(-len(samples) // DOWN)
    x = np.zeros(groups * DOWN + TAPS + DOWN, np.float32)
    x[TAPS // 2 : TAPS // 2 + len(samples)] = samples
    out = np.empty((groups, UP), np.float32)
    for k in range(UP):
        first = k * DOWN // UP
        windows = np.lib.stride_tricks.as_strided(x[first:], (groups, TAPS), (x.strides[0] * DOWN, x.strides[0]))
        out[:, k] = windows @ _phases()[k * DOWN % UP]
    return out.reshape(-1)[: -(-len(samples) * UP // DOWN)]


@lru_cache(maxsize=1)
def _bank() -> np.ndarray:
    """Triangular mel filters over the FFT bins."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(OUT_RATE / 2), BANDS + 2) / 2595) - 1)
    bins = np.arange(FFT // 2 + 1) * OUT_RATE / FFT
    rise = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(rise, fall), 0, None).astype(np.float32)


def log_mel(samples: np.ndarray) -> np.ndarray:
    """Frames x bands, in dB."""
    frames = max(1, -(-(len(samples) - WINDOW) // HOP) + 1)
    x = np.zeros((frames - 1) * HOP + WINDOW, np.float32)
    x[: min(len(samples), len(x))] = samples[: len(x)]
    windows = np.lib.stride_tricks.as_strided(x, (frames, WINDOW), (x.strides[0] * HOP, x.strides[0]))
    shape = np.hanning(WINDOW).astype(np.float32)
    out = np.empty((frames, BANDS), np.float32)
    for start in range(0, frames, BLOCK):
        spectrum = np.fft.rfft(windows[start : start + BLOCK] * shape, FFT, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out[start : start + BLOCK] = 10 * np.log10(power @ _bank() + 1e-6)
    return out


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Half-open runs of frames that stay over the lower threshold and reach the upper one."""
    middle = np.median(energy)
    keep, loud = energy >= middle + KEEP_DB, energy >= middle + OPEN_DB
    edges = np.flatnonzero(np.diff(np.concatenate(([0], keep.view(np.int8), [0]))))
    loud_before = np.concatenate(([0], np.cumsum(loud)))
    return [(a, b) for a, b in edges.reshape(-1, 2).tolist() if loud_before[b] > loud_before[a]]


def analyse(media: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Quarter-dB log-mel frames (int16) and segments of a stored file."""
    _, data = read_back(media)
    mel = log_mel(resample((np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128))
    rounded = np.rint(mel * 4).astype(np.int16)
    return rounded, segments(rounded.mean(axis=1) / 4)


TENSOR = pa.fixed_shape_tensor(pa.int16(), (SPAN, BANDS))


def tensor_rows(media: list[bytes | None], keys: pa.Array) -> tuple[pa.RecordBatch, list[list[tuple[int, int]]]]:
    """The features of stored files as rows of one fixed-shape tensor each, with time spans, and each file's segments.

    Columns: row (which file), doc_id, part, start_s, end_s, frames, tensor. The last tensor of a file is padded with
    zeros; a null file has no rows.
    """
    tables, runs, files, parts, counts = [], [], [], [], []
    for k, stored in enumerate(media):
        mel, found = (np.zeros((0, BANDS), np.int16), []) if stored is None else analyse(stored)
        n = -(-len(mel) // SPAN)
        full = np.zeros((n * SPAN, BANDS), np.int16)
        full[: len(mel)] = mel
        tables.append(full)
        runs.append(found)
        files.append(np.full(n, k, np.int32))
        parts.append(np.arange(n, dtype=np.int32))
        counts.append(np.minimum(len(mel) - np.arange(n) * SPAN, SPAN).astype(np.int32))
    file, part, frames = (np.concatenate([*x, np.zeros(0, np.int32)]) for x in (files, parts, counts))
    start = part.astype(np.int64) * SPAN * HOP
    flat = pa.array(np.concatenate([*tables, np.zeros((0, BANDS), np.int16)]).reshape(-1))
    tensor = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(flat, SPAN * BANDS))
    columns = [
        pa.array(file), keys.take(pa.array(file)), pa.array(part), pa.array(start / OUT_RATE), pa.array((start + (frames - 1) * HOP + WINDOW) / OUT_RATE), pa.array(frames), tensor,
    ]
    return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "part", "start_s", "end_s", "frames", "tensor"]), runs


def feature_texts(rows: pa.RecordBatch, runs: list[list[tuple[int, int]]]) -> list[str]:
    """Of each file: its number of frames, a digest of what its tensors hold, its time span, and its segments; read from the rows."""
    values = rows.column("tensor").to_numpy_ndarray() if len(rows) else np.zeros((0, SPAN, BANDS), np.int16)
    frames, ends = rows.column("frames").to_numpy(), rows.column("end_s").to_numpy()
    at = np.searchsorted(rows.column("row").to_numpy(), np.arange(len(runs) + 1)).tolist()
    out = []
    for a, b, found in zip(at, at[1:], runs, strict=False):
        n = int(frames[a:b].sum())
        digest = hashlib.sha256(np.ascontiguousarray(values[a:b]).reshape(-1, BANDS)[:n].tobytes()).hexdigest()[:32]
        out.append(f"mel={n}x{BANDS}:{digest};tensors={b - a}x{SPAN}x{BANDS};end={ends[b - 1] if b > a else 0:.4f};segments={len(found)}:{sum(y - x for x, y in found)}")
    return out


def _payloads(column: pa.Array):
    data, offsets = utf8_view(column)
    raw, bounds = data.tobytes(), offsets.tolist()
    for a, b in zip(bounds, bounds[1:], strict=False):
        yield b - a, padded(raw[a:b])


def to_audio(docs: DataFrame) -> DataFrame:
    """doc_id and the stored file of each whole text."""

    def run(batches):
        for batch in batches:
            media = pa.array([store(p) for _, p in _payloads(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "media": media})

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType.fromDDL("doc_id bigint, media binary"))


def tensors(media: DataFrame) -> DataFrame:
    """Rows of SPAN x BANDS quarter-dB values (the last padded with zeros) with their time spans in seconds.

    ``tensor`` always holds SPAN * BANDS values in row order: :func:`fixed_shape` makes it Arrow's tensor type again.
    """
    schema = T.StructType.fromDDL("doc_id bigint, part int, start_s double, end_s double, frames int, tensor array<smallint>")

    def run(batches):
        for batch in batches:
            sizes = [len(m or b"") for m in batch.column("media").to_pylist()]
            for a, b in blocks(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), TOGETHER):
                part = batch.slice(a, b - a)
                rows, _ = tensor_rows(part.column("media").to_pylist(), part.column("doc_id"))
                flat = rows.column("tensor").storage.cast(pa.list_(pa.int16()))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in schema.names[:-1]), flat], schema.names)

    return media.select("doc_id", "media").mapInArrow(run, schema)


def fixed_shape(column: pa.Array) -> pa.Array:
    """The tensor column as Arrow's fixed-shape tensor type; values are copied, as the type's view ignores where a slice begins."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(column.flatten().to_numpy().copy()), SPAN * BANDS)
    return pa.ExtensionArray.from_storage(TENSOR, flat)


_STORED = (
    "doc_id bigint, n_bytes bigint, media binary, tensor array<smallint>, frames array<int>, start_s array<double>, end_s array<double>, segments array<array<int>>"
)


def media_table(docs: DataFrame) -> DataFrame:
    """A row a document: the audio file of its whole text, and the file's features as tensors of SPAN x BANDS quarter-dB values,
    one after the other, with the frames and the time span of each; segments are runs of frames.

    Files and tensors are made block by block; this is the table that a corpus keeps.
    """
    names = [c.split()[0] for c in _STORED.split(", ")]
    lists = lambda values, bounds, kind: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))

    def run(batches):
        for batch in batches:
            for a, b in blocks(utf8_view(batch.column("text"))[1], TOGETHER):
                part = batch.slice(a, b - a)
                sizes, payloads = zip(*_payloads(part.column("text")), strict=True)
                media = [store(p) for p in payloads]
                rows, runs = tensor_rows(media, part.column("doc_id"))
                at = np.searchsorted(rows.column("row").to_numpy(), np.arange(len(media) + 1))
                flat = rows.column("tensor").storage.flatten()
                spans = (lists(rows.column(c), at, k) for c, k in (("frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())))
                tensor = pa.ListArray.from_arrays(pa.array((at * SPAN * BANDS).astype(np.int32)), flat)
                found = pa.array([[list(run) for run in r] for r in runs], pa.list_(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), tensor, *spans, found], names)

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType.fromDDL(_STORED))


def describe(stored: DataFrame) -> DataFrame:
    """Digests of payload and file of each row of a stored :func:`media_table`, read back, and of the features that its tensors hold."""

    def run(batches):
        for batch in batches:
            sizes = [len(m) for m in batch.column("media").to_pylist()]
            for a, b in blocks(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), TOGETHER):
                yield described(batch.slice(a, b - a))

    def described(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for n, media in zip(batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist(), strict=True):
            _, back = read_back(media)
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest()))
        file = np.repeat(np.arange(len(batch), dtype=np.int32), [len(f) for f in batch.column("frames").to_pylist()])
        parts = [pa.array(file), *(batch.column(c).flatten() for c in ("frames", "end_s")), fixed_shape(batch.column("tensor"))]
        runs = [[tuple(run) for run in r] for r in batch.column("segments").to_pylist()]
        columns = [*zip(*rows, strict=True), feature_texts(pa.RecordBatch.from_arrays(parts, ["row", "frames", "end_s", "tensor"]), runs)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(_ARROW)[1:], strict=True))], schema=_ARROW)

    schema = T.StructType.fromDDL(
        "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    )
    return stored.mapInArrow(run, schema)


_ARROW = [
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
]
_ARROW = pa.schema(_ARROW)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media table is written as Parquet; what the query returns is computed from the stored bytes and tensors."""
    return describe(materialise(media_table(documents(spark, sf_dir)), "media"))
