import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa

from strandloom.llm import media

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, media string"
TEXTS = [None, "", "a", "x" * 192, "é😀" * 77, "lorem ipsum " * 9000, "x" * 193]


def test_digests_and_round_trip(spark):
    rows = [(i, t, "en", "s", 1, "clash") for i, t in enumerate(TEXTS)] + [(99, TEXTS[4], "en", "s", 1, "")] * 2
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = media.describe(media.media_table(docs)).collect()
    assert len(out) == len(rows)
    text = {r[0]: (r[1] or "").encode() for r in rows}
    stored = {x.doc_id: bytes(x.media) for x in media.to_audio(docs).collect()}
    for x in out:
        raw = text[x.doc_id]
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        with wave.open(io.BytesIO(stored[x.doc_id])) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, media.RATE)
            assert w.readframes(w.getnframes()) == payload
        assert (x.n_bytes, x.payload_bytes, x.media_bytes) == (len(raw), len(payload), len(stored[x.doc_id]))
        assert x.payload_sha256 == hashlib.sha256(payload).hexdigest() and x.tail_crc32 == zlib.crc32(payload[-16:])
        assert x.media_sha256 == hashlib.sha256(stored[x.doc_id]).hexdigest()
    assert len({x.feature for x in out if text[x.doc_id] == TEXTS[4].encode()}) == 1
    assert len({x.feature for x in out}) >= 4
    assert media.describe(media.media_table(docs.limit(0))).count() == 0


def test_tone_is_resampled_and_found_in_its_band():
    t = np.arange(16000) / media.RATE
    for hz in (300, 900, 2000):
        x = media.resample(np.sin(2 * np.pi * hz * t).astype(np.float32))
        assert len(x) == 6400
        want = np.sin(2 * np.pi * hz * np.arange(6400) / media.OUT_RATE)
        shift = max(range(-4, 5), key=lambda s: np.corrcoef(np.roll(x, s)[100:-100], want[100:-100])[0, 1])
        assert abs(shift) <= 4 and np.abs(np.fft.rfft(x)).argmax() == hz
        band = media.log_mel(x)[5:-5].mean(axis=0).argmax()
        assert media._bank()[round(hz * media.FFT / media.OUT_RATE), band] > 0


def test_hysteresis():
    e = np.full(41, -0.5)
    e[5:10], e[7], e[30:33] = 0.5, 5, 9
    e[11:20] = e[25:30] = e[33:36] = -9
    assert media.segments(e) == [(0, 11), (30, 33)]
    e[22] = 9
    assert media.segments(e) == [(0, 11), (20, 25), (30, 33)]


def test_tensors_have_one_shape(spark):
    docs = spark.createDataFrame([(1, "abc " * 8000, None, None, None, None), (2, "", None, None, None, None)], SCHEMA)
    rows = media.tensors(media.to_audio(docs)).orderBy("doc_id", "part").collect()
    assert {len(r.tensor) for r in rows} == {media.SPAN * media.BANDS}
    assert rows[0].start_s == 0 and all(a.start_s < a.end_s for a in rows) and [r.part for r in rows if r.doc_id == 2] == [0]
    array = media.fixed_shape(pa.array([r.tensor for r in rows], pa.list_(pa.int16())))
    assert array.type.shape == [media.SPAN, media.BANDS]


def test_features_of_the_query_are_those_of_the_stored_files(spark, tmp_path, monkeypatch):
    """From each stored file by itself: its frames, a digest of them, the end of the last window, and its segments."""
    monkeypatch.setattr(media, "TOGETHER", 2000)
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "clash") for i, t in enumerate(TEXTS)] + [(None, "ab " * 700, None, None, None, None)] * 2, SCHEMA)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    table = media.media_table(docs).collect()
    out = {(x.doc_id, x.media_sha256): x.feature for x in media.op8_media_columns(spark, str(tmp_path)).collect()}
    assert len(out) == len(TEXTS) + 1
    for row in table:
        mel, found = media.analyse(bytes(row.media))
        parts = -(-len(mel) // media.SPAN)
        values = np.array(row.tensor, np.int16).reshape(parts, media.SPAN, media.BANDS)
        assert (values.reshape(-1, media.BANDS)[: len(mel)] == mel).all() and not values.reshape(-1, media.BANDS)[len(mel) :].any()
        assert sum(row.frames) == len(mel) and [tuple(s) for s in row.segments] == found
        assert row.start_s == [k * media.SPAN * media.HOP / media.OUT_RATE for k in range(parts)]
        end = ((len(mel) - 1) * media.HOP + media.WINDOW) / media.OUT_RATE
        want = f"mel={len(mel)}x{media.BANDS}:{hashlib.sha256(mel.tobytes()).hexdigest()[:32]};tensors={parts}x{media.SPAN}x{media.BANDS};end={end:.4f};segments={len(found)}:{sum(b - a for a, b in found)}"
        assert out[row.doc_id, hashlib.sha256(bytes(row.media)).hexdigest()] == want and abs(row.end_s[-1] - end) < 1e-9
