"""PNG images as arrays, without an imaging library: 8-bit grey, colour and palette images that are not interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_MAGIC = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel by colour type.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunks(raw: bytes) -> dict[bytes, bytes]:
    if raw[:8] != _MAGIC:
        raise ValueError("not a PNG file")
    found, at = {}, 8
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        if len(raw) < at + 12 + size:
            raise ValueError("a PNG file is cut short")
        found[kind] = found.get(kind, b"") + raw[at + 8 : at + 8 + size]
        if kind == b"IEND":
            return found
        at += 12 + size
    raise ValueError("a PNG file is cut short")


def _unfiltered(kinds: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Samples (rows x columns x samples) from filtered ones.

    A row filtered by nothing, by its left or by its upper neighbour is one array operation. Averages and Paeth's
    predictor need left, upper and corner samples at once; from the first such row on, pixels are done by anti-diagonals,
    all of one diagonal together.
    """
    out = data.copy()
    simple = np.flatnonzero(kinds > 2)
    end = int(simple[0]) if len(simple) else len(kinds)
    for y in range(end):
        if kinds[y] == 1:
            out[y] = np.cumsum(data[y], axis=0, dtype=np.uint8)
        elif kinds[y] == 2 and y:
            out[y] = data[y] + out[y - 1]
    if end == len(kinds):
        return out
    h, w, n = len(kinds) - end, data.shape[1], data.shape[2]
    wide = np.zeros((h + 1, w + 1, n), np.int16)
    wide[0, 1:] = out[end - 1] if end else 0
    kind, part = kinds[end:], data[end:].astype(np.int16)
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        a, b, c = wide[y + 1, x], wide[y, x + 1], wide[y, x]
        pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        k = kind[y][:, None]
        guess = np.select([k == 0, k == 1, k == 2, k == 3], [0, a, b, (a + b) >> 1], paeth)
        wide[y + 1, x + 1] = (part[y, x] + guess) & 255
    out[end:] = wide[1:, 1:].astype(np.uint8)
    return out


def decode(raw: bytes) -> np.ndarray:
    """An H x W x 3 array in blue, green, red order; alpha is left out. Anything else raises ValueError."""
    chunks = _chunks(raw)
    w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunks.get(b"IHDR", b"")[:13].ljust(13, b"\0"))
    if depth != 8 or colour not in _SAMPLES or interlaced or not w or not h:
        raise ValueError("a PNG file of a form that is not read")
    n = _SAMPLES[colour]
    try:
        rows = np.frombuffer(zlib.decompress(chunks.get(b"IDAT", b"")), np.uint8)
    except zlib.error as wrong:
        raise ValueError("a PNG file is damaged") from wrong
    if rows.size != h * (1 + w * n):
        raise ValueError("a PNG file is cut short")
    rows = rows.reshape(h, 1 + w * n)
    if rows[:, 0].max() > 4:
        raise ValueError("a PNG file is damaged")
    image = _unfiltered(rows[:, 0], rows[:, 1:].reshape(h, w, n))
    if colour == 3:
        table = np.frombuffer(chunks[b"PLTE"], np.uint8).reshape(-1, 3)
        image = table[image[..., 0]]
    elif n < 3:
        image = np.repeat(image[..., :1], 3, axis=2)
    return np.ascontiguousarray(image[..., 2::-1])
