"""Numpy kernels on one frame or canvas: the pixel work that built-in expressions cannot express.

Frames are H x W x 3 bytes in blue, green, red order; canvases are H x W grey bytes.
"""

from __future__ import annotations

import numpy as np

# Thresholds that decide what counts as ink, paper, a staff, a gap, a barline and a number.
INK, PAPER_S, PAPER_V, PAPER_GREY = 200, 40, 170, 170
GAP_INK, BARLINE_SHARE, BLOCK_INK = 128, 0.85, 300
REGION_LINE_SHARE, LINE_SHARE = 0.5, 0.6
STAFF_GAP, LEAST_STAFF, STAFF_MARGIN, BRIDGE_SHARE = 40, 25, 16, 0.9
MOST_TRIM = 0.45
NUMBER_ABOVE, NUMBER_LEFT, NUMBER_RIGHT, GLYPH_GAP = 70, 30, 300, 30
GLYPH_HEIGHTS, GLYPH_WIDTHS = (6, 34), (3, 40)


def grey(bgr: np.ndarray) -> np.ndarray:
    """BT.601 luma, rounded."""
    return np.rint(bgr.astype(np.float64) @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def saturation_value(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    high, low = bgr.max(axis=2).astype(np.float64), bgr.min(axis=2)
    return np.where(high > 0, np.rint(255 * (high - low) / np.maximum(high, 1)), 0), high


def paper(bgr: np.ndarray) -> np.ndarray:
    s, v = saturation_value(bgr)
    return (s < PAPER_S) & (v > PAPER_V)


def runs(flags: np.ndarray) -> np.ndarray:
    """Half-open runs (k x 2) of true values."""
    return np.flatnonzero(np.diff(np.concatenate(([0], np.asarray(flags, np.int8), [0])))).reshape(-1, 2)


def close_gaps(flags: np.ndarray, most: int) -> np.ndarray:
    """Fill false stretches of up to ``most`` between true ones."""
    out = np.asarray(flags, bool).copy()
    r = runs(out)
    for a, b in zip(r[:-1, 1], r[1:, 0], strict=True):
        if b - a <= most:
            out[a:b] = True
    return out


def longest(flags: np.ndarray) -> tuple[int, int] | None:
    r = runs(flags)
    return None if not len(r) else tuple(r[np.argmax(r[:, 1] - r[:, 0])].tolist())


def clusters(values, gap: float) -> list[list]:
    """Sorted values split where they jump by more than ``gap``."""
    values = np.asarray(values)
    return [c.tolist() for c in np.split(values, np.flatnonzero(np.diff(values) > gap) + 1)] if len(values) else []


def line_rows(g: np.ndarray, share: float) -> np.ndarray:
    """Rows whose ink, with gaps of up to 14 closed, forms stretches of a sixth of the width that cover ``share``."""
    least = max(1, g.shape[1] // 6)
    hits = []
    for y in np.flatnonzero((g < INK).mean(axis=1) > 0.02):
        r = runs(close_gaps(g[y] < INK, 14))
        size = r[:, 1] - r[:, 0]
        if size[size >= least].sum() >= share * g.shape[1]:
            hits.append(int(y))
    return np.array(hits, np.int64)


def staves(g: np.ndarray, share: float = LINE_SHARE) -> list[dict]:
    """Groups of long horizontal lines, from first to last centre: neighbouring centres lie within 40 rows of each other."""
    centres = [int(np.rint(np.mean(c))) for c in clusters(line_rows(g, share), 3)]
    return [{"top": c[0], "bottom": c[-1], "n_lines": len(c), "line_centers": c} for c in clusters(centres, STAFF_GAP)]


def region_candidate(bgr: np.ndarray) -> tuple[tuple[int, int, int, int], int] | None:
    """(x0, y0, x1, y1) of the paper and its most lines in a staff; None without paper or lines.

    Lines are looked for in paper alone: what is darker or coloured counts as white.
    """
    mask = paper(bgr)
    h, w = mask.shape
    rows = longest(close_gaps(mask.mean(axis=1) > 0.5, max(10, round(0.015 * h))))
    if rows is None or rows[1] - rows[0] < 20:
        return None
    columns = longest(close_gaps(mask[rows[0] : rows[1]].mean(axis=0) > 0.5, max(10, round(0.015 * w))))
    if columns is None or columns[1] - columns[0] < 20:
        return None
    (y0, y1), (x0, x1) = rows, columns
    g = np.where(mask[y0:y1, x0:x1], grey(bgr[y0:y1, x0:x1]), 255)
    found = staves(g, REGION_LINE_SHARE)
    return ((x0, y0, x1, y1), max(f["n_lines"] for f in found)) if found else None


def cursor_column(bgr: np.ndarray) -> tuple[int, int] | None:
    """Column with most pixels of unusual saturation, and their number."""
    s, _ = saturation_value(bgr)
    hits = (s > np.median(s) + max(3 * (s.std() + 1e-6), 25)).sum(axis=0)
    best = int(np.argmax(hits))
    return (best, int(hits[best])) if hits[best] > 0 else None


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(dx, dy) by which the content of a lies in b, to sub-pixel precision."""
    spectrum = np.fft.rfft2(a.astype(np.float64)).conj() * np.fft.rfft2(b.astype(np.float64))
    peak = np.fft.irfft2(spectrum / np.maximum(np.abs(spectrum), 1e-12), s=a.shape)
    y, x = np.unravel_index(np.argmax(peak), peak.shape)
    out = []
    for at, n, line in ((x, a.shape[1], peak[y]), (y, a.shape[0], peak[:, x])):
        near = np.maximum(line[(at + np.array([-2, -1, 0, 1, 2])) % n], 0)
        at = at + (near @ np.array([-2, -1, 0, 1, 2])) / max(near.sum(), 1e-12)
        out.append(float(at - n if at > n / 2 + 0.5 else at))
    return out[0], out[1]


def strip_half(length: int) -> int:
    return 1 if length <= 4 else max(8, min(120, length // 6))


def strip_match(before: np.ndarray, after: np.ndarray) -> tuple[int, float]:
    """Rows by which the bottom strip of ``before`` moved up in ``after``, and the normalised correlation.

    The products of the strip with all windows come from one transform along the rows; they are whole numbers, so rounding
    makes them exact. Sums and squares of windows come from running sums.
    """
    size = min(2 * strip_half(before.shape[0]), before.shape[0])
    base, n = before.shape[0] - size, size * before.shape[1]
    strip, whole = before[base:].astype(np.int64), after[: before.shape[0]].astype(np.int64)
    length = 1 << (len(whole) + size - 1).bit_length()
    spectrum = (np.fft.rfft(strip, length, axis=0).conj() * np.fft.rfft(whole, length, axis=0)).sum(axis=1)
    products = np.rint(np.fft.irfft(spectrum, length)[: base + 1]).astype(np.int64)
    running = lambda rows: np.concatenate(([0], np.cumsum(rows)))
    sums, squares = running(whole.sum(axis=1)), running((whole**2).sum(axis=1))
    at = np.arange(base + 1)
    total = sums[at + size] - sums[at]
    spread = n * (squares[at + size] - squares[at]) - total**2
    own = int(n * (strip**2).sum() - strip.sum() ** 2)
    scale = np.sqrt(float(own)) * np.sqrt(spread.astype(np.float64))
    score = np.where(scale > 0, (n * products - strip.sum() * total) / np.maximum(scale, 1e-300), 0.0)
    best = int(np.argmax(score))
    return base - best, float(score[best])


def signature(bgr: np.ndarray, region: tuple[int, int, int, int] | None, size: tuple[int, int] = (36, 64)) -> np.ndarray:
    """Area means of a frame without the region, flat."""
    x = bgr.astype(np.float64)
    if region:
        x0, y0, x1, y1 = region
        x[y0:y1, x0:x1] = 0
    for axis, n in enumerate(size):
        edges = np.linspace(0, x.shape[axis], n + 1)
        total = np.concatenate((np.zeros_like(np.take(x, [0], axis)), np.cumsum(x, axis=axis)), axis=axis)
        low = np.floor(edges).astype(int)
        part = np.take(total, low, axis) + (edges - low).reshape([-1 if i == axis else 1 for i in range(3)]) * np.take(
            np.concatenate((x, np.zeros_like(np.take(x, [0], axis))), axis=axis), low, axis
        )
        x = np.diff(part, axis=axis) / (x.shape[axis] / n)
    return x.reshape(-1).astype(np.float32)


def otsu(values) -> float:
    """Threshold of largest between-class variance as a bin centre."""
    v = np.asarray(values, np.float64)
    if len(v) < 2 or v.min() == v.max():
        return float(v.max()) if len(v) else 0.0
    count, edges = np.histogram(v, min(64, max(8, len(v))))
    centre = (edges[:-1] + edges[1:]) / 2
    w0, s0 = np.cumsum(count), np.cumsum(count * centre)
    w1 = w0[-1] - w0
    gap = s0 / np.maximum(w0, 1) - (s0[-1] - s0) / np.maximum(w1, 1)
    return float(centre[np.argmax(np.where((w0 > 0) & (w1 > 0), w0 * w1 * gap**2, -1))])


def bridged(gap: np.ndarray) -> bool:
    """Two or more columns inked through nearly the whole gap."""
    return bool(((gap < GAP_INK).mean(axis=0) >= BRIDGE_SHARE).sum() >= 2) if gap.shape[0] else False


def wide_gaps(ink: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Blank row runs, margins too, that are no shorter than the threshold of all runs; ``ink`` counts each row's inked pixels."""
    gaps = runs(ink < max(3, int(0.02 * width)))
    limit = otsu(gaps[:, 1] - gaps[:, 0]) if len(gaps) > 1 else 0
    return [(a, b) for a, b in gaps.tolist() if b - a >= limit]


def blocks_between(ink: np.ndarray, gaps: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Row ranges of enough ink, cut in the middle of each gap, and the rows of the cuts between those that are kept."""
    h = len(ink)
    total = np.concatenate(([0], np.cumsum(ink)))
    cuts = sorted({0, h, *((a + b) // 2 for a, b in gaps)})
    kept = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if total[b] - total[a] > BLOCK_INK] or [(0, h)]
    return kept, [(x[1] + y[0]) // 2 for x, y in zip(kept, kept[1:], strict=False)]


def blocks(canvas: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """System blocks of a canvas as row ranges, and the rows of the cuts between them."""
    ink = (canvas < GAP_INK).sum(axis=1)
    return blocks_between(ink, [(a, b) for a, b in wide_gaps(ink, canvas.shape[1]) if not bridged(canvas[a:b])])


def staff_of(canvas: np.ndarray) -> tuple[int, int] | None:
    """Top and bottom line of the lowest staff."""
    rows = [y for y in line_rows(canvas, LINE_SHARE) if y < canvas.shape[0] - STAFF_MARGIN]
    groups = [c for c in clusters(rows, STAFF_GAP) if c[-1] - c[0] >= LEAST_STAFF]
    return (groups[-1][0], groups[-1][-1]) if groups else None


def barlines(canvas: np.ndarray) -> list[int]:
    """Columns of the barlines of the lowest staff."""
    staff = staff_of(canvas)
    if staff is None:
        return []
    share = (canvas[staff[0] : staff[1] + 1] < INK).mean(axis=0)
    return [(c[0] + c[-1]) // 2 for c in clusters(np.flatnonzero(share >= BARLINE_SHARE), 4)]


def trim(canvas: np.ndarray, last: bool) -> tuple[np.ndarray, bool]:
    """A page cut before its last barline, and low confidence if that would take too much (then it stays whole)."""
    bars = [] if last else barlines(canvas)
    if not bars:
        return canvas, False
    if (canvas.shape[1] - bars[-1]) / canvas.shape[1] > MOST_TRIM:
        return canvas, True
    return canvas[:, : bars[-1]], False


def _cubic(distance: np.ndarray) -> np.ndarray:
    """Kernel of cubic convolution with the usual slope of -0.75."""
    d, a = np.abs(distance), -0.75
    near, far = ((a + 2) * d - (a + 3)) * d * d + 1, ((d - 5) * d + 8) * d * a - 4 * a
    return np.where(d <= 1, near, np.where(d < 2, far, 0.0))


def scaled(canvas: np.ndarray, factor: float) -> np.ndarray:
    """Resized by cubic interpolation after an unsharp mask; sizes round half to even, 1 at least."""
    x = canvas.astype(np.float64)
    taps = np.exp(-0.5 * (np.arange(-4, 5) / 1.2) ** 2)
    taps /= taps.sum()
    soft = x
    for axis in (0, 1):
        padded = np.pad(soft, [(4, 4) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        soft = sum(t * np.take(padded, np.arange(k, k + x.shape[axis]), axis) for k, t in enumerate(taps))
    x = np.clip(np.rint(1.5 * x - 0.5 * soft), 0, 255)
    for axis in (0, 1):
        n = max(1, int(np.rint(x.shape[axis] * factor)))
        at = (np.arange(n) + 0.5) / factor - 0.5
        low = np.floor(at).astype(int)
        out = 0.0
        for k in (-1, 0, 1, 2):
            weight = _cubic(at - low - k).reshape((-1, 1) if axis == 0 else (1, -1))
            out = out + weight * np.take(x, np.clip(low + k, 0, x.shape[axis] - 1), axis)
        x = out
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def components(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(left, top, width, height) of the 8-connected components, by union of row runs."""
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    boxes, above = [], []
    for y in range(mask.shape[0]):
        here = []
        for a, b in runs(mask[y]).tolist():
            i = len(parent)
            parent.append(i)
            boxes.append([a, y, b, y + 1])
            for a2, b2, j in above:
                if a2 <= b and a <= b2:
                    p, q = sorted((root(i), root(j)))
                    parent[q] = p
            here.append((a, b, i))
        above = here
    out: dict[int, list[int]] = {}
    for i, (x0, y0, x1, y1) in enumerate(boxes):
        r = out.setdefault(root(i), [x0, y0, x1, y1])
        r[:] = [min(r[0], x0), min(r[1], y0), max(r[2], x1), max(r[3], y1)]
    return [(x0, y0, x1 - x0, y1 - y0) for x0, y0, x1, y1 in out.values()]


def number_strip(g: np.ndarray) -> np.ndarray | None:
    """The strip above the topmost line, from a little left of the line's first ink; None without a line or without room."""
    rows = line_rows(g, LINE_SHARE)
    if not len(rows):
        return None
    top = int(rows[0])
    left = int(np.argmax(g[top] < INK))
    strip = g[max(0, top - NUMBER_ABOVE) : top, max(0, left - NUMBER_LEFT) : left + NUMBER_RIGHT]
    return strip if strip.size else None


def first_number_box(g: np.ndarray) -> tuple[int, int, int, int] | None:
    """Box of the leftmost cluster of digit-sized glyphs."""
    glyphs = sorted(c for c in components(g < INK) if GLYPH_HEIGHTS[0] <= c[3] <= GLYPH_HEIGHTS[1] and GLYPH_WIDTHS[0] <= c[2] <= GLYPH_WIDTHS[1])
    if not glyphs:
        return None
    taken = [glyphs[0]]
    for c in glyphs[1:]:
        if c[0] - (taken[-1][0] + taken[-1][2]) > GLYPH_GAP:
            break
        taken.append(c)
    return min(c[0] for c in taken), min(c[1] for c in taken), max(c[0] + c[2] for c in taken), max(c[1] + c[3] for c in taken)
