"""Synthetic frames and canvases, drawn with numpy."""

import numpy as np

REGION = (36, 96, 846, 282)


def staff(width, height, seed=0, lines=4, gap=28, top=24, bars=7):
    """A grey strip with lines, barlines and random marks."""
    g = np.full((height, width), 255, np.uint8)
    r = np.random.default_rng(seed)
    for k in range(lines):
        g[top + k * gap : top + k * gap + 2] = 185
    for x in np.linspace(10, width - 12, bars).astype(int):
        g[top : top + (lines - 1) * gap + 2, x : x + 4] = 0
    for _ in range(40):
        x, y = r.integers(0, width - 12), top + gap * r.integers(0, lines) + r.integers(-6, 0)
        g[max(0, y) : y + 9, x : x + 6] = 0
    return g


def frame(strip, noise=1, cursor=None, color=(0, 0, 255), region=REGION, size=(400, 880)):
    """A frame with a strip as paper in the region, on dark diagonal waves whose phase ``noise`` sets."""
    x0, y0, x1, y1 = region
    y, x = np.mgrid[: size[0], : size[1]]
    wave = 45 + 35 * np.sin((x + 2 * y) / 23 + noise)
    image = np.stack((wave, wave * 0.6, 90 - wave * 0.5), axis=2).astype(np.uint8)
    image[y0:y1, x0:x1] = strip[: y1 - y0, : x1 - x0, None]
    if cursor is not None:
        image[y0 + 4 : y1 - 4, x0 + cursor : x0 + cursor + 11] = color
    return image


def rows(images, video="v"):
    return [(video, i, *m.shape[:2], m.tobytes()) for i, m in enumerate(images)]
