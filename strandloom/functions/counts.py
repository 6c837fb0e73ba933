"""Medians of many images from counts that merge: 256 counters a pixel, of which the non-zero ones are kept.

A partial result is a pair (keys, counts): ``keys`` holds pixel * 256 + level, ascending, ``counts`` how many images have
that level there. Partial results add up in any order, so that no one needs to hold all images of a page; the size is
bounded by pixels, not by images.
"""

from __future__ import annotations

import numpy as np

#: Pixels that are counted together.
PIXELS = 4096


def counted(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a stack (images x pixels, bytes)."""
    n = stack.shape[1]
    total = np.bincount((np.arange(n) * 256 + stack).ravel(), minlength=n * 256)
    keys = np.flatnonzero(total)
    return keys.astype(np.int32), total[keys].astype(np.int32)


class Totals:
    """The sum of partial results: one table of 256 counters a pixel, whatever the number of images."""

    def __init__(self, pixels: int):
        self.pixels, self.total = pixels, np.zeros(pixels * 256, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.total[keys] += counts

    def levels(self, n: int, *ranks: int) -> list[np.ndarray]:
        """Each pixel's level at some ranks (from 0) of its n images. As all pixels have n, one running sum serves them all."""
        keys = np.flatnonzero(self.total)
        running, start = np.cumsum(self.total[keys]), np.arange(self.pixels, dtype=np.int64) * n
        return [(keys[np.searchsorted(running, start + r, side="right")] % 256).astype(np.uint8) for r in ranks]

    def median(self, n: int) -> np.ndarray:
        """The median of each pixel's n images, cut to a byte."""
        low, high = self.levels(n, (n - 1) // 2, n // 2)
        return ((low.astype(np.int32) + high) // 2).astype(np.uint8)
