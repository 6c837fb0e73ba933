"""Pixel expressions on byte columns, for exploded pixels of small regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luma(b: Column, g: Column, r: Column) -> Column:
    return F.bround(b * 0.114 + g * 0.587 + r * 0.299, 0).cast("int")


def saturation(b: Column, g: Column, r: Column) -> Column:
    high, low = F.greatest(b, g, r), F.least(b, g, r)
    return F.when(high > 0, F.bround((high - low) * 255.0 / high, 0)).otherwise(0).cast("int")


def value(b: Column, g: Column, r: Column) -> Column:
    return F.greatest(b, g, r)


def is_paper(s: Column, v: Column) -> Column:
    return (s < 40) & (v > 170)


def is_ink(grey: Column) -> Column:
    return grey < 200


def binarised(grey: Column) -> Column:
    return F.when(grey > 195, 255).otherwise(0)


def is_digit_sized(height: Column, width: Column) -> Column:
    return height.between(6, 34) & width.between(3, 40)


def inside(x: Column, y: Column, region: tuple[int, int, int, int]) -> Column:
    x0, y0, x1, y1 = region
    return (x >= x0) & (x < x1) & (y >= y0) & (y < y1)


def strip_half(length: Column) -> Column:
    return F.when(length <= 4, 1).otherwise(F.greatest(F.lit(8), F.least(F.lit(120), F.floor(length / 6)))).cast("int")


def ink_flag(lost: Column) -> Column:
    return F.when(lost > 3000, "error").when(lost > 300, "warn").otherwise("ok")


def is_gap_ink(grey: Column) -> Column:
    """Ink in the search for gaps between systems."""
    return grey < 128


def discarded(total: Column, kept: Column) -> Column:
    """Ink outside every block."""
    return F.greatest(F.lit(0), total - kept).cast("long")


def trimmed(width: Column, bar: Column, last: Column) -> Column:
    """(kept, guarded): a page keeps the columns before its last barline, but the last page, one without a barline, and
    one that would lose over 45 % stay whole; the latter is guarded."""
    whole = last | bar.isNull()
    guarded = ~whole & ((width - bar) * 100 > width * 45)
    return F.struct(F.when(whole | guarded, width).otherwise(bar).alias("kept"), F.coalesce(guarded, F.lit(False)).alias("guarded"))
