"""Resampling arithmetic as columns: what the renderer does with arrays, for plans and checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grid import _c, clamp


def source_position(coordinate, origin, step) -> Column:
    """Source pixel position (centres at whole numbers) of a coordinate."""
    return (_c(coordinate) - _c(origin)) / _c(step) - 0.5


def affine(gt, px, py) -> Column:
    """Struct x, y of a pixel corner under a geotransform (array column of six)."""
    g, px, py = _c(gt), _c(px), _c(py)
    return F.struct((g[0] + px * g[1] + py * g[2]).alias("x"), (g[3] + px * g[4] + py * g[5]).alias("y"))


def tap(position, size, nearest: bool = False) -> Column:
    """Struct lower, upper, weight: the two source pixels between which a position lies, within the source."""
    p, n = _c(position).cast("double"), _c(size).cast("long")
    zero = F.lit(0).cast("long")
    last = n - 1
    if nearest:
        at = clamp(F.round(p).cast("long"), zero, last)
        low, high, w = at, at, F.lit(0.0)
    else:
        low = clamp(F.floor(p).cast("long"), zero, last)
        high, w = F.least(low + 1, last), clamp(p - low, 0.0, 1.0)
    one = n <= 1
    return F.struct(F.when(one, zero).otherwise(low).alias("lower"), F.when(one, zero).otherwise(high).alias("upper"), F.when(one, 0.0).otherwise(w).alias("weight"))


def blend(top_left, top_right, bottom_left, bottom_right, wx, wy) -> Column:
    """Bilinear value: across, then down."""
    wx, wy = _c(wx), _c(wy)
    top = _c(top_left) * (1 - wx) + _c(top_right) * wx
    bottom = _c(bottom_left) * (1 - wx) + _c(bottom_right) * wx
    return top * (1 - wy) + bottom * wy


def strategy(epsg, north_up, eight_bit, kernel, asked) -> Column:
    """same-crs, geographic or warp, as the renderer chooses."""
    simple = _c(kernel).isin("nearest", "bilinear") & _c(north_up) & _c(eight_bit)
    a = _c(asked)
    return F.when(simple & (_c(epsg) == 3857) & a.isin("auto", "same-crs"), "same-crs").when(simple & (_c(epsg) == 4326) & a.isin("auto", "geographic"), "geographic").otherwise("warp")
