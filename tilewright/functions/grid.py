"""Web Mercator tile grid: columns in, columns out, all in generated code.

Angles are degrees; lengths are metres of EPSG:3857. Nulls give nulls.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format and the projection.
MAX_LAT = 85.05112878
HALF = 20037508.342789244
SPAN = 40075016.685578488
MAX_ZOOM = 31


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _shl(a, bits) -> Column:
    return F.call_function("shiftleft", _c(a), _c(bits).cast("int"))


def clamp(x, low, high) -> Column:
    return F.least(F.greatest(_c(x), _c(low)), _c(high))


def tiles_across(z) -> Column:
    return _shl(F.lit(1).cast("long"), z)


def lon_to_x(lon, z) -> Column:
    n = tiles_across(z)
    return clamp(F.floor((clamp(_c(lon).cast("double"), -180.0, 180.0) + 180.0) / 360.0 * n).cast("long"), F.lit(0).cast("long"), n - 1)


def lat_to_y(lat, z) -> Column:
    n = tiles_across(z)
    up = F.asinh(F.tan(F.radians(clamp(_c(lat).cast("double"), -MAX_LAT, MAX_LAT)))) / F.pi()
    return clamp(F.floor((1.0 - up) / 2.0 * n).cast("long"), F.lit(0).cast("long"), n - 1)


def x_to_lon(x, z) -> Column:
    """Western edge of tile column x."""
    return _c(x) / tiles_across(z) * 360.0 - 180.0


def y_to_lat(y, z) -> Column:
    """Northern edge of tile row y."""
    return F.degrees(F.atan(F.sinh(F.pi() - 2.0 * F.pi() * _c(y) / tiles_across(z))))


def lonlat_bounds(z, x, y) -> Column:
    x, y = _c(x), _c(y)
    return F.struct(x_to_lon(x, z).alias("west"), y_to_lat(y + 1, z).alias("south"), x_to_lon(x + 1, z).alias("east"), y_to_lat(y, z).alias("north"))


def mercator_bounds(z, x, y) -> Column:
    side = F.lit(SPAN) / tiles_across(z)
    left, top = F.lit(-HALF) + _c(x) * side, F.lit(HALF) - _c(y) * side
    return F.struct(left.alias("min_x"), (top - side).alias("min_y"), (left + side).alias("max_x"), top.alias("max_y"))


def mercator_to_lon(mx) -> Column:
    return _c(mx) / HALF * 180.0


def mercator_to_lat(my) -> Column:
    return F.degrees(2.0 * F.atan(F.exp(_c(my) / HALF * F.pi())) - F.pi() / 2.0)


def lon_to_mercator(lon) -> Column:
    return _c(lon) / 180.0 * HALF


def lat_to_mercator(lat) -> Column:
    return F.asinh(F.tan(F.radians(_c(lat)))) / F.pi() * HALF


def on_grid(z, x, y) -> Column:
    """Whether the address exists."""
    z, x, y = _c(z), _c(x), _c(y)
    n = tiles_across(clamp(z, 0, MAX_ZOOM))
    return (z >= 0) & (z <= MAX_ZOOM) & (x >= 0) & (y >= 0) & (x < n) & (y < n)


# --- tile ids: position on the Hilbert curve of the zoom, behind all tiles of lower zooms

_LEVELS = 4  # levels of the curve that one table look-up covers


def hilbert_table(levels: int = _LEVELS) -> list[int]:
    """For each state and each `levels` bits of x and y: next state << 2 * levels | digits of the curve.

    A state is how the quadrants below are turned: bit 0, x and y change places; bit 1, both are mirrored. The curve runs through
    quadrants (0,0), (0,1), (1,1), (1,0); the first is walked with x and y exchanged, the last exchanged and mirrored.
    """
    order = {(0, 0): 0, (0, 1): 1, (1, 1): 2, (1, 0): 3}
    turn = {(0, 0): 1, (1, 0): 3}
    out = []
    for state in range(4):
        for bits in range(1 << 2 * levels):
            s, digits = state, 0
            for i in range(levels - 1, -1, -1):
                q = bits >> (levels + i) & 1, bits >> i & 1
                if s & 2:
                    q = 1 - q[0], 1 - q[1]
                if s & 1:
                    q = q[1], q[0]
                digits = digits << 2 | order[q]
                s ^= turn.get(q, 0)
            out.append(s << 2 * levels | digits)
    return out


@cache
def _table_sql() -> str:
    return "array(" + ",".join(map(str, hilbert_table())) + ")"


def tiles_below(z) -> Column:
    """Tiles of all zooms below z."""
    ends = _shl(F.lit(1).cast("long"), 2 * _c(z)) - 1
    return F.call_function("div", ends, F.lit(3).cast("long"))


def tile_id(z, x, y) -> Column:
    """Id of tile (z, x, y). Eight table look-ups in generated code cover the 32 levels; levels above z are zero bits, which only
    exchange x and y, so the walk starts exchanged where their number is odd."""
    z, x, y = _c(z).cast("int"), _c(x).cast("long"), _c(y).cast("long")
    table, mask = F.expr(_table_sql()), F.lit((1 << _LEVELS) - 1)
    step, parts = F.shiftleft(F.pmod(z, F.lit(2)), 2 * _LEVELS), []
    for k in range(32 // _LEVELS - 1, -1, -1):
        bits = lambda v, k=k: F.shiftright(v, k * _LEVELS).bitwiseAND(mask).cast("int")
        state = F.shiftright(step, 2 * _LEVELS)
        step = F.get(table, F.shiftleft(state, 2 * _LEVELS) + F.shiftleft(bits(x), _LEVELS) + bits(y))
        parts.append(F.shiftleft(step.bitwiseAND(F.lit((1 << 2 * _LEVELS) - 1)).cast("long"), 2 * _LEVELS * k))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return tiles_below(z) + total


def tile_id_checked(z, x, y) -> Column:
    """tile_id, raising for addresses off the grid."""
    z, x, y = _c(z), _c(x), _c(y)
    return F.when(on_grid(z, x, y), tile_id(z, x, y)).otherwise(F.raise_error(F.format_string("tile %d/%d/%d is off the grid", z, x, y)).cast("long"))


# --- bounds


def normal_bounds(west: float, south: float, east: float, north: float) -> tuple[float, float, float, float]:
    """Bounds clamped to the projection's range. Raises where they are empty, upside down or not numbers; bounds across the
    antimeridian are not supported."""
    b = (west, south, east, north)
    if not all(abs(v) < float("inf") for v in b) or not (west < east and south < north):
        raise ValueError(f"bounds must be finite with west < east and south < north: {b}")
    c = (max(-180.0, west), max(-MAX_LAT, south), min(180.0, east), min(MAX_LAT, north))
    if not (c[0] < c[2] and c[1] < c[3]):
        raise ValueError(f"bounds lie outside the map: {b}")
    return c


def bounds_state(west, south, east, north) -> Column:
    """'ok', 'empty' or 'outside' for bounds in columns, by the rules of normal_bounds."""
    w, s, e, n = map(_c, (west, south, east, north))
    inside = (F.greatest(w, F.lit(-180.0)) < F.least(e, F.lit(180.0))) & (F.greatest(s, F.lit(-MAX_LAT)) < F.least(n, F.lit(MAX_LAT)))
    return F.when(~((w < e) & (s < n)), "empty").when(~inside, "outside").otherwise("ok")


# --- fixed-point coordinates


def to_e7(degrees) -> Column:
    return F.round(_c(degrees) * 1e7).cast("int")


def from_e7(e7) -> Column:
    return _c(e7) / 1e7
