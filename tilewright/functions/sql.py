"""The grid as SQL functions. Spark inlines them, so they end up in generated code like any expression."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .grid import HALF, MAX_LAT, SPAN, _table_sql


def _id_body() -> str:
    terms, step = [], "shiftleft(pmod(z, 2), 8)"
    for k in range(7, -1, -1):
        bits = lambda v, k=k: f"cast(shiftright({v}, {4 * k}) & 15 as int)"
        step = f"get(t, shiftleft(shiftright({step}, 8), 8) + shiftleft({bits('x')}, 4) + {bits('y')})"
        terms.append(f"shiftleft(cast({step} & 255 as bigint), {8 * k})")
    return "(shiftleft(1L, 2 * z) - 1) div 3 + " + " + ".join(terms).replace("get(t,", f"get({_table_sql()},")


FUNCTIONS = {
    "tile_x(lon DOUBLE, z INT) RETURNS BIGINT": "least(greatest(cast(floor((least(greatest(lon, -180D), 180D) + 180D) / 360D * shiftleft(1L, z)) as bigint), 0L), shiftleft(1L, z) - 1L)",
    "tile_y(lat DOUBLE, z INT) RETURNS BIGINT": f"least(greatest(cast(floor((1D - asinh(tan(radians(least(greatest(lat, -{MAX_LAT}D), {MAX_LAT}D)))) / pi()) / 2D * shiftleft(1L, z)) as bigint), 0L), shiftleft(1L, z) - 1L)",
    "tile_west(x BIGINT, z INT) RETURNS DOUBLE": "x / shiftleft(1L, z) * 360D - 180D",
    "tile_north(y BIGINT, z INT) RETURNS DOUBLE": "degrees(atan(sinh(pi() - 2D * pi() * y / shiftleft(1L, z))))",
    "tile_left(x BIGINT, z INT) RETURNS DOUBLE": f"-{HALF}D + x * ({SPAN}D / shiftleft(1L, z))",
    "tile_top(y BIGINT, z INT) RETURNS DOUBLE": f"{HALF}D - y * ({SPAN}D / shiftleft(1L, z))",
}


def register(spark: SparkSession) -> None:
    """tile_x, tile_y, tile_west, tile_north, tile_left, tile_top and tile_id(z, x, y) for spark.sql in this session."""
    for head, body in (FUNCTIONS | {"tile_id(z INT, x BIGINT, y BIGINT) RETURNS BIGINT": _id_body()}).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
