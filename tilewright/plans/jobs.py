"""Tile jobs and chunk plans."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grid

#: Rows a partition of generated jobs holds, about.
JOBS_PER_PARTITION = 1 << 20


@dataclass(frozen=True)
class ZoomRange:
    """Inclusive tile ranges of a zoom."""

    z: int
    min_x: int
    max_x: int
    min_y: int
    max_y: int

    @property
    def width(self) -> int:
        return self.max_x - self.min_x + 1

    @property
    def height(self) -> int:
        return self.max_y - self.min_y + 1

    @property
    def tiles(self) -> int:
        return self.width * self.height


def _tile_at(lon: float, lat: float, z: int) -> tuple[int, int]:
    n = 1 << z
    lon, lat = min(180.0, max(-180.0, lon)), min(grid.MAX_LAT, max(-grid.MAX_LAT, lat))
    x = math.floor((lon + 180.0) / 360.0 * n)
    y = math.floor((1.0 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2.0 * n)
    return min(n - 1, max(0, x)), min(n - 1, max(0, y))


def zoom_ranges(bounds, min_zoom: int, max_zoom: int) -> list[ZoomRange]:
    """Ranges are closed: an eastern or southern bound on a tile's edge takes in the tile beyond it."""
    if not 0 <= min_zoom <= max_zoom <= grid.MAX_ZOOM:
        raise ValueError(f"zooms must run up within 0 to {grid.MAX_ZOOM}: {min_zoom}-{max_zoom}")
    w, s, e, n = grid.normal_bounds(*bounds)
    out = []
    for z in range(min_zoom, max_zoom + 1):
        (x0, y0), (x1, y1) = _tile_at(w, n, z), _tile_at(e, s, z)
        out.append(ZoomRange(z, x0, x1, y0, y1))
    return out


def tile_jobs(spark: SparkSession, bounds, min_zoom: int, max_zoom: int) -> DataFrame:
    """z, x, y, tile_id of every tile that the bounds touch.

    Row numbers are dealt over partitions and turned into addresses, so generation is parallel at every zoom and needs no
    shuffle; zoom and bounds are in the numbering itself, nothing is generated to be filtered out. Order by tile_id for curve order.
    """
    ranges = zoom_ranges(bounds, min_zoom, max_zoom)
    total = sum(r.tiles for r in ranges)
    i, start = F.col("id"), 0
    z, x, y = (F.lit(None).cast(t) for t in ("int", "long", "long"))
    for r in ranges:  # at most 32
        here = i >= start
        k = i - F.lit(start)
        row = F.call_function("div", k, F.lit(r.width).cast("long"))
        z, x, y = F.when(here, r.z).otherwise(z), F.when(here, k % r.width + F.lit(r.min_x)).otherwise(x), F.when(here, row + F.lit(r.min_y)).otherwise(y)
        start += r.tiles
    parts = max(1, min(100_000, math.ceil(total / JOBS_PER_PARTITION)))
    a = spark.range(0, total, 1, parts).select(z.cast("int").alias("z"), x.cast("long").alias("x"), y.cast("long").alias("y"))
    return a.withColumn("tile_id", grid.tile_id("z", "x", "y"))


def tiles_by_zoom(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("z").agg(F.count("*").alias("tiles"))


def extents(jobs: DataFrame) -> DataFrame:
    """Per zoom: tiles, ranges of x and y."""
    return jobs.groupBy("z").agg(F.count("*").alias("tiles"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def with_chunks(jobs: DataFrame, size) -> DataFrame:
    """Adds the chunk a tile lies in, and its place there."""
    c = grid._c(size).cast("long")
    div = lambda v: F.call_function("div", F.col(v), c)
    return jobs.withColumns({"cx": div("x"), "cy": div("y"), "in_x": F.col("x") % c, "in_y": F.col("y") % c})


def ceil_div(a, b) -> Column:
    a, b = grid._c(a), grid._c(b)
    return F.call_function("div", a + b - 1, b)


def chunk_bytes(tiles_wide, tiles_high, tile_size) -> Column:
    """Memory of a chunk: four bands, source and target."""
    return grid._c(tiles_wide) * grid._c(tile_size) * grid._c(tiles_high) * grid._c(tile_size) * 8


MIB = 1 << 20
SMALLEST, PER_WORKER = 4, 8


def auto_chunk(tiles, width, height, workers: int, tile_size: int, memory: int) -> Column:
    """Tiles along a side of a chunk. Doubled from SMALLEST while there are more chunks than PER_WORKER for each worker, as long as a
    chunk stays within half of `memory` (32 MiB at least, 256 MiB at most) and within the next power of two of the extent;
    halved while one is beyond that memory."""
    tiles, width, height = (grid._c(v).cast("long") for v in (tiles, width, height))
    budget = min(256 * MIB, max(32 * MIB, memory // 2))
    tiles = F.greatest(tiles, F.lit(1).cast("long"))
    target = clamp_long(F.least(F.lit(max(1, workers)).cast("long"), tiles) * PER_WORKER, 1, tiles)
    longest = F.greatest(width, height, F.lit(1).cast("long"))
    largest = grid._shl(F.lit(1).cast("long"), F.ceil(F.log2(longest.cast("double"))))  # the next power of two
    fits = [c for c in (SMALLEST << k for k in range(30)) if c * c * tile_size * tile_size * 8 <= budget]
    chunks = lambda c: ceil_div(width, F.lit(c).cast("long")) * ceil_div(height, F.lit(c).cast("long"))
    out = F.lit(SMALLEST)
    for c in fits[1:]:  # grows as long as every step before did
        half = c // 2
        out = F.when((out == half) & (chunks(half) > target) & (largest >= c), c).otherwise(out)
    if not fits:
        c = SMALLEST
        while c > 1 and c * c * tile_size * tile_size * 8 > budget:
            c //= 2
        out = F.lit(max(1, c))
    return out.cast("long")


def clamp_long(v, low: int, high) -> Column:
    return F.least(F.greatest(v, F.lit(low).cast("long")), high)


def chunk_plan(jobs: DataFrame, chunk="auto", workers: int = 8, tile_size: int = 512, memory: int = 512 * MIB) -> DataFrame:
    """Per zoom: extents, chunk size (null if chunking is off), chunks, widest chunk and its memory in MiB."""
    e = extents(jobs).withColumns({"width": F.col("max_x") - F.col("min_x") + 1, "height": F.col("max_y") - F.col("min_y") + 1})
    size = auto_chunk("tiles", "width", "height", workers, tile_size, memory) if chunk == "auto" else F.lit(None if chunk in (None, "off") else int(chunk)).cast("long")
    e = e.withColumn("chunk", size)
    c = F.coalesce("chunk", F.greatest("max_x", "max_y") + 1)
    # Tiles of the widest chunk of a zoom: of those that begin within the extent, all have c unless it ends before.
    within = lambda lo, hi: F.when(F.call_function("div", F.col(lo), c) == F.call_function("div", F.col(hi), c), F.col(hi) % c + 1).otherwise(c)
    e = e.withColumns({"chunks": F.when(F.col("chunk").isNull(), 1).otherwise(ceil_div("width", c) * ceil_div("height", c)), "widest": within("min_x", "max_x"), "highest": within("min_y", "max_y")})
    return e.withColumn("mib", chunk_bytes("widest", "highest", F.lit(tile_size).cast("long")) / MIB)
