"""Rendering a raster to tiles: chunks of neighbouring tiles are resampled together, cut and encoded in grouped Arrow functions.

Source and target are both aligned to their axes, in EPSG:3857 or EPSG:4326 one way or the other, so source columns depend on target columns only,
and rows on rows: resampling is two products with sparse weight tables. Strategies differ at the source's edge: the
geographic one goes on with the edge's pixels, the others leave zeros outside.
"""

from __future__ import annotations

import os
import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, grid
from ..plans import jobs as plan
from ..sources.raster import Raster, open_raster
from . import archive
from .encode import encoder

STRATEGIES = {"auto": "auto", "same-crs": "same-crs", "geographic": "geographic", "wgs84": "geographic", "gdal-warp": "warp", "warp": "warp"}
KERNELS = {"near": "nearest", "nearest": "nearest", "bilinear": "bilinear", "cubic": "cubic", "cubicspline": "cubicspline", "cubic_spline": "cubicspline", "lanczos": "lanczos", "average": "average"}
#: Source pixels that a task holds as numbers at a time, about.
SOURCE = 1 << 22
_RADIUS = {"bilinear": 1.0, "cubic": 2.0, "cubicspline": 2.0, "lanczos": 3.0}


@dataclass(frozen=True)
class Options:
    min_zoom: int
    max_zoom: int
    bounds: tuple[float, float, float, float] | None = None
    fmt: str = "png"
    tile_size: int = 512
    resampling: str = "bilinear"
    strategy: str = "auto"
    chunk: str | int | None = "auto"
    workers: int = os.cpu_count() or 1
    memory: int = 512 * plan.MIB
    quality: float = 100.0

    def __post_init__(self):
        if self.tile_size <= 0 or self.workers <= 0 or self.memory <= 0 or not 0 <= self.quality <= 100:
            raise ValueError("tile size, workers and memory must be positive, quality 0 to 100")
        if self.resampling not in KERNELS or self.strategy not in STRATEGIES:
            raise ValueError(f"unknown resampling or strategy: {self.resampling}, {self.strategy}")


def select_strategy(epsg: int | None, north_up: bool, eight_bit: bool, resampling: str, asked: str = "auto") -> str:
    """same-crs or geographic where the source and the kernel allow it, else warp; a forced one that does not fit falls back to warp."""
    kernel, asked = KERNELS[resampling], STRATEGIES[asked]
    fits = {"same-crs": epsg == 3857, "geographic": epsg == 4326}
    if kernel in ("nearest", "bilinear") and north_up and eight_bit:
        for name, ok in fits.items():
            if ok and asked in ("auto", name):
                return name
    return "warp"


def taps(position: np.ndarray, size: int, nearest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower and upper source index and the upper's weight for positions in pixels; indices stay within the source."""
    if size <= 1:
        z = np.zeros(len(position), np.int64)
        return z, z, np.zeros(len(position))
    if nearest:
        at = np.clip(np.where(position >= 0, np.floor(position + 0.5), np.ceil(position - 0.5)).astype(np.int64), 0, size - 1)
        return at, at, np.zeros(len(position))
    low = np.clip(np.floor(position).astype(np.int64), 0, size - 1)
    return low, np.minimum(low + 1, size - 1), np.clip(position - low, 0.0, 1.0)


def _kernel(name: str, d: np.ndarray) -> np.ndarray:
    d = np.abs(d)
    if name == "bilinear":
        return np.maximum(0, 1 - d)
    if name == "cubic":
        return np.where(d < 1, 1.5 * d**3 - 2.5 * d**2 + 1, np.where(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2, 0))
    if name == "cubicspline":
        return np.where(d < 1, 2 / 3 - d**2 + d**3 / 2, np.where(d < 2, (2 - d) ** 3 / 6, 0))
    return np.where(d < 3, np.sinc(d) * np.sinc(d / 3), 0)


def weights(position: np.ndarray, scale: np.ndarray, size: int, kernel: str) -> tuple[np.ndarray, np.ndarray]:
    """(targets, taps) source indices and weights. scale: source pixels a target pixel covers; the kernel widens with it where the source is finer.
    A target's taps depend on itself alone, so results do not depend on chunks. Taps outside the source weigh nothing."""
    p, s = position[:, None], np.maximum(1.0, scale)[:, None]
    if kernel == "nearest":
        i = np.floor(p + 0.5).astype(np.int64)
        w = np.ones(i.shape)
    elif kernel == "average":
        lo, n = p - s / 2, int(np.ceil(s.max())) + 1
        i = np.floor(lo + 0.5).astype(np.int64) + np.arange(n)
        w = np.clip(np.minimum(i + 0.5, p + s / 2) - np.maximum(i - 0.5, lo), 0, None)
    else:
        r = _RADIUS[kernel] * s
        i = np.floor(p - r).astype(np.int64) + 1 + np.arange(int(np.ceil(2 * r.max())))
        w = _kernel(kernel, (i - p) / s)
    w = np.where((i >= 0) & (i < size), w, 0)
    total = sum(w[:, k] for k in range(w.shape[1]))[:, None]
    return np.clip(i, 0, size - 1), np.divide(w, total, out=np.zeros_like(w), where=np.abs(total) > 1e-12)


def source_scales(r: Raster, py: np.ndarray, across: float) -> tuple[float, np.ndarray]:
    """Source columns and rows that a target pixel covers."""
    side = grid.SPAN / across
    if r.epsg == 3857:
        return side / r.gt[1], np.full(len(py), -side / r.gt[5])
    degrees = side / grid.HALF * 180.0
    lat = 2 * np.arctan(np.exp((grid.HALF - (py + 0.5) / across * grid.SPAN) / grid.HALF * np.pi)) - np.pi / 2
    return degrees / r.gt[1], -degrees * np.cos(lat) / r.gt[5]


def source_positions(r: Raster, px: np.ndarray, py: np.ndarray, across: float) -> tuple[np.ndarray, np.ndarray]:
    """Source column of each target column centre and row of each target row centre; target pixels counted from the
    map's corner, `across` of them to a side of the map."""
    mx = -grid.HALF + (px + 0.5) / across * grid.SPAN
    my = grid.HALF - (py + 0.5) / across * grid.SPAN
    if r.epsg == 4326:
        mx, my = mx / grid.HALF * 180.0, np.degrees(2 * np.arctan(np.exp(my / grid.HALF * np.pi)) - np.pi / 2)
    return (mx - r.gt[0]) / r.gt[1] - 0.5, (my - r.gt[3]) / r.gt[5] - 0.5


def _rounded(v: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(v + 0.5), 0, 255).astype(np.uint8)


def crossing(r: Raster, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The source's pixels at some rows and columns, each once, and where each row and column is among them."""
    own_rows, at = np.unique(rows, return_inverse=True)
    own_cols, to = np.unique(cols, return_inverse=True)
    return r.pick(own_rows, own_cols)[:, :, : min(r.bands, 4)].astype(float), at.reshape(rows.shape), to.reshape(cols.shape)


def levels(r: Raster, wide_by: float, high_by: np.ndarray) -> list[tuple[Raster, np.ndarray]]:
    """Target rows by the image that serves them: the smallest overview that is no coarser than the target there, else the raster itself.
    A row's image depends on its zoom and place alone, so results do not depend on chunks."""
    images = [r, *r.overviews]
    use = np.zeros(len(high_by), np.int64)
    for i, o in enumerate(images[1:], 1):
        use[(r.width / o.width <= wide_by * (1 + 1e-9)) & (r.height / o.height <= high_by * (1 + 1e-9))] = i
    return [(images[i], np.flatnonzero(use == i)) for i in np.unique(use).tolist()]


def rows_at_once(columns: int, high_by: float) -> int:
    """Target rows of which SOURCE source pixels hold the taps, about; one at least."""
    return int(max(1, min(256, SOURCE // (max(1, columns) * max(1.0, high_by)))))


def render_area(r: Raster, px: np.ndarray, py: np.ndarray, across: float, strategy: str, kernel: str) -> np.ndarray:
    """Target pixels (rows, columns, bands); at most four bands of the source. Only source rows and columns that have taps are held, some target
    rows at a time; where the source is finer than the target by far, kernels that widen read overviews."""
    out = np.zeros((len(py), len(px), min(r.bands, 4)), np.uint8)
    if strategy == "geographic":
        cols, rows = source_positions(r, px, py, across)
        (xl, xu, xw), (yl, yu, yw) = taps(cols, r.width, kernel == "nearest"), taps(rows, r.height, kernel == "nearest")
        some = rows_at_once(2 * len(px), 2)
        for i in range(0, len(py), some):
            wy = yw[i : i + some, None, None]
            s, (lo, hi), (left, right) = crossing(r, np.stack([yl[i : i + some], yu[i : i + some]]), np.stack([xl, xu]))
            wide = s[:, left] * (1 - xw)[:, None] + s[:, right] * xw[:, None]
            out[i : i + some] = _rounded(wide[lo] * (1 - wy) + wide[hi] * wy)
        return out
    inside = lambda p, n: np.flatnonzero((p >= -0.5) & (p < n - 0.5))
    for o, mine in levels(r, *source_scales(r, py, across)) if kernel != "nearest" else [(r, np.arange(len(py)))]:
        # Target pixels whose centre lies in the source.
        cols, rows = source_positions(o, px, py, across)
        cx, cy = inside(cols, o.width), mine[inside(rows[mine], o.height)]
        if not len(cx) or not len(cy):
            continue
        wide_by, high_by = source_scales(o, py, across)
        xi, xw = weights(cols[cx], np.full(len(cx), wide_by), o.width, kernel)
        some = rows_at_once(xi.size, float(high_by[cy].max()))
        for i in range(0, len(cy), some):
            part = cy[i : i + some]
            yi, yw = weights(rows[part], high_by[part], o.height, kernel)
            s, at, to = crossing(o, yi, xi)
            wide = sum(s[:, to[:, k]] * xw[:, k, None] for k in range(xi.shape[1]))
            out[np.ix_(part, cx)] = _rounded(sum(wide[at[:, k]] * yw[:, k, None, None] for k in range(yi.shape[1])))
    return out


def inferred_bounds(r: Raster, steps: int = 21) -> tuple[float, float, float, float]:
    """Bounds in degrees of points along the raster's edges."""
    if not r.gt or r.epsg not in (3857, 4326):
        raise ValueError("the raster has no usable georeference; give bounds")
    t = np.arange(steps + 1) / steps
    px = np.concatenate([t * r.width, t * r.width, np.zeros(steps + 1), np.full(steps + 1, r.width)])
    py = np.concatenate([np.zeros(steps + 1), np.full(steps + 1, r.height), t * r.height, t * r.height])
    x, y = r.gt[0] + px * r.gt[1] + py * r.gt[2], r.gt[3] + px * r.gt[4] + py * r.gt[5]
    if r.epsg == 3857:
        x, y = x / grid.HALF * 180.0, np.degrees(2 * np.arctan(np.exp(y / grid.HALF * np.pi)) - np.pi / 2)
    ok = np.isfinite(x) & np.isfinite(y)
    return grid.normal_bounds(float(x[ok].min()), float(y[ok].min()), float(x[ok].max()), float(y[ok].max()))


def check_source(r: Raster) -> None:
    if r.bits != 8:
        raise ValueError("only rasters of 8-bit bands are rendered")
    if not r.north_up or r.epsg not in (3857, 4326):
        raise ValueError("only rasters in EPSG:3857 or EPSG:4326 aligned to north are rendered")


def planned(spark: SparkSession, path: str, o: Options) -> tuple[DataFrame, DataFrame, tuple]:
    """Jobs with their chunks, the chunk plan (one row a zoom), and the bounds."""
    bounds = grid.normal_bounds(*o.bounds) if o.bounds else inferred_bounds(open_raster(path))
    j = plan.tile_jobs(spark, bounds, o.min_zoom, o.max_zoom)
    p = plan.chunk_plan(j, o.chunk, o.workers, o.tile_size, o.memory)
    size = {r.z: r.chunk for r in p.select("z", "chunk").collect()}
    c = F.lit(None).cast("long")
    for z, n in size.items():
        c = F.when(F.col("z") == z, F.lit(n if n else 8).cast("long")).otherwise(c)
    return plan.with_chunks(j, c), p, bounds


def plan_report(spark: SparkSession, path: str, o: Options) -> str:
    """Lines: options, source, coverage, first tile with its bounds, and a line a zoom with its chunks. Nothing is rendered."""
    r = open_raster(path)
    jobs, chunks, bounds = planned(spark, path, o)
    first = jobs.orderBy("tile_id").limit(1).select("z", "x", "y", "tile_id", grid.lonlat_bounds("z", "x", "y").alias("b")).first()
    zooms = chunks.orderBy("z").collect()  # a row a zoom
    degrees = lambda v: ", ".join(f"{x:.7f}" for x in v)
    lines = [
        "Options", *(f"  {k.replace('_', ' ')}: {v}" for k, v in vars(o).items() if k != "bounds"),
        "Source", f"  {r.width} x {r.height}, {r.bands} bands, EPSG:{r.epsg}, {len(r.overviews)} overviews", f"  strategy: {select_strategy(r.epsg, r.north_up, r.bits == 8, o.resampling, o.strategy)}",
        "Coverage", f"  bounds: {degrees(bounds)}{'' if o.bounds else ' (inferred)'}", f"  tiles: {sum(z.tiles for z in zooms)}",
    ]
    if first:
        lines.append(f"  first tile: {first.z}/{first.x}/{first.y}, id {first.tile_id}, bounds {degrees(first.b)}")
    lines.append("Zooms")
    lines += [f"  {z.z}: {z.tiles} tiles, x {z.min_x}-{z.max_x}, y {z.min_y}-{z.max_y}, chunk {z.chunk or 'off'}, {z.chunks} chunks, widest {z.widest} x {z.highest} tiles, {z.mib:.1f} MiB" for z in zooms]
    return "\n".join(lines)


def render(spark: SparkSession, path: str, o: Options) -> DataFrame:
    """tile_id, data of every tile. path must be one that all executors see. No barrier between zooms: chunks of all zooms are one stage."""
    r = open_raster(path)
    check_source(r)
    encode = encoder(o.fmt)
    strategy, kernel, ts = select_strategy(r.epsg, r.north_up, r.bits == 8, o.resampling, o.strategy), KERNELS[o.resampling], o.tile_size
    jobs, _, _ = planned(spark, path, o)

    def chunk(table: pa.Table) -> pa.Table:
        global _open
        if _open is None or _open.path != path:
            _open = open_raster(path)
        z, xs, ys, ids = table.column("z")[0].as_py(), *(table.column(c).to_numpy() for c in ("x", "y", "tile_id"))
        x0, y0, across = int(xs.min()), int(ys.min()), float((1 << z) * ts)
        px = np.arange(x0 * ts, (int(xs.max()) + 1) * ts, dtype=float)
        py = np.arange(y0 * ts, (int(ys.max()) + 1) * ts, dtype=float)
        area = render_area(_open, px, py, across, strategy, kernel)
        data = [encode(area[(y - y0) * ts : (y - y0 + 1) * ts, (x - x0) * ts : (x - x0 + 1) * ts], o.quality) for x, y in zip(xs.tolist(), ys.tolist(), strict=True)]
        return pa.table({"tile_id": pa.array(ids, pa.int64()), "data": pa.array(data, pa.binary())})

    return jobs.groupBy("z", "cx", "cy").applyInArrow(chunk, "tile_id long, data binary")


_open: Raster | None = None


def missing(jobs: DataFrame, tiles: DataFrame) -> DataFrame:
    """tile_id and side ('missing' or 'unexpected') of jobs without a tile and of tiles without a job."""
    j, t = jobs.select("tile_id").withColumn("j", F.lit(1)), tiles.select("tile_id").withColumn("t", F.lit(1))
    return j.join(t, "tile_id", "full_outer").filter("j is null or t is null").select("tile_id", F.when(F.col("t").isNull(), "missing").otherwise("unexpected").alias("side"))


def raster(spark: SparkSession, path: str, out: str, o: Options) -> dict:
    """Archive of a raster's tile pyramid. Header bounds are the asked or inferred ones."""
    began = time.time()
    _, _, bounds = planned(spark, path, o)
    jobs = plan.tile_jobs(spark, bounds, o.min_zoom, o.max_zoom)
    tiles = archive.keep(render(spark, path, o), "rendered")
    gone = missing(jobs, tiles).limit(1).collect()
    if gone:
        raise RuntimeError(f"tile {gone[0].tile_id} is {gone[0].side}")
    meta = archive.metadata_text(spark, os.path.basename(out), path, "", o.fmt, o.tile_size, o.min_zoom, o.max_zoom, bounds)
    h = archive.write_archive(tiles, out, meta, archive.header_for(o.fmt, o.min_zoom, o.max_zoom, bounds))
    seconds = time.time() - began
    return {"tiles": h.entries, "format": o.fmt, "tile_size": o.tile_size, "bytes": h.data_offset + h.data_length, "seconds": seconds, "tiles_per_second": h.entries / seconds if seconds > 0 else 0.0, "header_bytes": codec.HEADER_BYTES}
