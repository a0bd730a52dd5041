"""python -m tilewright pack|raster|inspect: tile archives from the command line."""

from __future__ import annotations

import argparse
import math
import os
import sys

from pyspark.sql import SparkSession

from .operators import archive, render


def zooms(s: str) -> tuple[int, int]:
    a, _, b = s.partition("-")
    return int(a), int(b or a)


def bounds(s: str) -> tuple[float, ...]:
    v = tuple(float(x) for x in s.split(","))
    if len(v) != 4:
        raise argparse.ArgumentTypeError("bounds are west,south,east,north")
    return v


def memory(s: str) -> int:
    """A number with K, M or G behind it; MiB without."""
    t = s.strip()
    unit = {"K": 1 << 10, "M": 1 << 20, "G": 1 << 30}.get(t[-1:].upper())
    v = float(t[:-1]) * unit if unit else float(t) * (1 << 20)
    if not 1 <= v < math.inf:
        raise argparse.ArgumentTypeError("memory must be positive and finite")
    return int(v)


def positive(s: str) -> int:
    v = int(s)
    if v <= 0:
        raise argparse.ArgumentTypeError("must be positive")
    return v


def chunk(s: str):
    low = s.lower()
    return "auto" if low == "auto" else None if low in ("off", "none", "disable", "disabled") else positive(s)


#: Options of native raster libraries that mean nothing here; refused by name.
REFUSED = ("--warp-threads", "--webp-method", "--warp-option", "--open-option", "--gdal-")


def joined(argv: list[str]) -> list[str]:
    """A value that begins with a minus sign goes to the option before it: argparse would take it for an option."""
    out: list[str] = []
    for x in argv:
        if out and out[-1] == "--bounds":
            out[-1] += f"={x}"
        else:
            out.append(x)
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tilewright", description="Tile archives on Spark.")
    sub = p.add_subparsers(dest="command")
    a = sub.add_parser("pack", help="archive of an XYZ tile directory")
    a.add_argument("root")
    a.add_argument("archive")
    for k in ("name", "description", "attribution"):
        a.add_argument(f"--{k}")
    a.add_argument("--tile-size", type=int, default=512)
    a = sub.add_parser("raster", help="archive of a raster's tile pyramid")
    a.add_argument("raster")
    a.add_argument("archive")
    a.add_argument("--zoom", type=zooms, required=True)
    a.add_argument("--bounds", type=bounds)
    a.add_argument("--format", default="png", choices=["png", "jpeg", "jpg", "webp"])
    a.add_argument("--tile-size", type=positive, default=512)
    a.add_argument("--workers", type=positive, default=os.cpu_count())
    a.add_argument("--chunk-tiles", type=chunk, default="auto")
    a.add_argument("--warp-memory", type=memory, default=512 << 20)
    a.add_argument("--resampling", default="bilinear", choices=sorted(render.KERNELS))
    a.add_argument("--strategy", default="auto", choices=sorted(render.STRATEGIES))
    a.add_argument("--quality", type=float, default=100.0)
    a.add_argument("--plan", action="store_true", help="print the plan, render nothing")
    a = sub.add_parser("inspect", help="header and metadata of an archive")
    a.add_argument("archive")
    return p


def main(argv: list[str]) -> int:
    p = parser()
    for x in argv:
        if x.startswith(REFUSED):
            print(f"tilewright: {x.split('=')[0]} has no meaning on Spark", file=sys.stderr)
            return 1
    try:
        a = p.parse_args(joined(argv))
    except SystemExit as e:
        return 1 if e.code else 0
    if not a.command:
        p.print_help()
        return 0
    spark = SparkSession.builder.appName("tilewright").getOrCreate()
    try:
        if a.command == "pack":
            print(archive.pack(spark, a.root, a.archive, a.name, a.description, a.attribution, a.tile_size))
        elif a.command == "inspect":
            print(archive.inspect_report(archive.inspect(spark, a.archive)).first().report)
        else:
            o = render.Options(*a.zoom, bounds=a.bounds, fmt=a.format.replace("jpeg", "jpg"), tile_size=a.tile_size, resampling=a.resampling, strategy=a.strategy, chunk=a.chunk_tiles, workers=a.workers, memory=a.warp_memory, quality=a.quality)
            if a.plan:
                print(render.plan_report(spark, a.raster, o))
            else:
                print(render.raster(spark, a.raster, a.archive, o))
    except (ValueError, OSError, RuntimeError) as e:
        print(f"tilewright: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
