"""Writing tile archives, and the pack and inspect commands."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, text
from ..plans import layout
from ..sources import tiles as xyz
from ..sources.archive import headers
from ..storage import drop_kept, keep


def write_archive(tiles: DataFrame, path: str, metadata: str, header: codec.Header) -> codec.Header:
    """tiles: tile_id, data. Writes path: header, root, metadata, leaves, tiles in id order.

    Lengths and offsets are computed in Spark before the first byte is written, so directories need no reserve and leave no gap.
    The driver writes the directories; tasks write their tiles at their places, so path must be one that all executors see. A task
    that runs again writes the same bytes to the same places. The file appears under its name when it is whole.
    Several tiles with one id raise; zero-length tiles are taken.
    """
    t = keep(tiles.select("tile_id", "data"), "tiles")
    entries = keep(layout.with_offsets(t.select("tile_id", F.length("data").cast("long").alias("length"))), "entries")
    n, ids, total, longest = entries.agg(F.count("*"), F.count_distinct("tile_id"), F.sum("length"), F.max("length")).first()
    if not n:
        raise ValueError("no tiles to write")
    if n != ids:
        raise ValueError("several tiles have the same address")
    if longest >= 1 << 32:
        raise ValueError("a tile's length takes more than 32 bits")
    root, leaves = layout.directories(entries)
    meta = metadata.encode()
    h = header
    h.root_offset, h.root_length = codec.HEADER_BYTES, len(root)
    h.metadata_offset, h.metadata_length = h.root_offset + len(root), len(meta)
    h.leaf_offset = h.metadata_offset + len(meta)
    h.leaf_length = leaves.agg(F.sum(F.length("raw"))).first()[0] if leaves else 0
    h.data_offset, h.data_length = h.leaf_offset + h.leaf_length, total
    h.addressed = h.entries = h.contents = n
    part = f"{os.path.abspath(path)}.part"
    try:
        with open(part, "wb") as f:
            f.write(h.pack() + root + meta)
            if leaves:
                for r in leaves.orderBy("leaf").select("raw").toLocalIterator():
                    f.write(r[0])
            f.truncate(h.data_offset + total)
        written = place(t.join(entries.select("tile_id", "offset"), "tile_id"), part, h.data_offset)
        if written != total:
            raise RuntimeError(f"{written} of {total} bytes were written")
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    drop_kept(t, entries)
    return h


def place(tiles: DataFrame, path: str, start: int) -> int:
    """Writes data at start + offset of a file that is there already, each task its tiles in order; the number of bytes."""

    def write(batches):
        done = 0
        with open(path, "r+b") as f:
            for b in batches:
                for at, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    f.seek(start + at)
                    done += f.write(data.as_buffer())
            f.flush()
            os.fsync(f.fileno())
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["bytes"])

    return tiles.select("offset", "data").sortWithinPartitions("offset").mapInArrow(write, "bytes long").agg(F.sum("bytes")).first()[0] or 0


def header_for(fmt: str, min_zoom: int, max_zoom: int, bounds) -> codec.Header:
    w, s, e, n = bounds
    return codec.Header(
        tile_type=text.FORMAT_CODES[fmt], min_zoom=min_zoom, max_zoom=max_zoom, min_lon_e7=codec.e7(w), min_lat_e7=codec.e7(s), max_lon_e7=codec.e7(e), max_lat_e7=codec.e7(n),
        center_zoom=min_zoom, center_lon_e7=codec.e7((w + e) / 2), center_lat_e7=codec.e7((s + n) / 2),
    )


def metadata_text(spark: SparkSession, name, description, attribution, fmt, tile_size, min_zoom, max_zoom, bounds) -> str:
    lit = F.lit
    text_or_null = lambda v: lit(v).cast("string")
    return spark.range(1).select(text.metadata_json(text_or_null(name), text_or_null(description), text_or_null(attribution), lit(fmt), lit(tile_size), lit(min_zoom), lit(max_zoom), *map(lit, bounds))).first()[0]


def pack(spark: SparkSession, root: str, path: str, name=None, description=None, attribution=None, tile_size: int = 512) -> dict:
    """Archive of an XYZ tile directory. All tiles must have one image format; header bounds are the union of the tiles'."""
    found = xyz.scan(spark, root)
    s = xyz.statistics(found).first()
    if not s.tiles:
        raise ValueError(f"no tiles found below {root}")
    formats = [r[0] for r in found.select("format").distinct().limit(2).collect()]
    if len(formats) > 1:
        raise ValueError("tiles of several image formats")
    bounds = (s.west, s.south, s.east, s.north)
    meta = metadata_text(spark, name or os.path.basename(root.rstrip("/")) or None, description, attribution, formats[0], tile_size, s.min_zoom, s.max_zoom, bounds)
    h = write_archive(xyz.scan(spark, root, content=True).select("tile_id", F.col("content").alias("data")), path, meta, header_for(formats[0], s.min_zoom, s.max_zoom, bounds))
    return {"tiles": h.entries, "min_zoom": s.min_zoom, "max_zoom": s.max_zoom, "format": formats[0], "bounds": bounds, "bytes": h.data_offset + h.data_length}


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """Headers and metadata of the archives at path (globs allowed), one row each."""
    return headers(spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("file_bytes"), "content"))


def inspect_report(inspected: DataFrame) -> DataFrame:
    """path, report: blocks of lines."""
    c, f = F.col, text.field_text
    lines = [
        F.lit("Archive"), f("File", c("path")), f("Size", text.bytes_text("file_bytes")), f("Version", c("version")), f("Clustered", text.yes_no(c("clustered") == 1)), f("Internal compression", c("internal_compression_name")),
        F.lit("Tiles"), f("Type", c("tile_type_name")), f("Compression", c("tile_compression_name")), f("Zooms", F.concat_ws("-", "min_zoom", "max_zoom")), f("Addressed", text.count_text("addressed")), f("Entries", text.count_text("entries")), f("Contents", text.count_text("contents")),
        F.lit("Bounds"), f("Bounds", text.bounds_text(*(c(f"{k}_e7") / 1e7 for k in ("min_lon", "min_lat", "max_lon", "max_lat")))), f("Center", F.format_string("%.7f, %.7f, %d", c("center_lon_e7") / 1e7, c("center_lat_e7") / 1e7, c("center_zoom"))),
        F.lit("Sections"), *(f(label, text.section_text(c(f"{k}_length"), c(f"{k}_offset"))) for label, k in (("Root", "root"), ("Metadata", "metadata"), ("Leaves", "leaf"), ("Tile data", "data"))),
        F.lit("Metadata"), F.coalesce("metadata", F.format_string("  %d bytes, %s", c("metadata_length"), c("internal_compression_name"))),
    ]
    return inspected.select("path", F.concat_ws("\n", *lines).alias("report"))
