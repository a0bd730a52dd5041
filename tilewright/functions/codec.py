"""Binary forms of an archive: varints, directories, the header."""

from __future__ import annotations

import struct
from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grid import _c

# Fixed values of the archive format.
MAGIC, VERSION, HEADER_BYTES, ROOT_LIMIT = b"PMTiles", 3, 127, 16_384 - 127
LEAF_ENTRIES = 4096
RESERVE_PER_ENTRY, RESERVE_LEAST, RESERVE_MOST = 24, 64 << 10, 16 << 20
_LAYOUT = struct.Struct("<7sB11Q6B4iB2i")


@dataclass
class Header:
    """The header's fields in the order they are stored in."""

    root_offset: int = 0
    root_length: int = 0
    metadata_offset: int = 0
    metadata_length: int = 0
    leaf_offset: int = 0
    leaf_length: int = 0
    data_offset: int = 0
    data_length: int = 0
    addressed: int = 0
    entries: int = 0
    contents: int = 0
    clustered: int = 1
    internal_compression: int = 1
    tile_compression: int = 1
    tile_type: int = 0
    min_zoom: int = 0
    max_zoom: int = 0
    min_lon_e7: int = 0
    min_lat_e7: int = 0
    max_lon_e7: int = 0
    max_lat_e7: int = 0
    center_zoom: int = 0
    center_lon_e7: int = 0
    center_lat_e7: int = 0

    def pack(self) -> bytes:
        return _LAYOUT.pack(MAGIC, VERSION, *(int(getattr(self, f.name)) for f in fields(self)))

    @classmethod
    def unpack(cls, raw: bytes) -> Header:
        if len(raw) < HEADER_BYTES:
            raise ValueError(f"an archive has {HEADER_BYTES} bytes of header, this file has {len(raw)} bytes")
        magic, version, *values = _LAYOUT.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a tile archive")
        if version != VERSION:
            raise ValueError(f"archive version {version} is not supported")
        return cls(*values)


def e7(degrees: float) -> int:
    """Rounded half away from zero."""
    v = abs(degrees) * 1e7
    return int(v + 0.5) if degrees >= 0 else -int(v + 0.5)


def varint(v: int) -> bytes:
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)
    return bytes(out)


def varint_bytes(v) -> Column:
    """Length of a column's varints."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(_c(v))) / 7.0)).cast("long")


def encode_directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    """entries: (tile_id, offset, length, run_length), ids ascending. One column after the other."""
    ids, offsets, lengths, runs = zip(*entries, strict=True) if entries else ((), (), (), ())
    before = (0, *ids[:-1])
    follows = [i > 0 and offsets[i] == offsets[i - 1] + lengths[i - 1] for i in range(len(ids))]
    columns = [[a - b for a, b in zip(ids, before, strict=False)], runs, lengths, [0 if f else o + 1 for f, o in zip(follows, offsets, strict=True)]]
    return varint(len(ids)) + b"".join(varint(v) for c in columns for v in c)


def decode_directory(raw: bytes) -> list[tuple[int, int, int, int]]:
    values, v, shift = [], 0, 0
    for b in raw:
        v |= (b & 127) << shift
        shift += 7
        if b < 128:
            values.append(v)
            v = shift = 0
    n = values[0] if values else 0
    if shift or len(values) != 4 * n + 1:
        raise ValueError("a damaged directory")
    out, tile = [], 0
    for i in range(n):
        delta, run, length, code = values[1 + i :: n] if n else ()
        tile += delta
        offset = code - 1 if code else out[-1][1] + out[-1][2]
        out.append((tile, offset, length, run))
    return out


# --- the header as columns, of a binary column `content`


def little_endian(content: Column, at: int, size: int, signed: bool = False) -> Column:
    """The integer stored at a byte offset."""
    text = F.hex(F.substring(content, at + 1, size))
    swapped = F.concat(*(F.substring(text, 2 * i + 1, 2) for i in range(size - 1, -1, -1)))
    v = F.conv(swapped, 16, 10).cast("long")
    return F.when(v >= 1 << 8 * size - 1, v - (1 << 8 * size)).otherwise(v) if signed else v


def little_endian_bytes(value, size: int) -> Column:
    """The low bytes of an integer column, as they are stored."""
    text = F.lpad(F.hex(_c(value).cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(text, 15 - 2 * i, 2) for i in range(size))))


def _size(name: str) -> tuple[int, bool]:
    """Bytes of a field, and whether it has a sign."""
    return (8, False) if name in _LONG else (4, True) if name.endswith("_e7") else (1, False)


def header_bytes(values: dict) -> Column:
    """A header of columns by field, in generated code; fields left out have their defaults."""
    every = [little_endian_bytes(values.get(f.name, F.lit(f.default)), _size(f.name)[0]) for f in fields(Header)]
    return F.concat(F.lit(MAGIC), little_endian_bytes(F.lit(VERSION), 1), *every)


def header_columns(content) -> dict[str, Column]:
    """All fields of the header, read in generated code; for files that are archives (see is_archive)."""
    c, out, at = _c(content), {}, 8
    for f in fields(Header):
        size, signed = _size(f.name)
        out[f.name] = little_endian(c, at, size, signed)
        at += size
    return {"version": little_endian(c, 7, 1)} | out


_LONG = {"root_offset", "root_length", "metadata_offset", "metadata_length", "leaf_offset", "leaf_length", "data_offset", "data_length", "addressed", "entries", "contents"}


def is_archive(content) -> Column:
    c = _c(content)
    return (F.octet_length(c) >= HEADER_BYTES) & (F.substring(c, 1, 7) == F.lit(MAGIC)) & (little_endian(c, 7, 1) == VERSION)


def reserve_bytes(entries) -> Column:
    """Room a one-pass writer sets aside for directories."""
    return F.least(F.greatest(_c(entries).cast("long") * RESERVE_PER_ENTRY, F.lit(RESERVE_LEAST).cast("long")), F.lit(RESERVE_MOST).cast("long"))


def compacted(data_length, gap) -> Column:
    """Whether closing the gap before the tiles is worth moving them."""
    return (_c(gap) > 0) & (_c(data_length) <= 4 * _c(gap))
